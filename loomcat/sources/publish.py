"""Publishing by compare-and-set: write aside, check what was written, then claim the next number.

Below a root, `versions` holds data that is never changed and `manifests` one small file for each
published version, named by its number. A manifest is written aside and put in place only if no file
of that name exists, so of several writers one gets a number and the others look again and take the
next. A reader takes the highest number: it sees the old version until the new one is complete, and
a writer that dies before its claim leaves nothing but data that no manifest names (`sweep` deletes
it). A batch has one version: whoever finds its batch published takes that version.

The claim is a hard link on a local disk and a rename elsewhere; the store must refuse to rename onto
a file that exists, as HDFS does. Object stores that only overwrite can't be claimed on this way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Claims that one call tries before it gives up.
TRIES = 1000


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, name: str, body: str) -> None:
    path, fs = _path(spark, name)
    out = fs.create(path, False)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()


def _get(spark: SparkSession, name: str) -> str:
    path, fs = _path(spark, name)
    data = fs.open(path)
    try:
        return bytes(data.readAllBytes()).decode()
    finally:
        data.close()


def _claim(spark: SparkSession, source: str, target: str) -> bool:
    """Give source the name target, unless that exists."""
    (one, fs), (two, _) = _path(spark, source), _path(spark, target)
    if fs.getUri().getScheme() != "file":
        return not fs.exists(two) and fs.rename(one, two)
    none = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0)
    source_file, target_file = (spark._jvm.java.nio.file.Paths.get(x.toUri().getPath(), none) for x in (one, two))
    try:
        spark._jvm.java.nio.file.Files.createLink(target_file, source_file)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    fs.delete(one, False)
    return True


def manifests(spark: SparkSession, root: str) -> list[dict]:
    """number, batch and path of each version, oldest first."""
    path, fs = _path(spark, f"{root}/manifests")
    if not fs.exists(path):
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(path) if x.getPath().getName().isdigit())
    return [json.loads(_get(spark, f"{root}/manifests/{n}")) for n in names]


def publish(df: DataFrame, root: str, check: Callable[[DataFrame], None], batch: str | None = None) -> str:
    """Write df below root, run check on what is read back (it raises to reject), and claim a version
    for it. A batch that is published already, also by another writer meanwhile, is not published
    again. Returns the version's path."""
    spark = df.sparkSession
    batch = batch or uuid.uuid4().hex
    if done := [m for m in manifests(spark, root) if m["batch"] == batch]:
        return done[0]["path"]
    path = f"{root}/versions/{uuid.uuid4().hex}"
    df.write.parquet(path)
    check(spark.read.parquet(path))
    mine = claim_next(spark, root, lambda known: None if any(m["batch"] == batch for m in known) else {"batch": batch, "path": path})
    if mine is not None:
        return path
    _delete(spark, path)
    return next(m["path"] for m in manifests(spark, root) if m["batch"] == batch)


def claim_next(spark: SparkSession, root: str, make: Callable[[list[dict]], dict | None]) -> dict | None:
    """Put the manifest that make gives, for the manifests that there are, in place under the next
    number; where another writer was first, make is asked again. None if make gives none."""
    folder, fs = _path(spark, f"{root}/manifests")
    fs.mkdirs(folder)
    for _ in range(TRIES):
        known = manifests(spark, root)
        body = make(known)
        if body is None:
            return None
        number = known[-1]["number"] + 1 if known else 0
        aside = f"{root}/manifests/aside-{uuid.uuid4().hex}"
        _put(spark, aside, json.dumps({"number": number, **body}))
        if _claim(spark, aside, f"{root}/manifests/{number:012d}"):
            return {"number": number, **body}
        _delete(spark, aside)
    raise RuntimeError(f"no version of {root} could be claimed in {TRIES} tries")


def _delete(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def current(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The version that was published last, or the one with that number; None without one."""
    known = [m for m in manifests(spark, root) if number is None or m["number"] == number]
    return spark.read.parquet(known[-1]["path"]) if known else None


def sweep(spark: SparkSession, root: str, older_ms: int = 86_400_000) -> int:
    """Delete data and manifests that were left by writers which died, if they are older than that.
    Returns how many."""
    named = {m["path"].rpartition("/")[2] for m in manifests(spark, root)}
    now, gone = spark._jvm.java.lang.System.currentTimeMillis(), 0
    for part in ("versions", "manifests"):
        path, fs = _path(spark, f"{root}/{part}")
        for x in fs.listStatus(path) if fs.exists(path) else []:
            name = x.getPath().getName()
            if name not in named and not (part == "manifests" and name.isdigit()) and now - x.getModificationTime() >= older_ms:
                gone += bool(fs.delete(x.getPath(), True))
    return gone


def archive(raw: DataFrame, root: str, check: Callable[[DataFrame], DataFrame]) -> str:
    """Keep raw bodies byte for byte (column body, binary), also of payloads that are rejected; then
    publish what check makes of them, which raises to reject."""
    spark = raw.sparkSession
    path = f"{root}/raw/{uuid.uuid4().hex}"
    raw.write.parquet(path)
    return publish(check(spark.read.parquet(path)), root, lambda _: None)


def enrich(base: DataFrame, extra: DataFrame, key: str, what: str) -> DataFrame:
    """base with the columns of extra; raises if extra lacks a key of base, or has one twice."""
    if not extra.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{what}: repeated {key}")
    missing = base.select(key).join(extra.select(key), key, "left_anti").count()
    if missing:
        raise ValueError(f"missing {missing} {what}")
    return base.join(extra, key)
