"""WARC archives, index first.

Writing: each task appends its records, each a gzip member of its own (.warc.gz), to archives of
about ARCHIVE_BYTES in the shared folder and yields an index row for each: archive, offset, length
(of the member), URL, payload digest. A record whose payload another record with a smaller page_id
has is a revisit without payload; which ones are is found by a shuffle of ids and digests alone, and
payloads are only shuffled where over BROADCAST_REVISITS pages revisit. The index is a table.
Reading: selected index rows are dealt to tasks by archive and range, sorted by offset, and
neighbouring records are read by one byte-range read; each record is parsed and its digest checked.

An archive's name holds the task attempt, so a task that runs again writes other files, and index
rows always name a file that was closed; files of lost attempts are never read. Archives go through
pyarrow's filesystem of the folder's URI, so the folder may be any store that pyarrow reaches.

Defined cases: very long html is one record; null html is an empty payload; null url is written as `urn:page:<page_id>`; page_id
null can't be named and goes; of rows with one page_id, the one with the least payload counts; equal
payloads, empty ones too, make one response and revisits; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

ARCHIVE_BYTES = 64 << 20
#: Records closer than GAP bytes are read together, up to READ bytes a read; a task's range of an archive.
GAP, READ, RANGE = 64 << 10, 8 << 20, 16 << 20
INDEX = "page_id long, archive string, offset long, length long, url string, digest string, kind string, refers_to long"
#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT = 0
#: Revisits (two numbers each) that may be broadcast.
BROADCAST_REVISITS = 2_000_000
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with refers_to a revisit without payload."""
    url = "".join(ch for ch in url if ch > " ") or f"urn:page:{page_id}"
    body = b"" if refers_to is not None else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; a damaged record raises ValueError."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length doesn't match its header")
    return headers, rest[:size]


def _member(raw: bytes) -> bytes:
    try:
        return gzip.decompress(raw)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError("no WARC record here") from e


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", uri))


def write(pages: DataFrame, folder: str | None = None, broadcast_revisits: int = BROADCAST_REVISITS) -> DataFrame:
    """The index of the archives of all pages: INDEX. folder: a new one for the archives, by default
    among the application's tables, which storage.drop_tables deletes."""
    spark = c.session(pages.sparkSession)
    rows = pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    if not rows.groupBy("page_id").count().where("count > 1").isEmpty():
        rows = c.table(rows.groupBy("page_id").agg(F.min(F.struct("html", "url")).alias("r")).select("page_id", "r.url", "r.html"), "one-per-page")
    ids = c.table(rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("size")), "digests")
    large = ids.where(F.col("size") >= LEAST_REVISIT)
    # written first: adaptive execution splits a hot digest only where both sides are plain exchanges
    first = c.table(large.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "first")
    again = c.table(large.join(first, "sha").where("page_id > first").select("page_id", F.col("first").alias("refers_to")), "revisits")
    again = F.broadcast(again) if again.count() <= broadcast_revisits else again
    folder = folder or c.fresh(spark, "warc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        stem = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        out, held, done, number = None, [], 0, 0

        def close() -> pd.DataFrame:
            nonlocal out, held, done, number
            out.close()
            found = pd.DataFrame(held, columns=["page_id", "archive", "offset", "length", "url", "digest", "kind", "refers_to"]).astype({"refers_to": "Int64"})
            out, held, done, number = None, [], 0, number + 1
            return found

        for pdf in batches:
            for page_id, url, html, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                refers = None if pd.isna(refers) else int(refers)
                digest = payload_digest(html)
                raw = gzip.compress(record(page_id, url or "", html, digest, refers), LEVEL, mtime=0)
                name = f"{stem}-{number}.warc.gz"
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(raw)
                held.append((page_id, name, done, len(raw), url, digest, "response" if refers is None else "revisit", refers))
                done += len(raw)
                if done >= ARCHIVE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    index = rows.join(again, "page_id", "left").mapInPandas(c.freed(run), INDEX)
    return c.table(index, "warc-index").withColumn("archive", F.concat(F.lit(folder + "/"), "archive"))


def read(index: DataFrame) -> DataFrame:
    """page_id, kind, refers_to, digest, payload of the records that the index rows name."""
    spark = c.session(index.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def records(store, path: str, group: list[tuple[int, int, int]]) -> Iterator[tuple]:
        with store.open_input_file(path) as f:
            at = 0
            while at < len(group):
                start, end, stop = group[at][0], group[at][0] + group[at][1], at + 1
                while stop < len(group) and group[stop][0] - end <= GAP and group[stop][0] + group[stop][1] - start <= READ:
                    end = max(end, group[stop][0] + group[stop][1])
                    stop += 1
                block = f.read_at(end - start, start)
                for offset, length, page_id in group[at:stop]:
                    headers, body = parse(_member(block[offset - start : offset - start + length]))
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    refers = headers.get("warc-refers-to")
                    if headers["warc-record-id"] != f"<urn:page:{page_id}>" or (refers is None and payload_digest(body) != digest):
                        raise ValueError(f"{path} at {offset}: not the record that the index names")
                    yield page_id, headers["warc-type"], int(refers.strip("<>").rpartition(":")[2]) if refers else None, digest, None if refers else body
                at = stop

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, g in pdf.groupby("archive", sort=False):
                store, base = _filesystem(path)
                group = list(zip(g["offset"].tolist(), g["length"].tolist(), g["page_id"].tolist(), strict=True))
                rows, held = [], 0
                for r in records(store, base, group):
                    rows.append(r)
                    held += len(r[4] or b"")
                    if held > READ:
                        yield _frame(rows)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["page_id", "kind", "refers_to", "digest", "payload"]).astype({"refers_to": "Int64"})

    ranged = index.select("archive", "offset", "length", "page_id", (F.col("offset") / RANGE).cast("long").alias("range"))
    return ranged.repartition(parts, "archive", "range").sortWithinPartitions("archive", "offset").mapInPandas(c.freed(run), "page_id long, kind string, refers_to long, digest string, payload binary")


def digest(pages: DataFrame) -> DataFrame:
    """The contract's rows; a revisit's payload size is that of the response it refers to."""
    index = write(pages)
    got = c.table(read(index).select("page_id", "kind", "refers_to", F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("size")), "records")
    sizes = got.where("kind = 'response'").select(F.col("page_id").alias("refers_to"), F.col("size").alias("full"), F.col("payload_digest").alias("same"))
    again = got.where("kind = 'revisit'").join(sizes, "refers_to", "left").select("page_id", F.when(F.col("same") == F.col("payload_digest"), F.col("full")).alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), "refers_to")
    first = got.where("kind = 'response'").select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), "refers_to")
    return first.unionByName(again)


#: Base32 of the SHA-1 by five hexadecimal digits (20 bits, 4 letters) at a time.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(payload)) AS n, h, min(page_id) OVER (PARTITION BY h) AS first,
                  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                      1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS b
           FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
