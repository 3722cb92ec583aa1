"""Substring search through an index of trigrams.

A text column is indexed in blocks of rows. `docs` holds the rows, a folder for each block;
`postings` holds, for each trigram (three neighbouring characters, A-Z taken as a-z) and part of a block
(neighbouring rows of it, of about `PART` bytes of text), the keys of the rows whose text has it, sorted
by trigram, so that a lookup reads few row groups; `grams` says in how many rows each trigram stands. Trigrams of over `most_share` of the rows have no postings:
they hardly narrow a search and would make most of the index.

A search looks its needle's trigrams up, takes the `rarest` of them, intersects their postings, and
verifies the needle on the rows that are left, reading their blocks only. One trigram that no row has
settles that nothing matches. Needles without a selective trigram, and those of under three
characters, have all rows read. Results are those of text.contains, row for row.

Rows whose key is null, or whose text is null, are never found. Repeated keys are fine: each row is
verified by itself. An empty table gives an empty index, which finds nothing.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

#: Rows of a block; share of the rows from which on a trigram has no postings; trigrams of a needle
#: whose postings are intersected; blocks that are named in the plan (more are joined).
ROWS, MOST_SHARE, RAREST, NAMED_BLOCKS = 20_000, 0.1, 4, 5_000
#: Bytes of text in a part of a block; trigrams that may be broadcast.
PART, MOST_OFTEN = 4 << 20, 1_000_000


def folded(needle: str) -> str:
    return needle.translate(str.maketrans(t.UPPER, t.LOWER))


def needle_grams(needle: str) -> list[str]:
    x = folded(needle)
    return sorted({x[i : i + 3] for i in range(len(x) - 2)})


def _grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of each text (21 bits a character) and the text's number, by trigram."""
    found, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, x in enumerate(texts):
        c = np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(c) > 2:
            c[(c >= 65) & (c <= 90)] += np.uint64(32)
            g = np.sort(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])
            found.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
            of.append(np.full(len(found[-1]), i))
    grams, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(grams, kind="stable")
    return grams[order], of[order]


def _spelled(grams: np.ndarray) -> list[str]:
    signs = np.stack([grams >> np.uint64(42), grams >> np.uint64(21) & np.uint64(0x1FFFFF), grams & np.uint64(0x1FFFFF)], axis=1).astype("<u4")
    all_signs = signs.tobytes().decode("utf-32-le")
    return [all_signs[i : i + 3] for i in range(0, len(all_signs), 3)]


def _listed(with_keys: bool):
    """Over rows (_block, key, text): gram and n, in how many rows of a part it stands; also the part and
    those rows' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = itertools.count(TaskContext.get().partitionId() << 32)
        for rows in batches:
            blocks, sizes = rows.column(0).to_numpy(), pc.binary_length(rows.column(2)).to_numpy()
            for block in np.unique(blocks):
                own = np.flatnonzero(blocks == block)
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes[own].astype(np.int64)) // PART)) + 1
                for at in np.split(own, cuts):
                    grams, of = _grams_of(rows.column(2).take(pa.array(at)).to_pylist())
                    first = np.flatnonzero(np.concatenate((grams[:1] == grams[:1], grams[1:] != grams[:-1])))
                    ends = np.append(first, len(grams))
                    out = {"gram": pa.array(_spelled(grams[first]), pa.string()), "n": pa.array(np.diff(ends))}
                    if with_keys:
                        keys = rows.column(1).take(pa.array(at[of]))
                        part = next(parts)
                        out |= {"_block": pa.array(np.full(len(first), block, np.int32)), "_part": pa.array(np.full(len(first), part)), "keys": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), keys)}
                    yield pa.RecordBatch.from_pydict(out)

    return run


@dataclass(frozen=True)
class TrigramIndex:
    """An index below `root`; key and text name the columns of docs."""

    spark: SparkSession
    root: str
    key: str
    text: str

    @staticmethod
    def build(rows: DataFrame, key: str, text: str, root: str, per_block: int = ROWS, most_share: float = MOST_SHARE) -> TrigramIndex:
        """Write an index of rows. Rows are shuffled once; of their trigrams a number for each part, and
        the lists of those that aren't too frequent. No list is longer than a part."""
        spark = rows.sparkSession
        known = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        total = known.count()
        blocks = max(1, -(-total // per_block))
        block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block")
        known.select("*", block).repartition(blocks, "_block").write.partitionBy("_block").parquet(f"{root}/docs")
        docs = spark.read.parquet(f"{root}/docs") if total else known.select("*", block)
        given = docs.select("_block", F.col(key).alias("key"), F.col(text).alias("text"))
        counts = given.mapInArrow(_listed(False), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{root}/grams")
        # at most 1 / most_share times as many as the mean text has, so nearly always a broadcast
        often = spark.read.schema("gram string, n long").parquet(f"{root}/grams").where(F.col("n") > most_share * total).select("gram")
        few = often.limit(MOST_OFTEN + 1).count() <= MOST_OFTEN
        lists = given.mapInArrow(_listed(True), f"gram string, n long, _block int, _part long, keys array<{dict(given.dtypes)['key']}>")
        lists = lists.join(F.broadcast(often) if few else often, "gram", "left_anti")
        lists.write.parquet(f"{root}/unsorted")
        lists = spark.read.schema(lists.schema).parquet(f"{root}/unsorted")
        lists.repartitionByRange("gram", "_block").sortWithinPartitions("gram").write.option("parquet.block.size", 8 << 20).parquet(f"{root}/postings")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/unsorted")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark.createDataFrame([(key, text, total, float(most_share), docs.schema.json())], "key string, text string, total long, most_share double, docs string").coalesce(1).write.parquet(f"{root}/index")
        return TrigramIndex(spark, root, key, text)

    @staticmethod
    def open(spark: SparkSession, root: str) -> TrigramIndex:
        row = spark.read.parquet(f"{root}/index").first()
        return TrigramIndex(spark, root, row["key"], row["text"])

    def _about(self) -> Row:
        return self.spark.read.parquet(f"{self.root}/index").first()

    def _docs(self) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(self._about()["docs"]))).parquet(f"{self.root}/docs")

    def plan(self, needle: str, rarest: int = RAREST) -> tuple[str, list[str]]:
        """How a needle is searched: `scan`, `none` (a trigram of it stands nowhere) or `postings`
        with the trigrams that are intersected. Looks up as many counts as the needle has trigrams."""
        grams = needle_grams(needle)
        if not grams:
            return "scan", []
        index = self._about()
        counts = {r["gram"]: r["n"] for r in self.spark.read.schema("gram string, n long").parquet(f"{self.root}/grams").where(F.col("gram").isin(grams)).collect()}
        if len(counts) < len(grams):
            return "none", []
        narrow = sorted((n, g) for g, n in counts.items() if n <= index["most_share"] * index["total"])
        return ("postings", [g for _, g in narrow[:rarest]]) if narrow else ("scan", [])

    def candidates(self, grams: list[str]) -> DataFrame:
        """_block and key of the rows that have all of grams."""
        kind = dict(self._docs().dtypes)[self.key]
        lists = self.spark.read.schema(f"gram string, n long, _block int, _part long, keys array<{kind}>").parquet(f"{self.root}/postings").where(F.col("gram").isin(grams))
        whole = lists.groupBy("_block", "_part").agg(F.count("*").alias("k"), F.collect_list("keys").alias("all")).where(F.col("k") == len(grams))
        # at most `rarest` lists a part, each no longer than the part
        both = F.aggregate(F.slice("all", 2, len(grams)), F.element_at("all", 1), lambda x, y: F.array_intersect(x, y))
        return whole.select("_block", F.explode(both).alias(self.key))

    def search(self, needle: str, rarest: int = RAREST) -> DataFrame:
        """The rows whose text holds the needle, A-Z taken as a-z."""
        docs = self._docs()
        way, grams = self.plan(needle, rarest)
        if way == "none":
            return docs.limit(0).drop("_block")
        if way == "postings":
            found = self.candidates(grams)
            blocks = [r[0] for r in found.select("_block").distinct().limit(NAMED_BLOCKS + 1).collect()]
            if len(blocks) <= NAMED_BLOCKS:
                docs = docs.where(F.col("_block").isin(blocks))
            docs = docs.join(found.distinct(), ["_block", self.key], "left_semi")
        return docs.where(t.contains(self.text, needle)).drop("_block")
