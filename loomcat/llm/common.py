"""Helpers shared by the training-data operators.

Spark partitions and shuffles the work; the numpy code here runs inside tasks, on one bounded
chunk of rows at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import drop, fresh, table  # noqa: F401  used through this module

BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
U64 = np.uint64
#: Rows of one Arrow batch; small, since a document may be very long.
BATCH_ROWS = 256


def session(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of very long texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of `rows` short rows for what is written inside; the setting is restored."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def freed(fn):
    """fn for mapInPandas, giving its memory back when the task ends. Python workers outlive their
    tasks, several of them wait idle in an executor, and allocators keep what was freed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return run


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and `more`; other columns, also clashing ones, go.

    Rows without doc_id can't be named in a result and go. Of rows with one doc_id the one with the
    least text counts (null is least); only where such rows exist, found by a count over the ids
    alone, are texts shuffled for it.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).where("doc_id IS NOT NULL")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    rest = [F.min_by(c, F.coalesce("text", F.lit(""))).alias(c) for c in more]
    return table(docs.groupBy("doc_id").agg(F.when(F.count("*") == F.count("text"), F.min("text")).alias("text"), *rest), "one-per-id")


def one_row(documents: DataFrame) -> DataFrame:
    """documents with all columns and one row for each doc_id (the one with the least text, as in
    texts); rows without doc_id go."""
    documents = documents.where("doc_id IS NOT NULL")
    if documents.groupBy("doc_id").count().where("count > 1").isEmpty():
        return documents
    least = F.struct(F.coalesce("text", F.lit("")).alias("k"), F.struct(*documents.columns).alias("row"))
    return documents.groupBy("doc_id").agg(F.min(least).alias("m")).select("m.row.*")


def split_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8: bytes.split() splits on exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word; each distinct word is hashed once."""
    if not words:
        return np.zeros(0, U64)
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    codes, unique = pd.factorize(flat)
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in unique), U64, len(unique))[codes]


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to about `most` (one larger item stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        one = np.ones(m, U64)
        up, down = one.copy(), one.copy()
        up[1:], down[1:] = U64(BASE), U64(BASE_INV)
        _powers[0] = have = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: out[i] covers codes[:i]."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def rolling(prefix: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k neighbours, whatever their place."""
    n = len(prefix) - k
    return (prefix[k:] - prefix[:n]) * powers(max(n, 0))[1] if n > 0 else np.zeros(0, U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits (a finaliser in the style of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by doubling."""
    if w <= 1 or len(h) < w:
        return h if w <= 1 else h[:0]
    step = 1
    while step * 2 <= w:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (w - step)], h[w - step :]) if w > step else h


def window_runs(codes: np.ndarray, win: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one text's windows.

    Every window of `win` symbols is named by the least mixed hash of its k-grams, so equal windows
    have equal anchors wherever they stand. Returns, for each maximal run of window starts with one
    anchor: anchor hash, first start, number of starts.
    """
    if len(codes) < win:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding_min(mix(rolling(prefix_hash(codes), k)), win - k + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[first], first, np.diff(np.concatenate((first, [len(least)])))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def union_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the half-open spans; touching spans make one run."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.concatenate((new[1:], [True]))]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, root), root the least id reachable.

    Alternating large-star and small-star steps: each node's neighbours are linked to the least
    of them, by grouped minima and joins. The edge list never grows, nothing reaches the driver
    but a count, and a hot node's rows are only ever aggregated or joined; the minima are written
    first, so that adaptive execution can split a hot node's join.
    """
    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = table(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low = table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        after = table(small, "edges")
        # a star forest: every node has one edge and no centre has an edge of its own
        n, sources, mid = after.agg(F.count("*"), F.count_distinct("a")).first() + (after.select(F.col("b").alias("a")).distinct().join(after, "a", "left_semi").count(),)
        e = after
        if n == sources and not mid:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
