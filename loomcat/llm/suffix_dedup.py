"""Repeated byte strings, found by a hash-compared suffix sort.

Every `length`-byte window is named by its anchor, the leftmost least hash of its k-grams, so equal
windows meet under one anchor at one offset. Per anchor:

1. Occurrences whose surroundings (all windows of the anchor) are the same bytes collapse to one
   entry, of which two occurrences are kept.
2. The entries' suffixes from the anchor on, and their reversed prefixes before it, are sorted by
   mergesort. Two suffixes are compared by their longest common extension, found by binary search
   over prefix polynomial hashes; neighbours' common extensions are then verified on the bytes.
3. A window at offset o recurs if another entry has `length` - o bytes to the right and o bytes to
   the left in common, read off the two sorted orders.

An anchor with more than `hot` distinct surroundings is not sorted in one task: its windows are
counted by two independent 64-bit hashes, spread over all tasks, instead.

Of stretches that stand more than twice in one document with the same surroundings (periodic text)
the third and later ones are removed for certain; they go as merged spans, not one by one.

Defined cases: very long texts are handled whole; null text is empty; texts under `length` bytes lose nothing; equal texts of at least
`length` bytes are removed wholly, the first as well; repeated doc_ids: see common.texts; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LENGTH, GRAM = 400, 160
#: Distinct surroundings of an anchor beyond which its windows are counted by hash.
HOT = 4_000
#: Bytes sorted at a time, and window starts of a long text that are anchored at a time.
CHUNK, BLOCK = 4_000_000, 1 << 19
PLACE = (1 << 20) - 1


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: anchor hash, first start, number of starts, and the
    anchor's distance from the first start."""
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        block = data[at : at + BLOCK + length - 1].astype(c.U64)
        h = c.mix(c.rolling(c.prefix_hash(block + c.U64(1)), gram))
        least = c.sliding_min((h & c.U64(~PLACE & (2**64 - 1))) | np.arange(len(h), dtype=c.U64), length - gram + 1)
        place = (least & c.U64(PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        out.append((h[place[first]], first + at, np.diff(np.concatenate((first, [len(place)]))), place[first] - first))
    if not out:
        return np.zeros(0, c.U64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _profile(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                a, start, n, off = anchors(np.frombuffer(raw, np.uint8), length, gram)
                around = np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + m + length - 1]) for s, m in zip(start, n, strict=True)), c.U64, len(a))
                by = np.argsort(around, kind="stable")
                third = by[2:][around[by[2:]] == around[by[:-2]]]
                sure_starts, sure_ends = c.union_spans(start[third], start[third] + n[third] + length - 1)
                a, around, start, n, off = (np.delete(x, third) for x in (a, around, start, n, off))
                out.append((doc_id, len(raw), hashlib.sha256(raw).hexdigest(), c.signed(a), c.signed(around), start, n.astype(np.int32), off.astype(np.int32), sure_starts, sure_ends))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "sha256", "anchor", "around", "start", "n", "off", "sure_starts", "sure_ends"])

    return run


def _segments(length: int):
    """One row for each entry that is kept for its anchor: the bytes of all its windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, runs in zip(pdf["text"], pdf["runs"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(r["anchor"], r["around"], r["lo"], r["hot"], r["off"], raw[r["start"] : r["start"] + r["n"] + length - 1]) for r in runs if r["lo"] or r["hi"]]
            yield pd.DataFrame(out, columns=["anchor", "around", "lo", "hot", "off", "data"])

    return run


class Suffixes:
    """Suffixes data[pos : pos + size], compared by prefix hashes."""

    def __init__(self, data: np.ndarray, pos: np.ndarray, size: np.ndarray):
        self.data, self.pos, self.size = data, pos, size
        self.prefix, self.down = c.prefix_hash(data.astype(c.U64) + c.U64(1)), c.powers(len(data) + 1)[1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of each pair, by binary search."""
        p, q = self.pos[i], self.pos[j]
        hp, hq, dp, dq = self.prefix[p], self.prefix[q], self.down[p], self.down[q]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.prefix[p + mid] - hp) * dp == (self.prefix[q + mid] - hq) * dq
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        end_i, end_j = n == self.size[i], n == self.size[j]
        last = len(self.data) - 1
        less = self.data[np.minimum(self.pos[i] + n, last)] < self.data[np.minimum(self.pos[j] + n, last)]
        return np.where(end_i & end_j, or_equal, np.where(end_i, True, np.where(end_j, False, less)))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Indexes in suffix order within each group (groups are contiguous): bottom-up mergesort,
        all merges of a level at once. An element's place is its own rank plus its rank in the
        sibling run, found by binary search."""
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.concatenate((begin, [len(group)])))
        start, many = np.repeat(begin, sizes), np.repeat(sizes, sizes)
        order, width = np.arange(len(group)), 1
        while width < sizes.max(initial=0):
            at = np.flatnonzero(many > width)
            own = (at - start[at]) // width
            run = start[at] + own * width
            left = own % 2 == 0
            end = start[at] + many[at]
            lo0 = np.minimum(np.where(left, run + width, run - width), end)
            lo, hi = lo0.copy(), np.where(left, np.minimum(lo0 + width, end), run)
            x = order[at]
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                # a left element goes after the lesser of the right run; a right one after equals too
                goes = self.before(order[mid], x[open_], ~left[open_])
                lo[open_], hi[open_] = np.where(goes, mid + 1, lo[open_]), np.where(goes, hi[open_], mid)
            merged = order.copy()
            merged[np.where(left, at, at - width) + lo - lo0] = x
            order, width = merged, width * 2
        return order

    def shared(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common extension with the one before in order, verified on the bytes; -1 at a group's first."""
        out = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(group[1:] == group[:-1]) + 1
        i, j = order[at - 1], order[at]
        out[at] = n = self.common(i, j)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(self.data[np.repeat(self.pos[i], n) + step], self.data[np.repeat(self.pos[j], n) + step]):
            raise ValueError("hash collision")
        return out

    def ordered(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        try:
            order = self.sort(group)
            return order, self.shared(order, group)
        except ValueError:  # two strings of one hash: sort this chunk by its bytes
            raw = [self.data[p : p + n].tobytes() for p, n in zip(self.pos, self.size, strict=True)]
            order = np.array(sorted(range(len(raw)), key=lambda i: (group[i], raw[i])), np.int64)
            same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            return order, np.array([-1] + [same(raw[a], raw[b]) if group[a] == group[b] else -1 for a, b in zip(order[:-1], order[1:], strict=True)], np.int64)


def recurring(group: np.ndarray, off: np.ndarray, data: list[bytes], length: int) -> list[np.ndarray]:
    """For each entry, the places of its windows that some other entry of its group also has."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat, end = np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes)
    pos = end - sizes + off
    orders = []
    for text, p, n in ((flat, pos, np.minimum(end - pos, length)), (flat[::-1].copy(), len(flat) - pos, off)):
        order, shared = Suffixes(text, p, n).ordered(group)
        orders.append((order, shared))
    windows, found = sizes - length + 1, [[] for _ in data]
    for o in range(int(off.max(initial=-1)) + 1):
        ids = []
        for (order, shared), depth in zip(orders, (length - o, o), strict=True):
            cls = np.empty(len(data), np.int64)
            cls[order] = np.cumsum(shared < depth)
            ids.append(cls)
        at = np.flatnonzero((off >= o) & (off - o < windows))
        key = (ids[0] * (len(data) + 1) + ids[1])[at]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = at[by[np.concatenate(([False], same)) | np.concatenate((same, [False]))]] if len(at) else at
        for e in hit.tolist():
            found[e].append(off[e] - o)
    return [np.array(x[::-1], np.int64) for x in found]


def _runs(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    return c.union_spans(places, places + length)


def _sorted(length: int):
    """Rows come sorted by anchor; whole groups are sorted together up to CHUNK bytes."""

    def flush(rows: list[tuple]) -> pd.DataFrame:
        group = np.cumsum([True] + [a[0] != b[0] for a, b in zip(rows[:-1], rows[1:], strict=True)])
        places = recurring(group, np.array([r[3] for r in rows], np.int64), [r[4] for r in rows], length)
        out = [(r[0], r[1], *_runs(p, length)) for r, p in zip(rows, places, strict=True) if r[2] and len(p)]
        return pd.DataFrame(out, columns=["anchor", "around", "starts", "ends"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for pdf in batches:
            for r in zip(pdf["anchor"], pdf["around"], pdf["lo"], pdf["off"], pdf["data"], strict=True):
                if held > CHUNK and r[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[4])
        if rows:
            yield flush(rows)

    return run


def _hashed(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for anchor, around, lo, data in zip(pdf["anchor"], pdf["around"], pdf["lo"], pdf["data"], strict=True):
                h = c.mix(c.rolling(c.prefix_hash(np.frombuffer(data, np.uint8).astype(c.U64) + c.U64(1)), length))
                yield pd.DataFrame({"anchor": anchor, "around": around, "lo": lo, "at": np.arange(len(h)), "hash": c.signed(h), "check": c.signed(np.fromiter((xxhash.xxh3_64_intdigest(data[i : i + length]) for i in range(len(h))), c.U64, len(h)))})

    return run


def _joined(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(a, r, *_runs(np.sort(np.asarray(p)), length)) for a, r, p in zip(pdf["anchor"], pdf["around"], pdf["places"], strict=True)], columns=["anchor", "around", "starts", "ends"])

    return run


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, text, found, sure in zip(pdf["doc_id"], pdf["text"], pdf["found"], pdf["sure"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            spans = [(f["starts"] + f["start"], f["ends"] + f["start"]) for f in found] + ([(sure["sure_starts"], sure["sure_ends"])] if sure is not None else [])
            s, e = c.union_spans(np.concatenate([x for x, _ in spans]), np.concatenate([x for _, x in spans]))
            kept = b"".join(raw[i:j] for i, j in zip(np.concatenate(([0], e)), np.concatenate((s, [len(raw)])), strict=True))
            out.append((doc_id, int((e - s).sum()), s, e, kept))
        yield pd.DataFrame(out, columns=["doc_id", "n_removed", "starts", "ends", "kept"])


def find_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Two tables. profile: doc_id, n_bytes, sha256 of every document. removals: doc_id, n_removed,
    starts and ends (maximal removed runs of bytes, half-open), kept (binary) of each document with
    a `length`-byte string that also starts anywhere else."""
    spark = c.session(documents.sparkSession)
    docs = c.texts(documents)
    gram = min(gram, length)
    fields = ["anchor", "around", "start", "n", "off"]
    profile = c.table(docs.mapInPandas(c.freed(_profile(length, gram)), "doc_id long, n_bytes long, sha256 string, anchor array<long>, around array<long>, start array<long>, n array<int>, off array<int>, sure_starts array<long>, sure_ends array<long>"), "profile")
    runs = profile.select("doc_id", F.explode(F.arrays_zip(*fields)).alias("r")).select("doc_id", *(F.col(f"r.{f}").alias(f) for f in fields))
    # what is joined with many rows a key is written first: adaptive execution splits hot keys of a
    # join only where both sides are plain exchanges
    again = c.table(runs.groupBy("anchor").count().where("count > 1").select("anchor"), "recurring")
    met = c.table(runs.join(again, "anchor", "left_semi"), "met")
    place = F.struct("doc_id", "start")
    entries = c.table(met.groupBy("anchor", "around").agg(F.min(place).alias("first"), F.max(place).alias("last")), "entries")
    many = c.table(entries.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    entries = c.table(entries.join(many, "anchor", "left"), "entries") if not many.isEmpty() else entries.withColumn("hot", F.lit(False))
    marked = met.join(entries, ["anchor", "around"]).select("doc_id", F.struct(*fields, (place == F.col("first")).alias("lo"), (place == F.col("last")).alias("hi"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("r"))
    work = c.table(docs.join(marked.groupBy("doc_id").agg(F.collect_list("r").alias("runs")), "doc_id"), "work")
    segments = c.table(work.select("text", "runs").mapInPandas(c.freed(_segments(length)), "anchor long, around long, lo boolean, hot boolean, off int, data binary"), "segments")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = "anchor long, around long, starts array<long>, ends array<long>"
    found = segments.where("NOT hot").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInPandas(c.freed(_sorted(length)), spans)
    windows = segments.where("hot").mapInPandas(c.freed(_hashed(length)), "anchor long, around long, lo boolean, at long, hash long, check long")
    if not segments.where("hot").isEmpty():
        windows = c.table(windows, "hot")
        again = c.table(windows.groupBy("hash", "check").count().where("count > 1").select("hash", "check"), "hot-recurring")
        found = found.unionByName(windows.where("lo").join(again, ["hash", "check"], "left_semi").groupBy("anchor", "around").agg(F.collect_list("at").alias("places")).mapInPandas(c.freed(_joined(length)), spans))
    hits = met.join(found, ["anchor", "around"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "starts", "ends")).alias("found"))
    sure = profile.where(F.size("sure_starts") > 0).select("doc_id", F.struct("sure_starts", "sure_ends").alias("sure"))
    removals = c.table(work.select("doc_id", "text").join(hits, "doc_id").join(sure, "doc_id", "left").mapInPandas(c.freed(_kept), "doc_id long, n_removed long, starts array<long>, ends array<long>, kept binary"), "removals")
    return profile.select("doc_id", "n_bytes", "sha256"), removals


def digest(documents: DataFrame) -> DataFrame:
    profile, removals = find_repeats(documents)
    removed = removals.select("doc_id", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha"))
    zero = F.lit(0).cast("long")
    return profile.join(removed, "doc_id", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "sha256").alias("kept_sha256"))


#: Bytes as hexadecimal digits; blocks keep each window's piece short.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, 400 * k AS base, substr(h, 800 * k + 1, 1598) AS piece FROM d, unnest(range(0, len(h) // 800 + 1)) t(k)),
w AS (SELECT doc_id, base + j AS p, md5(substr(piece, 2 * j + 1, 800)) AS m FROM b, unnest(range(0, greatest(0, (len(piece) - 798) // 2))) t(j)),
hit AS (SELECT doc_id, p FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
edge AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) + 400 AS opens FROM hit),
run AS (SELECT doc_id, p, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge),
span AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS e FROM run GROUP BY doc_id, k),
cut AS (SELECT doc_id, count(*) AS spans, sum(e - a) AS removed, list(a ORDER BY a) AS starts, list(e ORDER BY a) AS ends FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(0, spans + 1),
           lambda i: substr(h, 1 + 2 * CASE WHEN i = 0 THEN 0 ELSE ends[i] END, 2 * (CASE WHEN i = spans THEN len(h) // 2 ELSE starts[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE ends[i] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
