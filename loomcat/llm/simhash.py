"""Near-duplicate documents by SimHash.

1. A document's fingerprint has bit i set if over half of its word shingles (repeats count) have it
   set in their 64-bit hash. Documents with one fingerprint collapse to it; only distinct ones go on.
2. Fingerprints that differ in at most MOST bits agree in at least SHARED = 8 - MOST of their eight
   bytes. The inverted index holds, for every choice of SHARED byte positions and their values, the
   list of fingerprints with these values, so a pair meets in a list exactly if a tally of shared
   positional bytes reaches the guaranteed minimum. Lists of single bytes would grow with the
   corpus / 256 each, and a tally over them with its square; a list of four bytes holds one in 2^32
   of the fingerprints, beside near copies.
3. In a list each pair's shared bytes are tallied and its differing bits counted. Lists of up to FEW
   give every linked pair, once, where its first SHARED shared bytes are those of the list; longer
   ones give a spanning forest: what a fingerprint is linked with leaves the list as it is compared.
4. Lists of over LIST fingerprints (only near copies make them, as all share four bytes) are not
   compared: of the fingerprints in them, those within MOST / 2 bits of one bit pattern are linked,
   and every link has such a pattern halfway. Of the patterns' fingerprints, at most 2,081, each is
   linked with the next one. That is exact and grows with the number of fingerprints, not its square.
5. Components of all links name the documents.

Defined cases: null texts and texts without words have fingerprint zero and are linked like any
other; fewer words than a shingle make one shingle; very long texts count whole; repeated doc_ids:
see common.texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

SEED = 42
#: Fingerprints of a list that are compared pair by pair; of a list that are compared at all.
FEW, LIST = 16, 1 << 15
#: Rows of the index in an Arrow batch: two numbers each.
ROWS = 1 << 16


def fingerprint(text: str | None, k: int) -> int:
    """Bits set in over half the hashes of the text's k-word shingles; A-Z are taken as a-z."""
    words = [w.lower() for w in c.split_words(text)]
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = (ends - [len(w) + 1 for w in words])[:n].tolist(), (ends[min(k, len(words)) - 1 :] - 1).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(flat[s:e], SEED) for s, e in zip(starts, ends, strict=True)), c.U64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t, k) for t in pdf["text"]], c.U64).view(np.int64)})

    return run


@cache
def masks(shared: int) -> list[int]:
    """Each choice of `shared` of the eight bytes, as a signed mask."""
    out = [sum(0xFF << 8 * i for i in chosen) for chosen in combinations(range(8), shared)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


@cache
def flips(most: int) -> list[int]:
    """Each choice of at most `most` of the 64 bits, as a signed mask."""
    out = [sum(1 << i for i in chosen) for k in range(most + 1) for chosen in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each of the eight bytes is shared, a row for each pair."""
    return (a ^ b).view(np.uint8).reshape(-1, 8) == 0


def pairs_of_lists(fp: np.ndarray, size: np.ndarray, start: np.ndarray, mask: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of all lists (places start, start + size of fp) at once, each in one list only."""
    left, right = [np.zeros(0, c.U64)], [np.zeros(0, c.U64)]
    own = np.repeat(mask, size).view(np.uint8).reshape(-1, 8) != 0  # the bytes of each row's list
    flat, room = np.concatenate([np.arange(s, s + n) for s, n in zip(start, size, strict=True)] or [np.zeros(0, np.int64)]), np.concatenate([np.arange(n - 1, -1, -1) for n in size] or [np.zeros(0, np.int64)])
    for step in range(1, int(size.max(initial=0))):
        at = np.flatnonzero(room >= step)
        a, b = fp[flat[at]], fp[flat[at + step]]
        same = tally(a, b)
        enough = same.sum(axis=1) >= 8 - most
        first = same & (np.cumsum(same, axis=1) <= 8 - most)
        keep = enough & (first == own[at]).all(axis=1) & (np.bitwise_count(a ^ b) <= most)
        left.append(a[keep])
        right.append(b[keep])
    return np.concatenate(left), np.concatenate(right)


def forest_of_list(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever a list's links join, one fewer than the members of each part."""
    left, right, rest = [np.zeros(0, c.U64)], [np.zeros(0, c.U64)], fp
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= most
            if near.any():
                left.append(rest[near])
                right.append(np.full(int(near.sum()), x))
                stack += list(rest[near])
                rest = rest[~near]
    return np.concatenate(left), np.concatenate(right)


def _lists(most: int, few: int, longest: int):
    """Over rows (mask, fp) sorted by list: links (a, b), and (a, null) for the members of lists
    that are too long. Of a list never more than `longest` rows and a batch are held."""

    def links(mask: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        key = fp & mask
        start = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
        size = np.diff(np.append(start, len(fp)))
        small = (size > 1) & (size <= few)
        found = [pairs_of_lists(fp, size[small], start[small], mask[start[small]], most)]
        found += [forest_of_list(fp[start[i] : start[i] + size[i]], most) for i in np.flatnonzero(size > few)]
        a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        return pd.DataFrame({"a": a.view(np.int64), "b": pd.array(b.view(np.int64), "Int64")})

    def alone(fp: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": fp.view(np.int64), "b": pd.array([pd.NA] * len(fp), "Int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask, fp, through = np.zeros(0, c.U64), np.zeros(0, c.U64), None  # through: the list whose rows go on as they come
        for pdf in batches:
            mask, fp = (np.concatenate((x, pdf[y].to_numpy().view(c.U64))) for x, y in ((mask, "mask"), (fp, "fp")))
            if not len(fp):
                continue
            if through is not None:
                on = (mask == through[0]) & (fp & mask == through[1])
                yield alone(fp[on])
                mask, fp = mask[~on], fp[~on]
                if not len(fp):
                    continue
                through = None
            key = fp & mask
            last = (mask == mask[-1]) & (key == key[-1])
            whole = ~last
            for i, n in long_lists(mask[whole], key[whole], longest):
                yield alone(fp[i : i + n])
                whole[i : i + n] = False
            if whole.any():
                yield links(mask[whole], fp[whole])
            if last.sum() > longest:
                yield alone(fp[last])
                through = mask[-1], key[-1]
                last[:] = False
            mask, fp = mask[last], fp[last]
        if len(fp):
            yield links(mask, fp)

    return run


def long_lists(mask: np.ndarray, key: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """Place and size of each list of over `longest` rows."""
    if not len(key):
        return []
    start = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
    size = np.diff(np.append(start, len(key)))
    return [(int(start[i]), int(size[i])) for i in np.flatnonzero(size > longest)]


def halfway(fps: DataFrame, most: int) -> DataFrame:
    """Links (a, b) among fingerprints `fp`: each is dealt to all patterns within most / 2 bits, and
    the fingerprints of a pattern, all within `most` of one another, are chained."""
    near = fps.select("fp", F.explode(F.array(*map(F.lit, flips(most // 2))).cast("array<long>")).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("pattern"))
    chained = near.withColumn("b", F.lag("fp").over(Window.partitionBy("pattern").orderBy("fp")))
    return chained.where("b IS NOT NULL").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, most: int) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp`, enough of them to join whatever is linked."""
    spark = fps.sparkSession
    index = fps.select(F.explode(F.array(*map(F.lit, masks(8 - most))).cast("array<long>")).alias("mask"), "fp")
    by_list = [F.col("mask"), F.col("fp").bitwiseAND(F.col("mask"))]
    index = index.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by_list).sortWithinPartitions(*by_list)
    with c.batch_rows(spark, ROWS):
        found = c.table(index.mapInPandas(c.freed(_lists(most, FEW, LIST)), "a long, b long"), "links")
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    direct = found.where("b IS NOT NULL")
    return direct if crowded.isEmpty() else direct.union(halfway(c.table(crowded, "crowded"), most))


def near_duplicates(documents: DataFrame, shingle: int = 5, most: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number), component_id: documents are linked whose
    fingerprints differ in `most` bits or fewer; component_id is the smallest doc_id reachable."""
    if most not in (0, 2, 4):
        raise ValueError("most is 0, 2 or 4")
    c.session(documents.sparkSession)
    profile = c.table(c.texts(documents).mapInPandas(c.freed(_fingerprints(shingle)), "doc_id long, fp long"), "fingerprints")
    reps = c.table(profile.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    roots = c.components(links(reps.select("fp"), most)).withColumnsRenamed({"id": "fp"})
    joined = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    named = c.table(joined.join(least, "root").select("fp", "component_id"), "named")
    return profile.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, shingle: int = 5, most: int = 4) -> DataFrame:
    """The documents whose doc_id is the smallest of their component."""
    documents = c.one_row(documents)
    return documents.join(near_duplicates(documents, shingle, most).where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")


def digest(documents: DataFrame) -> DataFrame:
    found = near_duplicates(documents, 4, 4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- the same in SQL: XXH64 from its definition, over the bytes' hexadecimal digits

#: Fixed values of the hash.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _sql() -> str:
    whole = 1 << 64
    plus = lambda a, b: f"(({a}::UHUGEINT + {b}::UHUGEINT) % {whole})::UBIGINT"
    times = lambda a, b: f"(({a}::UHUGEINT * {b}::UHUGEINT) % {whole})::UBIGINT"
    # a rotation is a product modulo 2^64 - 1
    turn = lambda a, n: f"(({a}::UHUGEINT * {1 << n}::UHUGEINT) % {whole - 1})::UBIGINT"
    number = lambda at, n: f"('0x' || {' || '.join(f'substr(b, 2 * ({at}) + {2 * k + 1}, 2)' for k in reversed(range(n)))})::UBIGINT"
    mixed = lambda acc, lane: times(turn(plus(acc, times(lane, _P2)), 31), _P1)
    fold = lambda acc, lane: plus(times(f"xor({acc}, {mixed('0', lane)})", _P1), _P4)
    lane = lambda k, start: f"list_reduce(range(n // 32), lambda a, i: {mixed('a', number(f'i * 32 + {8 * k}', 8))}, {start % whole}::UBIGINT)"
    four = ", ".join(f"CASE WHEN n >= 32 THEN {lane(k, s)} END AS v{k}" for k, s in enumerate((SEED + _P1 + _P2, SEED + _P2, SEED, SEED - _P1)))
    joined = plus(plus(turn("v0", 1), turn("v1", 7)), plus(turn("v2", 12), turn("v3", 18)))
    eights = f"list_reduce(range(n % 32 // 8), lambda a, i: {plus(times(turn(f'xor(a, {mixed("0", number("n // 32 * 32 + i * 8", 8))})', 27), _P1), _P4)}, h)"
    fours = f"list_reduce(range(n % 8 // 4), lambda a, i: {plus(times(turn(f'xor(a, {times(number("n // 8 * 8", 4), _P1)})', 23), _P2), _P3)}, h)"
    ones = f"list_reduce(range(n % 4), lambda a, i: {times(turn(f'xor(a, {times(number("n // 4 * 4 + i", 1), _P5)})', 11), _P1)}, h)"
    bits = ", ".join(f"sum((h >> {i}) & 1) AS s{i}" for i in range(64))
    set_bits = " + ".join(f"CASE WHEN 2 * s{i} > n THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
g AS (SELECT DISTINCT g, hex(encode(g)) AS b, octet_length(encode(g)) AS n FROM s),
x0 AS (SELECT g, b, n, {four} FROM g),
x1 AS (SELECT g, b, n, v0, v1, v2, v3, CASE WHEN n >= 32 THEN {joined} END AS h FROM x0),
x2 AS (SELECT g, b, n, v1, v2, v3, {fold('h', 'v0')} AS h FROM x1), x3 AS (SELECT g, b, n, v2, v3, {fold('h', 'v1')} AS h FROM x2), x4 AS (SELECT g, b, n, v3, {fold('h', 'v2')} AS h FROM x3),
x5 AS (SELECT g, b, n, {plus(f"coalesce({fold('h', 'v3')}, {SEED + _P5}::UBIGINT)", 'n')} AS h FROM x4),
x6 AS (SELECT g, b, n, {eights} AS h FROM x5), x7 AS (SELECT g, b, n, {fours} AS h FROM x6), x8 AS (SELECT g, {ones} AS h FROM x7),
x9 AS (SELECT g, {times('xor(h, h >> 33)', _P2)} AS h FROM x8), x10 AS (SELECT g, {times('xor(h, h >> 29)', _P3)} AS h FROM x9), x11 AS (SELECT g, xor(h, h >> 32) AS h FROM x10),
c AS (SELECT doc_id, count(*) AS n, {bits} FROM s JOIN x11 USING (g) GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(p.f, 0::UBIGINT) AS f FROM d LEFT JOIN (SELECT doc_id, {set_bits} AS f FROM c) p USING (doc_id)),
u AS (SELECT f, min(doc_id) AS id FROM f GROUP BY f),
near AS (SELECT a.f AS a, b.f AS b FROM u a JOIN u b ON a.f <> b.f AND bit_count(xor(a.f, b.f)) <= 4),
reach(f, other) AS (SELECT f, f FROM u UNION SELECT r.f, near.b FROM reach r JOIN near ON near.a = r.other),
least AS (SELECT r.f, min(u.id) AS id FROM reach r JOIN u ON u.f = r.other GROUP BY r.f)
SELECT f.doc_id, printf('%016x', f.f) AS fingerprint, least.id AS component_id FROM f JOIN least USING (f)
"""


SQL = _sql()
