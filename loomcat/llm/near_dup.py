"""Near-duplicate documents by b-bit MinHash.

1. Each document's set of distinct word shingles gets `MINIMA` minima. Documents with equal sets
   collapse to the one with the smallest doc_id.
2. Bands of minima generate candidates: documents that agree in all rows of a band share a bucket.
   Of each minimum BITS low bits are kept, packed into a signature; bit counts of two signatures,
   corrected for chance collisions, estimate the similarity and drop hopeless candidates. The
   margin is 4.5 standard errors, and every link is then confirmed on the full sets.
3. Links are found without emitting all pairs of a bucket: first each document against the best of
   its buckets' least documents; components of these links; then, of buckets that still hold several
   components, each document's best candidates in other components; and last every remaining
   candidate pair that would join two components, confirmed where it is found. Large buckets are
   compared block by block.

With r rows a band and b bands a link at similarity s is missed with probability (1 - s^r)^b: 7e-9
at 0.85 (5 rows, 32 bands) and 7e-10 at 0.8 (4 rows, 40 bands). For other thresholds r is the largest
for which this is MISSED or less; below 0.11 there is none, and ValueError is raised.

Defined cases: very long texts count whole; null texts and texts without words have the empty set and are linked with nothing;
fewer words than a shingle make one shingle; repeated doc_ids: see common.texts; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

MINIMA, BITS = 160, 4
#: Probability with which the bands may miss a link at the threshold.
MISSED = 1e-8
#: Documents of a bucket, and their shingles, that one task compares with as many others.
BLOCK, WORDS = 1024, 1_000_000
_MULTIPLIERS = (c.mix(np.arange(1, MINIMA + 1, dtype=c.U64)) >> c.U64(32)).astype(np.uint32) | np.uint32(1)
#: Equal 4-bit groups of two bytes, by their exclusive or.
_EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z taken as a-z."""
    codes = c.word_codes([w.lower() for w in c.split_words(text)])
    if not len(codes):
        return codes
    return np.unique(c.mix(c.rolling(c.prefix_hash(codes), min(k, len(codes)))))


def minima(shingles: np.ndarray) -> np.ndarray:
    x, least = (shingles >> c.U64(32)).astype(np.uint32), np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * x[None, i : i + 1024]).min(axis=1))
    return least


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    bands = least[: MINIMA // rows * rows].reshape(-1, rows).astype(c.U64)
    key = np.arange(1, len(bands) + 1, dtype=c.U64)
    for i in range(rows):
        key = c.mix(key + bands[:, i] * c.U64(c.BASE))
    return key


def packed(least: np.ndarray) -> bytes:
    """BITS low bits of each (scrambled) minimum."""
    low = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)
    return (low[::2] | low[1::2] << 4).tobytes()


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of signatures (rows of bytes), corrected for minima that agree by chance."""
    chance = 2.0**-BITS
    return (_EQUAL[a ^ b].sum(axis=-1) / MINIMA - chance) / (1 - chance)


def band_rows(threshold: float) -> int:
    """Minima of a band."""
    rows = [r for r in range(1, 11) if (1 - threshold**r) ** (MINIMA // r) <= MISSED]
    if not rows:
        raise ValueError(f"{MINIMA} minima are too few for links at a similarity of {threshold:g}")
    return max(rows)


def least_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    p = threshold * (1 - chance) + chance
    return threshold - 4.5 * math.sqrt(p * (1 - p) / MINIMA) / (1 - chance)


def _signatures(k: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingle_set(text, k)
                if len(s):
                    least = minima(s)
                    out.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), c.signed(band_keys(least, rows)).tobytes(), packed(least)))
                else:
                    out.append((doc_id, 0, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n", "set_key", "bands", "sig"])

    return run


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            keys = np.frombuffer(b"".join(pdf["bands"]), np.int64).reshape(len(pdf), -1)
            yield pd.DataFrame({"key": keys.ravel(), "band": np.tile(np.arange(keys.shape[1], dtype=np.int32), len(pdf)), "id": np.repeat(pdf["id"].to_numpy(), keys.shape[1])})


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["doc_id"], "words": [shingle_set(t, k).tobytes() for t in pdf["text"]]})

    return run


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    return pd.Series(estimated(*(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (a, b))))


def _linked(num: int, den: int):
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, c.U64), np.frombuffer(y, c.U64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(den * both >= num * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return run


def _grouped(work, frame):
    """mapInPandas over rows sorted by key, i, j: work gets the columns of one bucket's block pair
    and returns rows; a group is held whole, BLOCK documents or WORDS shingles on either side."""

    def groups(pdf: pd.DataFrame) -> list:
        key, i, j = (pdf[x].to_numpy() for x in ("key", "i", "j"))
        cols = {x: pdf[x].to_numpy() for x in pdf.columns}
        for x, kind in (("sig", np.uint8), ("bands", np.int64)):
            cols[x] = np.frombuffer(b"".join(pdf[x]), kind).reshape(len(pdf), -1)
        begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        out = []
        for s, t in zip(begin, [*begin[1:], len(pdf)], strict=True):
            if t - s > 1:
                out += work(**{x: v[s:t] for x, v in cols.items()})
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            same = np.ones(len(pdf), bool)  # rows of the batch's last group wait for the next batch
            for x in ("key", "i", "j"):
                same &= pdf[x].to_numpy() == pdf[x].iloc[-1]
            ends_same = bool(held) and all(held[-1][x].iloc[-1] == pdf[x].iloc[0] for x in ("key", "i", "j"))
            if same.all() and (ends_same or not held):
                held.append(pdf)
                continue
            yield pd.DataFrame(groups(pd.concat([*held, pdf[~same]])), columns=frame)
            held = [pdf[same]]
        if held:
            yield pd.DataFrame(groups(pd.concat(held)), columns=frame)

    return run


def _candidates(num: int, den: int, least: float, ids, comp, n, blk, band, i, j, sig, bands, both: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each document of block i its candidates in other components in block j, with estimates."""
    left, right = np.flatnonzero(blk == i[0]), np.flatnonzero(blk == j[0])
    for x in left:
        others = right[comp[right] != comp[x]]
        if i[0] == j[0] and not both:
            others = others[ids[others] > ids[x]]
        others = others[den * np.minimum(n[others], n[x]) >= num * np.maximum(n[others], n[x])]
        if len(others):
            e = estimated(sig[x], sig[others])
            others, e = others[e >= least], e[e >= least]
        if len(others):
            yield x, others, e


def _best(num: int, den: int, least: float, top: int):
    """Each document's best candidates in other components."""

    def work(id, comp, n, blk, band, i, j, sig, bands, key) -> list[tuple[int, int]]:
        out = []
        for x, others, e in _candidates(num, den, least, id, comp, n, blk, band, i, j, sig, bands, True):
            out += [(max(id[x], id[y]), min(id[x], id[y])) for y in others[np.argsort(-e, kind="stable")[:top]]]
        return out

    return _grouped(work, ["a", "b"])


def _open(num: int, den: int, least: float):
    """Buckets that still hold candidates in different components."""

    def work(id, comp, n, blk, band, i, j, sig, bands, key) -> list[tuple[int]]:
        return [(key[0],)] if next(_candidates(num, den, least, id, comp, n, blk, band, i, j, sig, bands, True), None) else []

    return _grouped(work, ["key"])


def _across(num: int, den: int, least: float):
    """Every candidate pair across components, looked at in the first band that both share and
    confirmed on the full sets here; one link for each document and other component."""

    def work(id, comp, n, blk, band, i, j, sig, bands, key, words) -> list[tuple[int, int]]:
        out = []
        for x, others, _ in _candidates(num, den, least, id, comp, n, blk, band, i, j, sig, bands, False):
            others = others[(bands[others] == bands[x]).argmax(axis=1) == band[x]]
            if not len(others):
                continue
            own, flat = np.frombuffer(words[x], c.U64), np.frombuffer(b"".join(words[others]), c.U64)
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            shared = np.add.reduceat(own[at] == flat, np.concatenate(([0], np.cumsum(n[others])[:-1])), dtype=np.int64)
            linked = others[den * shared >= num * (n[x] + n[others] - shared)]
            _, one = np.unique(comp[linked], return_index=True)
            out += [(max(id[x], id[y]), min(id[x], id[y])) for y in linked[one]]
        return out

    return _grouped(work, ["a", "b"])


def near_duplicates(documents: DataFrame, shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: documents are linked if den * |intersection| >= num *
    |union| of their shingle sets; component_id is the smallest doc_id reachable over links."""
    spark = c.session(documents.sparkSession)
    docs = c.texts(documents)
    rows, least = band_rows(num / den), least_estimate(num / den)
    profile = c.table(docs.mapInPandas(c.freed(_signatures(shingle, rows)), "doc_id long, n long, set_key binary, bands binary, sig binary"), "signatures")
    reps = c.table(profile.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "sets")
    buckets = reps.select("id", "bands").mapInPandas(c.freed(_buckets), "key long, band int, id long")
    buckets = c.table(buckets, "buckets")
    # what is joined with many rows a key is written first: adaptive execution splits hot keys of a
    # join only where both sides are plain exchanges
    shared = c.table(buckets.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", "hub"), "shared")
    met = c.table(buckets.join(shared, "key"), "met")
    sig = reps.select("id", "sig")
    stars = met.where("id <> hub").select("id", "hub").distinct().join(sig, "id").join(sig.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    stars = stars.select("id", "hub", _estimate("sig", "hub_sig").alias("e")).where(F.col("e") >= least).groupBy("id").agg(F.max_by("hub", F.struct("e", -F.col("hub"))).alias("hub"))
    known = c.table(docs.join(met.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInPandas(c.freed(_sets(shingle)), "id long, words binary"), "words")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = pairs.join(known.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(known.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
        return c.table(x.where(_linked(num, den)("x", "y")).select("a", "b"), "links")

    links = confirmed(stars.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    roots = c.components(links)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def split_buckets() -> DataFrame:
        """Rows of the buckets that hold several components, dealt into block pairs."""
        at = met.select("key", "band", "id").join(roots, "id", "left").join(reps, "id").withColumn("comp", F.coalesce("root", "id"))
        several = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / WORDS)).cast("int").alias("blocks")).where("lo < hi").select("key", "blocks")
        at = at.join(c.table(several, "several"), "key").withColumn("blk", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return at.select("key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "band", "id", "comp", "n", "sig", "bands", "blk")

    def by_block(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    best = by_block(split_buckets()).mapInPandas(c.freed(_best(num, den, least, 2)), "a long, b long")
    links = c.table(links.union(confirmed(best.distinct())), "links")
    roots = c.components(links)
    rows = c.table(split_buckets(), "split")
    left = by_block(rows).mapInPandas(c.freed(_open(num, den, least)), "key long").distinct()
    rest = by_block(rows.join(left, "key", "left_semi").join(known, "id")).mapInPandas(c.freed(_across(num, den, least)), "a long, b long")
    roots = c.components(links.union(c.table(rest, "links")))
    named = profile.join(reps.select("set_key", F.col("id").alias("rep")), "set_key", "left").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents whose doc_id is the smallest of their component."""
    documents = c.one_row(documents)
    found = near_duplicates(documents, shingle, num, den)
    return documents.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")


def digest(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents, 3, 85, 100).withColumn("kept", F.col("doc_id") == F.col("component_id"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, near.b FROM reach r JOIN near ON near.a = r.other)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
