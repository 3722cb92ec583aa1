"""Benchmark decontamination by greedy string tiling.

Words of documents and test items share seeds: runs of `seed` words. A word is a run of letters,
marks and digits in lower case; all else stands between words. Of scripts without spaces, each letter
of Chinese and Japanese is a word, and runs of Thai, Lao, Khmer and Burmese are cut between two
letters by a hash of these two, every fourth time, so a passage is cut alike wherever it stands.
Pairs that share seeds are tiled: running Karp-Rabin finds the longest common runs of words
not marked yet, from long to short, and marks them in both until none of `seed` words is left. The
share of an item's words under tiles is its coverage in the document; tiles may stand in any order,
so reordered passages count.

The items' seeds are broadcast while the items' word codes (eight bytes a word, counted where they
are made) are at most BROADCAST_BYTES; beyond that, documents' and items' seeds are joined by shuffles.
Both ways an item's rarest seeds stand for it, as many as can't all be missed, and both give the same
rows.

Defined cases: null or wordless texts and items match nothing; items shorter than a seed match by
their whole sequence; copies of an item (same text, other item_id) each give a row, and an
item_id with several texts one for each; repeated doc_ids:
see common.texts; very long texts are tiled whole; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

SEED, COVERAGE = 5, 0.5
BROADCAST_BYTES = 32 << 20
#: Length at which the search for tiles begins.
START = 20
CHUNK = 3_000_000
_SPACED = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
PAIRS = "doc_id long, item_id long, n_words long, covered long, n_tiles long"


#: Beyond ASCII, all of the Latin letters up to U+024F: texts of only these are split as bytes.
_OTHERS = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
_LETTERS, _RUNS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}", r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_WORD = regex.compile(rf"(?V1)[[{_LETTERS}]&&\p{{L}}]\p{{M}}*|(?P<run>[[{_RUNS}]&&[\p{{L}}\p{{M}}]]+)|[[\p{{L}}\p{{N}}\p{{M}}]--[{_LETTERS}{_RUNS}]]+|[\p{{N}}\p{{M}}]+")
_LETTER = regex.compile(r"\p{L}\p{M}*|\p{M}+")


@lru_cache(1 << 16)
def _ends(pair: str) -> bool:
    return xxhash.xxh3_64_intdigest(pair) % 4 == 0


def _cut(run: str) -> list[str]:
    letters = _LETTER.findall(run)
    cuts = [0, *(k for k, (x, y) in enumerate(pairwise(letters), 1) if _ends(x + y)), len(letters)]
    return ["".join(letters[i:j]) for i, j in pairwise(cuts)]


def words(text: str | None) -> list[bytes]:
    if not isinstance(text, str):
        return []
    text = text.lower()
    if not _OTHERS.search(text):
        return text.encode().translate(_SPACED).split()
    return [w.encode() for m in _WORD.finditer(text) for w in (_cut(m[0]) if m["run"] else (m[0],))]


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in a, place in b, length) of two sequences of word codes."""
    out: list[tuple[int, int, int]] = []
    pa, pb = c.prefix_hash(a), c.prefix_hash(b)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)

    def open_windows(prefix: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[n:] == taken[:-n]) if n <= len(free) else np.zeros(0, np.int64)
        return at, c.rolling(prefix, n)[at]

    length = min(max(START, least), len(a), len(b))
    while length >= least:
        at_a, hash_a = open_windows(pa, free_a, length)
        at_b, hash_b = open_windows(pb, free_b, length)
        places: dict[int, list[int]] = {}
        for h, j in zip(hash_b.tolist(), at_b.tolist(), strict=True):
            places.setdefault(h, []).append(j)
        found, longest = [], 0
        common = np.isin(hash_a, hash_b)
        for h, i in zip(hash_a[common].tolist(), at_a[common].tolist(), strict=True):
            for j in places[h]:
                if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                    continue  # the match that begins before holds this one
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n >= length:
                    found.append((n, i, j))
                    longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        again = False
        for n, i, j in sorted(found, key=lambda x: (-x[0], x[2], x[1])):
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = free_b[j : j + n] = False
                out.append((i, j, n))
            else:
                again = True  # what is left of it may still be long enough
        if not again:
            length = length // 2 if length > 2 * least else least if length > least else 0
    return out


def _tiled(doc: np.ndarray, item: np.ndarray, seed: int, coverage: float) -> tuple[int, int] | None:
    found = tiles(doc, item, min(seed, len(item)))
    covered = sum(n for *_, n in found)
    return (covered, len(found)) if covered >= coverage * len(item) else None


def _need(n_words: np.ndarray | int, seed: int, coverage: float):
    """How many seed places a document must share with an item: a tile of n words has n - seed + 1
    of them, so k shared places cover at most k * seed words."""
    return np.maximum(1, np.ceil(coverage * n_words / seed - 1e-9)).astype(np.int64)


class Seeds:
    """Items by the hashes of their rarest seeds: of P places, P - need + 1 can't all be missed.
    Everything is arrays of a size in proportion to the items' words."""

    def __init__(self, items: list[tuple[int, np.ndarray]], seed: int, coverage: float):
        self.items, self.seed = items, seed
        sizes = np.array([len(x) for _, x in items], np.int64)
        self.need = _need(sizes, seed, coverage)
        flat = np.concatenate([x for _, x in items]) if items else np.zeros(0, c.U64)
        owner = np.repeat(np.arange(len(items), dtype=np.int32), sizes)
        h = c.rolling(c.prefix_hash(flat), seed)
        inside = owner[: len(h)] == owner[len(flat) - len(h) :]  # else a seed of two items
        h, owner = h[inside], owner[: len(h)][inside]
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.flatnonzero((h != np.roll(h, 1)) | (owner != np.roll(owner, 1))) if len(h) > 1 else np.arange(len(h))
        places, h, owner = np.diff(new, append=len(h)), h[new], owner[new]
        known, back, items_of = np.unique(h, return_inverse=True, return_counts=True)
        order = np.lexsort((h, items_of[back], owner))
        h, owner, places = h[order], owner[order], places[order]
        total = np.cumsum(places) - places
        first = np.searchsorted(owner, np.arange(len(items)))
        before = total - total[np.minimum(first, max(len(total) - 1, 0))][owner] if len(total) else total
        kept = before <= (sizes - seed + 1 - self.need)[owner]
        h, owner = h[kept], owner[kept]
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner = h[order], owner[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(c.mix(self.hashes) & c.U64(self.bits.size - 1)).astype(np.int64)] = True
        self.short = {}
        for n in np.unique(sizes[(sizes < seed) & (sizes > 0)]).tolist():
            at = np.flatnonzero(sizes == n)
            whole = np.array([c.prefix_hash(items[k][1])[n] for k in at], c.U64)
            order = np.argsort(whole, kind="stable")
            self.short[n] = whole[order], at[order]

    def hits(self, prefix: np.ndarray) -> np.ndarray:
        """Places in a sequence where a seed stands that stands for some item."""
        h = c.rolling(prefix, self.seed)
        at = np.flatnonzero(self.bits[(c.mix(h) & c.U64(self.bits.size - 1)).astype(np.int64)])
        return at[np.isin(h[at], self.hashes)]

    def candidates(self, codes: np.ndarray, at: np.ndarray) -> list[int]:
        prefix, found = c.prefix_hash(codes), []
        if len(at):
            own = np.unique(c.rolling(prefix, self.seed))
            lo, hi = (np.searchsorted(self.hashes, own[np.isin(own, self.hashes)], side) for side in ("left", "right"))
            for i in np.unique(np.concatenate([self.owner[x:y] for x, y in zip(lo, hi, strict=True)])).tolist():
                if np.isin(c.rolling(c.prefix_hash(self.items[i][1]), self.seed), own).sum() >= self.need[i]:
                    found.append(i)
        for n, (whole, owner) in self.short.items():
            found += owner[np.isin(whole, c.rolling(prefix, n))].tolist()
        return sorted(found)


def _coded(texts: list[str | None]) -> list[np.ndarray]:
    split = [words(t) for t in texts]
    flat, end = c.word_codes([w for ws in split for w in ws]), np.cumsum([len(ws) for ws in split])
    return np.split(flat, end[:-1]) if len(split) else []


def _scan(held, coverage: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds: Seeds = held.value
        for pdf in batches:
            sizes = [len(t) if isinstance(t, str) else 0 for t in pdf["text"]]
            for lo, hi in c.chunks(sizes, CHUNK):
                coded, out = _coded(pdf["text"].iloc[lo:hi].tolist()), []
                flat = np.concatenate(coded) if coded else np.zeros(0, c.U64)
                places = seeds.hits(c.prefix_hash(flat))
                begin = np.cumsum([0] + [len(x) for x in coded])
                cut = np.searchsorted(places, begin)
                for k, doc_id in enumerate(pdf["doc_id"].iloc[lo:hi].tolist()):
                    at = places[cut[k] : cut[k + 1]] - begin[k]
                    at = at[at + seeds.seed <= len(coded[k])]
                    if len(at) or seeds.short:
                        for i in seeds.candidates(coded[k], at):
                            item_id, item = seeds.items[i]
                            if got := _tiled(coded[k], item, seeds.seed, coverage):
                                out.append((doc_id, item_id, len(item), *got))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "covered", "n_tiles"])

    return run


def _item_seeds(seed: int, coverage: float):
    """Distinct seeds of each item with the places where they stand, and how many places more than
    needed it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, codes in zip(pdf["item"], _coded(pdf["text"].tolist()), strict=True):
                if n := min(seed, len(codes)):
                    h, places = np.unique(c.mix(c.rolling(c.prefix_hash(codes), n) + c.U64(n)), return_counts=True)
                    need = int(_need(len(codes), n, coverage))
                    yield pd.DataFrame({"hash": c.signed(h), "item": item, "size": n, "places": places, "spare": len(codes) - n + 1 - need})

    return run


def _item_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"item_id": pdf["item_id"], "codes": [x.tobytes() for x in _coded(pdf["text"].tolist())]})


def _doc_seeds(sizes: list[int]):
    """Distinct seeds of each document, of the lengths that items have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, codes in zip(pdf["doc_id"], _coded(pdf["text"].tolist()), strict=True):
                prefix = c.prefix_hash(codes)
                h = np.unique(np.concatenate([c.mix(c.rolling(prefix, n) + c.U64(n)) for n in sizes])) if sizes else np.zeros(0, c.U64)
                yield pd.DataFrame({"hash": c.signed(h), "doc_id": doc_id})

    return run


def _tile_rows(seed: int, coverage: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, item_id, text, item in zip(pdf["doc_id"], pdf["item_id"], pdf["text"], pdf["item_text"], strict=True):
                a, b = _coded([text, item])
                if got := _tiled(a, b, seed, coverage):
                    out.append((doc_id, item_id, len(b), *got))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "covered", "n_tiles"])

    return run


def _candidates(docs: DataFrame, items: DataFrame, coverage: float, seed: int) -> DataFrame:
    """Pairs (doc_id, item) that may reach the coverage. Of an item's P seed places a document shares
    `need` or misses fewer than P - need + 1, so one of any P - need + 1 places must be shared: the
    rarest ones stand for the item, and seeds that many documents hold are joined only for items
    that have nothing else. What is joined with many rows a key is written first, so that adaptive
    execution can split hot seeds."""
    seeds = c.table(items.select("item", "text").mapInPandas(c.freed(_item_seeds(seed, coverage)), "hash long, item long, size int, places int, spare int"), "item-seeds")
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # at most `seed` numbers
    known = c.table(seeds.select("hash").distinct(), "known-seeds")
    met = c.table(docs.mapInPandas(c.freed(_doc_seeds(sizes)), "hash long, doc_id long").join(known, "hash", "left_semi"), "met")
    common = c.table(met.groupBy("hash").count(), "seed-counts")
    rare = Window.partitionBy("item").orderBy("count", "hash").rowsBetween(Window.unboundedPreceding, -1)
    kept = seeds.join(common, "hash").withColumn("_missing", F.sum("places").over(Window.partitionBy("item")))
    all_places = seeds.groupBy("item").agg(F.sum("places").alias("_all"))
    # places whose seed no document holds are missed for certain: they come first
    kept = kept.join(all_places, "item").withColumn("_before", F.col("_all") - F.col("_missing") + F.coalesce(F.sum("places").over(rare), F.lit(0))).where("_before <= spare")
    return met.join(c.table(kept.select("hash", "item"), "kept-seeds"), "hash").select("doc_id", "item").distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, n_words, covered, n_tiles, coverage of every pair whose coverage is at least
    `coverage`."""
    spark = c.session(documents.sparkSession)
    docs = c.texts(documents)
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    coded = c.table(items.mapInPandas(c.freed(_item_codes), "item_id long, codes binary"), "item-codes")
    size = coded.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    if size <= broadcast_bytes:
        known = [(r.item_id, np.frombuffer(r.codes, c.U64)) for r in coded.collect() if r.codes]
        pairs = docs.mapInPandas(c.freed(_scan(spark.sparkContext.broadcast(Seeds(known, seed, coverage)), coverage)), PAIRS)
    else:
        items = c.table(items.withColumn("item", F.xxhash64("item_id", "text")), "items")
        pairs = _candidates(docs, items, coverage, seed).join(docs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item").mapInPandas(c.freed(_tile_rows(seed, coverage)), PAIRS)
    return pairs.withColumn("coverage", F.col("covered") / F.col("n_words"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without those that hold a test item."""
    documents = c.one_row(documents)
    return documents.join(contaminated(documents, benchmark, **how).select("doc_id").distinct(), "doc_id", "left_anti")
