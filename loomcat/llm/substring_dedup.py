"""Passages that recur across documents, found by repeated-phrase automata.

0. Of documents with the same words only the smallest doc_id goes on: the others, if they have a
   window at all, lose every word, and whatever they share with later documents their first copy
   shares as well.
1. Confirm recurring passages. Every window of `window` words is named by its anchor, the least
   hash among its short word-grams; only windows whose anchor occurs in two documents are hashed
   and counted. A window that starts in two documents has a first document, the smallest doc_id.
   Neighbouring windows of one anchor in their first document form a passage. Where else a window
   stands is not known from this.
2. Compile the passages into Aho-Corasick automata (pyahocorasick), in shards of bounded size by
   anchor. A symbol stands for PIECE words, so a window of 50 words is a path of five symbols, each
   of three letters of a small alphabet (the library looks through a node's branches one by one).
3. Stream every document through the automata of its anchors: the stretch of text around an anchor
   that two documents have goes to that anchor's shard, in PIECE interleaved streams. Each match is
   checked on its words; where the matched window's first document is smaller, its words go.

Each stretch goes to one shard, so the texts shipped don't grow with the number of shards. An anchor
with more windows than a shard holds is split by window: its windows are shipped one by one, under
their own hashes. Streams of one shard are dealt over salts. No task holds more than one shard's
automaton and a batch of stretches.

Defined cases: null text has no words; a document of fewer words than the window loses nothing; a
window that recurs only within one document stays; very long texts are handled whole; repeated
doc_ids: see common.texts; an empty table gives an empty result; other columns of the input are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WINDOW = 50
GRAM = 16
#: Words of a node at most; windows of one shard; stretches of text that one task streams through it.
PIECE, SHARD_WINDOWS, SALT_ROWS = 10, 100_000, 60_000
#: Anchors split by window, which every task must know.
MOST_SPLIT = 2_000_000
#: Words that a task holds as arrays at a time.
CHUNK = 1_000_000


def _profile(window: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [len(t) if isinstance(t, str) else 0 for t in pdf["text"]]
            for lo, hi in c.chunks(sizes, 6 * CHUNK):
                words = [c.split_words(t) for t in pdf["text"].iloc[lo:hi]]
                codes = c.word_codes([w for ws in words for w in ws])
                at, out = 0, []
                for doc_id, ws in zip(pdf["doc_id"].iloc[lo:hi], words, strict=True):
                    anchors, starts, counts = c.window_runs(codes[at : at + len(ws)], window, gram)
                    at += len(ws)
                    out.append((doc_id, len(ws), hashlib.sha256(b" ".join(ws)).hexdigest(), c.signed(anchors), starts.astype(np.int32), counts.astype(np.int32)))
                yield pd.DataFrame(out, columns=["doc_id", "n_words", "words_sha256", "anchors", "starts", "counts"])

    return run


def _chunked(pdf: pd.DataFrame, most: int) -> Iterator[tuple[pd.DataFrame, list[list[bytes]], np.ndarray, np.ndarray]]:
    """Rows of about `most` words together: the rows, their words, all words' codes, and where each
    row's words begin in them."""
    for lo, hi in c.chunks([len(t) for t in pdf["text"]], 6 * most):
        part = pdf.iloc[lo:hi]
        split = [t.split() if isinstance(t, bytes) else c.split_words(t) for t in part["text"]]
        yield part, split, c.word_codes([w for ws in split for w in ws]), np.cumsum([0, *map(len, split)])


def _windows(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, _, codes, begin in _chunked(pdf, CHUNK):
                h = c.signed(c.mix(c.rolling(c.prefix_hash(codes), window)))
                doc_ids, places = [], []
                for doc_id, runs, at in zip(part["doc_id"], part["runs"], begin[:-1], strict=True):
                    own = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs])
                    doc_ids.append(np.full(len(own), doc_id, np.int64))
                    places.append((own, own + at))
                flat = np.concatenate([x for _, x in places])
                yield pd.DataFrame({"doc_id": np.concatenate(doc_ids), "hash": h[flat], "at": np.concatenate([x for x, _ in places]).astype(np.int32)})

    return run


def _phrases(window: int):
    """The recurring passages of their first documents, one anchor each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, runs, ats in zip(pdf["doc_id"], pdf["text"], pdf["runs"], pdf["ats"], strict=True):
                ws, ats = c.split_words(text), np.sort(np.asarray(ats, np.int64))
                for r in runs:
                    own = ats[np.searchsorted(ats, r["start"]) : np.searchsorted(ats, r["start"] + r["n"])]
                    for part in np.split(own, np.flatnonzero(np.diff(own) != 1) + 1):
                        if len(part):
                            out.append((r["anchor"], doc_id, len(part), b" ".join(ws[part[0] : part[-1] + window])))
            yield pd.DataFrame(out, columns=["anchor", "doc_id", "n", "text"])

    return run


def _single(codes: np.ndarray, window: int) -> np.ndarray:
    return c.signed(c.mix(c.rolling(c.prefix_hash(codes), window) ^ c.U64(c.BASE)))


def _keyed(window: int, split):
    """Passages under the key of their shard: the anchor, or each window by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            by_window = np.isin(pdf["anchor"].to_numpy(), split.value)
            whole = pdf[~by_window]
            yield pd.DataFrame({"key": whole["anchor"], "doc_id": whole["doc_id"], "at": 0, "n": whole["n"], "text": whole["text"]})
            for part, words, codes, begin in _chunked(pdf[by_window], CHUNK):
                out = []
                for doc_id, ws, at in zip(part["doc_id"], words, begin[:-1], strict=True):
                    keys = _single(codes[at : at + len(ws)], window)
                    out += [(k, doc_id, 0, 1, b" ".join(ws[i : i + window])) for i, k in enumerate(keys.tolist())]
                yield pd.DataFrame(out, columns=["key", "doc_id", "at", "n", "text"])

    return run


def _stretches(window: int, split):
    """What documents send to the shards of their anchors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, words, codes, begin in _chunked(pdf, CHUNK // 4):
                out = []
                for doc_id, runs, ws, at in zip(part["doc_id"], part["runs"], words, begin[:-1], strict=True):
                    by_window = np.isin(np.fromiter((r["anchor"] for r in runs), np.int64, len(runs)), split.value)
                    keys = _single(codes[at : at + len(ws)], window) if by_window.any() else None
                    for r, one in zip(runs, by_window, strict=True):
                        start, n = r["start"], r["n"]
                        if one:
                            out += [(int(keys[i]), doc_id, i, 1, b" ".join(ws[i : i + window])) for i in range(start, start + n)]
                        else:
                            out.append((r["anchor"], doc_id, start, n, b" ".join(ws[start : start + n + window - 1])))
                yield pd.DataFrame(out, columns=["key", "doc_id", "at", "n", "text"])

    return run


class Automata:
    """The windows of a shard's passages."""

    def __init__(self, phrases: list[bytes], firsts: list[int], window: int):
        self.window, self.piece = window, next(p for p in range(PIECE, 0, -1) if window % p == 0)
        split = [p.split() for p in phrases]
        self.codes = c.word_codes([w for ws in split for w in ws])
        begin = np.cumsum([0, *map(len, split)])[:-1]
        many = np.array([len(ws) - window + 1 for ws in split])
        self.place = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        self.first = np.repeat(np.array(firsts, np.int64), many)
        grams = c.rolling(c.prefix_hash(self.codes), self.piece)
        path = self.place[:, None] + self.piece * np.arange(window // self.piece)
        self.known, symbols = np.unique(grams[path], return_inverse=True)
        self.base = max(1, math.ceil(len(self.known) ** (1 / 3)))
        text, n = self._letters(symbols.reshape(-1)), 3 * path.shape[1]
        self.automaton = ahocorasick.Automaton()
        for i in range(len(path)):
            self.automaton.add_word(text[i * n : i * n + n], i)
        self.automaton.make_automaton()

    def _letters(self, symbols: np.ndarray) -> str:
        """Three letters for each symbol, from an alphabet for each of the three places; NULs for -1."""
        b = self.base
        out = np.stack([symbols // (b * b), symbols // b % b + b, symbols % b + 2 * b], axis=-1) + 1
        out[symbols < 0] = 0
        return (out + 0x800 * (out >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")

    def matches(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in codes (stretches that start at begin[:-1]) where a window stands, and its first
        document."""
        grams = c.rolling(c.prefix_hash(codes), self.piece)
        stretch = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[: len(grams)]
        place = np.arange(len(grams))
        inside = place + self.piece <= begin[stretch + 1]
        place, stretch = place[inside], stretch[inside]
        stream = stretch * self.piece + (place - begin[stretch]) % self.piece
        by = np.argsort(stream, kind="stable")
        place, stream = place[by], stream[by]
        to = np.arange(len(place)) + np.cumsum(np.concatenate(([0], stream[1:] != stream[:-1])))[: len(place)]  # a gap between streams
        near = np.minimum(np.searchsorted(self.known, grams[place]), len(self.known) - 1)
        hit = self.known[near] == grams[place]
        line, back = np.full(len(place) and to[-1] + 1, -1, np.int64), np.zeros(len(place) and to[-1] + 1, np.int64)
        line[to[hit]], back[to] = near[hit], place
        got = np.array(list(self.automaton.iter(self._letters(line))), np.int64).reshape(-1, 2)
        at, which = back[got[:, 0] // 3] - self.window + self.piece, got[:, 1]
        step = np.arange(self.window)
        same = np.zeros(len(at), bool)
        for lo in range(0, len(at), 50_000):
            i, j = at[lo : lo + 50_000], self.place[which[lo : lo + 50_000]]
            same[lo : lo + 50_000] = (codes[i[:, None] + step] == self.codes[j[:, None] + step]).all(axis=1)
        return at[same], self.first[which[same]]


def _locate(window: int):
    """Rows sorted by shard, salt, kind: the passages (kind 0), then the documents' stretches (1)."""

    def scan(rows: pd.DataFrame, automata: Automata) -> Iterator[pd.DataFrame]:
        for part, _, codes, begin in _chunked(rows, CHUNK // 4):
            at, first = automata.matches(codes, begin)
            row = np.searchsorted(begin, at, "right") - 1
            doc_id = part["doc_id"].to_numpy()[row]
            start = part["at"].to_numpy()[row] + at - begin[row]
            later = first < doc_id
            doc_id, start = doc_id[later], start[later]
            by = np.lexsort((start, doc_id))
            doc_id, start = doc_id[by], start[by]
            new = np.concatenate(([True], (doc_id[1:] != doc_id[:-1]) | (start[1:] > start[:-1] + window)))[: len(start)]
            end = start[np.concatenate((new[1:], [True]))[: len(start)]] + window
            yield pd.DataFrame({"doc_id": doc_id[new], "starts": start[new], "ends": end})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, phrases, firsts, automata = None, [], [], None
        for pdf in batches:
            for key, rows in pdf.groupby(["shard", "salt", "kind"], sort=False):
                if at != key[:2]:
                    at, phrases, firsts, automata = key[:2], [], [], None
                if not key[2]:
                    phrases += rows["text"].tolist()
                    firsts += rows["doc_id"].tolist()
                elif phrases:
                    automata = automata or Automata(phrases, firsts, window)
                    yield from scan(rows, automata)

    return run


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, text, found in zip(pdf["doc_id"], pdf["text"], pdf["found"], strict=True):
            ws = c.split_words(text)
            s, e = c.union_spans(*np.array([(f["starts"], f["ends"]) for f in found], np.int64).T)
            keep = np.ones(len(ws), bool)
            for i, j in zip(s, e, strict=True):
                keep[i:j] = False
            out.append((doc_id, int(len(ws) - keep.sum()), s, e, b" ".join([w for w, k in zip(ws, keep, strict=True) if k]).decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(out, columns=["doc_id", "n_removed", "starts", "ends", "kept_text"])


def find_passages(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Two tables. profile: doc_id, n_words, words_sha256 of every document. removals: doc_id,
    n_removed, starts and ends (of removed runs of words, half-open), kept_text of each document
    that holds a window of words which also starts in a document with a smaller doc_id."""
    spark = c.session(documents.sparkSession)
    docs = c.texts(documents)
    gram = min(gram, window)
    profile = c.table(docs.mapInPandas(c.freed(_profile(window, gram)), "doc_id long, n_words long, words_sha256 string, anchors array<long>, starts array<int>, counts array<int>"), "profile")
    firsts = c.table(profile.where(F.col("n_words") >= window).groupBy("words_sha256").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("words_sha256", "first"), "firsts")
    copies = c.table(profile.select("doc_id", "n_words", "words_sha256").join(firsts, "words_sha256").where("doc_id > first").select("doc_id", "n_words"), "copies")
    # what is joined with many rows a key is written first: adaptive execution splits hot keys of a
    # join only where both sides are plain exchanges
    runs = profile.select("doc_id", "anchors", "starts", "counts").join(copies, "doc_id", "left_anti").select("doc_id", F.explode(F.arrays_zip("anchors", "starts", "counts")).alias("r"))
    runs = c.table(runs.select("doc_id", F.col("r.anchors").alias("anchor"), F.col("r.starts").alias("start"), F.col("r.counts").alias("n")), "runs")
    recurring = c.table(runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "recurring")
    wanted = runs.join(recurring, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("runs"))
    work = c.table(docs.join(wanted, "doc_id"), "work")
    windows = work.mapInPandas(c.freed(_windows(window)), "doc_id long, hash long, at int")
    confirmed = windows.groupBy("hash").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").select("first.*")
    ats = confirmed.groupBy("doc_id").agg(F.collect_list("at").alias("ats"))
    phrases = c.table(work.join(ats, "doc_id").mapInPandas(c.freed(_phrases(window)), "anchor long, doc_id long, n int, text binary"), "passages")
    sizes = c.table(phrases.groupBy("anchor").agg(F.sum("n").alias("n")), "anchor-sizes")
    total, most = sizes.agg(F.sum("n")).first()[0] or 0, SHARD_WINDOWS
    while sizes.where(F.col("n") > most).count() > MOST_SPLIT:
        most *= 2
    split = spark.sparkContext.broadcast(np.array([r.anchor for r in sizes.where(F.col("n") > most).select("anchor").collect()], np.int64))
    shards = max(1, -(-total // SHARD_WINDOWS))
    kinds = "key long, doc_id long, at int, n int, text binary"
    shard = F.pmod(F.col("key"), F.lit(shards)).cast("int")
    patterns = phrases.mapInPandas(c.freed(_keyed(window, split)), kinds).withColumn("shard", shard)
    # only stretches whose anchor has a passage can hold one
    alive = runs.join(sizes.select("anchor"), "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("runs"))
    stretches = c.table(work.select("doc_id", "text").join(alive, "doc_id").mapInPandas(c.freed(_stretches(window, split)), kinds).withColumn("shard", shard), "stretches")
    salts = c.table(stretches.groupBy("shard").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")), "salts")
    a = patterns.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "doc_id", "at", "text")
    b = stretches.join(salts, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "at", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = a.unionByName(b).repartition(max(parts, shards), "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInPandas(c.freed(_locate(window)), "doc_id long, starts long, ends long")
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("starts", "ends")).alias("found"))
    cut = work.select("doc_id", "text").join(spans, "doc_id").mapInPandas(c.freed(_kept), "doc_id long, n_removed long, starts array<long>, ends array<long>, kept_text string")
    whole = copies.select("doc_id", F.col("n_words").alias("n_removed"), F.array(F.lit(0).cast("long")).alias("starts"), F.array("n_words").alias("ends"), F.lit("").alias("kept_text"))
    removals = c.table(cut.unionByName(whole), "removals")
    return profile.select("doc_id", "n_words", "words_sha256"), removals


def drop_passages(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents with recurring passages removed from text; texts without any stay as they are."""
    documents = c.one_row(documents)
    _, removals = find_passages(documents, window)
    kept = removals.select("doc_id", F.struct("kept_text").alias("_removal"))
    text = F.when(F.col("_removal").isNotNull(), F.col("_removal.kept_text")).otherwise(F.col("text"))
    return documents.join(kept, "doc_id", "left").withColumn("text", text).select(*documents.columns)


def digest(documents: DataFrame) -> DataFrame:
    profile, removals = find_passages(documents)
    removed = removals.select("doc_id", "n_removed", F.sha2("kept_text", 256).alias("sha"))
    return profile.join(removed, "doc_id", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "words_sha256").alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) t(i)),
f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
cut AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN f USING (h) WHERE first < doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ks, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
