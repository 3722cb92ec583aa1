"""Document quality by an interpolated modified Kneser-Ney model of character n-grams.

Per language, the n-grams of trusted texts are counted; continuation counts, discounts, back-off
weights and interpolated probabilities are grouped aggregates and joins of the count tables, sharded
by n-gram. How probabilities get to the documents depends on a count of the finished table:

- up to BROADCAST_ROWS rows, the packed table is broadcast, and each text is scored where it is read;
- beyond, documents are dealt into blocks of about BLOCK_BYTES by a hash of doc_id; a block asks for its distinct n-grams,
  those of all blocks are joined with the tables, and each block gets its own back. Neither a table
  nor a block's n-grams are then ever in one place. Both ways give the same figures.

A document has four figures: the mean surprisal of its characters in bits (perplexity is 2 to its
power), the highest mean surprisal of one of its words of LETTERS letters or more (without the
punctuation around it), the mean surprisal of the first characters of its words, which stand after
the end of another word, and the share of its words that repeat the word before. It is rejected if
one of them exceeds its language's quantile among trusted documents. Documents fall in two halves by a
hash of doc_id; each half is scored by the model of the other half's trusted documents, so that all
trusted documents train and all set the quantiles. Where all trusted documents of a language fall in
one half, the one with the least hash goes to the other, so two are enough for a model and a mean.
A language with under LEAST_TRUSTED of them has
the mean of its own plus the quantile, over all languages, of how far trusted documents lie from
their language's mean; where its own worst trusted document lies above that, this is the limit. A
language with fewer than two has no model; its documents are judged by their repeated words alone,
with the highest limit that a language has.

Defined cases: null and empty texts have no figures and are kept; null lang is a language of its
own; without any limit all documents are kept; very long texts are scored whole; other columns are ignored; repeated doc_ids: see common.texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

ORDER = 4
QUANTILE, PEAK_QUANTILE, LEAST_TRUSTED = 0.99, 0.995, 30
LETTERS = 4
#: A document's figures.
FIGURES = ("bits", "peak", "boundary", "repeated")
SCORES = "doc_id long, lang string, " + ", ".join(f"{k} double" for k in FIGURES)
#: Bytes of a block's texts, characters handled at a time.
BLOCK_BYTES, CHUNK = 16 << 20, 400_000
#: Trusted ids, rows of the finished table, and languages, that may be broadcast.
BROADCAST_IDS, BROADCAST_ROWS, BROADCAST_LANGS = 2_000_000, 3_000_000, 10_000
SLOTS = 1 << 19


class _Kinds:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        """1 for letters, 2 for white space, 3 for punctuation and other signs, 0 for digits."""
        if cls.table is None:
            cls.table = np.array([1 if chr(x).isalpha() else 2 if chr(x).isspace() else 3 * (not chr(x).isalnum()) for x in range(0x110000)], np.uint8)
        return cls.table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts joined with ORDER - 1 spaces before each, about CHUNK characters at a time: the joined
    text, each text's number and the place where it starts. A long text stands alone."""
    for lo, hi in c.chunks([len(t) for t in texts], CHUNK):
        sizes = np.array([len(t) + ORDER - 1 for t in texts[lo:hi]])
        yield "".join(" " * (ORDER - 1) + t for t in texts[lo:hi]), np.arange(lo, hi), np.cumsum(sizes) - sizes


def _grams(points: np.ndarray, n: int = ORDER) -> np.ndarray:
    return c.mix(c.rolling(c.prefix_hash(points.astype(c.U64) + c.U64(1)), n))


def _gram_starts(size: int, starts: np.ndarray) -> np.ndarray:
    """Places of the n-grams that end on a character of a text (not in the spaces before it)."""
    ok = np.ones(max(0, size - ORDER + 1), bool)
    for s in starts[1:]:
        ok[max(0, s - ORDER + 1) : s] = False
    return np.flatnonzero(ok)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, g in pdf.groupby("lang"):
            for text, _, starts in _pieces(g["text"].tolist()):
                at = _gram_starts(len(text), starts)
                h = _grams(_points(text))[at]
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": [text[i : i + ORDER] for i in at[first].tolist()], "c": n})


def _requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct n-grams of a block and language; the memory of those already asked for is a table of
    fixed size, so some are asked for twice."""
    seen: dict[str, np.ndarray] = {}
    block = None
    for pdf in batches:
        for (b, lang), g in pdf[pdf["text"].notna()].groupby(["block", "lang"], sort=False):
            if (b, lang) not in seen:
                if block != b and len(seen) > 8:
                    seen.clear()
                block = b
            known = seen.setdefault((b, lang), np.zeros(SLOTS, c.U64))
            for text, _, starts in _pieces(g["text"].tolist()):
                at = _gram_starts(len(text), starts)
                h = _grams(_points(text))[at]
                new = np.flatnonzero(known[(h & c.U64(SLOTS - 1)).astype(np.int64)] != h)
                h, first = np.unique(h[new], return_index=True)
                known[(h & c.U64(SLOTS - 1)).astype(np.int64)] = h
                yield pd.DataFrame({"block": b, "lang": lang, "gram": [text[i : i + ORDER] for i in at[new[first]].tolist()]})


class Table:
    """Surprisals by n-gram hash: open addressing in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask, self.keys, self.values = size - 1, np.zeros(size, c.U64), np.zeros(size, np.float32)
        slot, left = (keys & c.U64(self.mask)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = slot[left] + 1 & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are known."""
        slot = (keys & c.U64(self.mask)).astype(np.int64)
        held = self.keys[slot]
        out, known = self.values[slot], held == keys
        left = np.flatnonzero(~known & (held != 0))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            known[left[hit]] = True
            left = left[~hit & (held != 0)]
        return out, known


class Lookup:
    """Surprisals of whole n-grams, as a block got them."""

    def __init__(self, table: Table):
        self.table = table

    def bits(self, points: np.ndarray) -> np.ndarray:
        return self.table.get(_grams(points))[0].astype(float)


class Unknown:
    """No model: for what needs no surprisals."""

    def bits(self, points: np.ndarray) -> np.ndarray:
        return np.zeros(max(0, len(points) - ORDER + 1))


class Backoff:
    """Surprisals from the finished tables: a seen n-gram's own, else its context's back-off weight
    (none if the context is unseen) and the shorter n-gram's."""

    def __init__(self, own: dict[int, Table], back: dict[int, Table], start: float):
        self.own, self.back, self.start = own, back, start

    def bits(self, points: np.ndarray) -> np.ndarray:
        out, left = np.zeros(max(0, len(points) - ORDER + 1)), np.arange(max(0, len(points) - ORDER + 1))
        prefix = c.prefix_hash(points.astype(c.U64) + c.U64(1))
        down = c.powers(len(points) + 1)[1]

        def hashed(at: np.ndarray, n: int) -> np.ndarray:
            return c.mix((prefix[at + n] - prefix[at]) * down[at])

        for n in range(ORDER, 0, -1):
            at = left + ORDER - n
            value, known = self.own[n].get(hashed(at, n)) if n in self.own else (np.zeros(len(at)), np.zeros(len(at), bool))
            out[left[known]] += value[known]
            left, at = left[~known], at[~known]
            if n == 1:
                out[left] += self.start
            elif n - 1 in self.back and len(left):
                value, known = self.back[n - 1].get(hashed(at, n - 1))
                out[left[known]] += value[known]
        return out


def surprise(texts: list[str], model: Lookup | Backoff | Unknown) -> dict[str, np.ndarray]:
    """FIGURES of each text; NaN where there is nothing to take them from."""
    out = {k: np.full(len(texts), np.nan) for k in FIGURES}
    for text, who, starts in _pieces(texts):
        points = _points(text)
        bits = np.concatenate((np.zeros(ORDER - 1), model.bits(points)))
        kind = _Kinds.get()[points]
        for s in starts:
            bits[s : s + ORDER - 1] = 0
        total = np.concatenate(([0], np.cumsum(bits)))
        ends = np.concatenate((starts[1:], [len(text)]))
        n = ends - starts - ORDER + 1
        out["bits"][who] = np.where(n > 0, (total[ends] - total[starts]) / np.maximum(n, 1), np.nan)
        gap = kind == 2
        begin = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        end = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
        doc = np.searchsorted(starts, begin, "right") - 1
        words = np.bincount(doc, minlength=len(who))
        out["boundary"][who] = np.where(words > 0, np.bincount(doc, bits[begin], len(who)) / np.maximum(words, 1), np.nan)
        prefix = c.prefix_hash(points.astype(c.U64) + c.U64(1))
        code = (prefix[end] - prefix[begin]) * c.powers(len(points) + 1)[1][begin]
        again = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
        out["repeated"][who] = np.where(words > 1, np.bincount(doc[1:], again, len(who)) / np.maximum(words - 1, 1), np.nan)
        peak = np.where(n > 0, 0, np.nan)
        place = np.flatnonzero(kind == 1)
        letters = np.concatenate(([0], np.cumsum(kind == 1)))
        digits = np.concatenate(([0], np.cumsum(kind == 0)))
        count = letters[end] - letters[begin]
        some = (count >= LETTERS) & (digits[end] == digits[begin])
        doc, count, first, last = doc[some], count[some], place[letters[begin[some]]], place[letters[end[some]] - 1]
        word = count == last - first + 1
        doc, begin, end = doc[word], first[word], np.minimum(last[word] + 2, ends[doc[word]])
        np.maximum.at(peak, doc, (total[end] - total[begin]) / (end - begin))
        out["peak"][who] = peak
    return out


def _scored(docs: pd.DataFrame, models) -> pd.DataFrame:
    """doc_id, lang and FIGURES; NULL for texts without characters, and all but `repeated` for
    languages without a model."""
    out = []
    for lang, g in docs.groupby("lang"):
        model = models(lang)
        got = surprise([t if isinstance(t, str) else "" for t in g["text"]], model or Unknown())
        if model is None:
            got |= {k: np.full(len(g), np.nan) for k in FIGURES if k != "repeated"}
        out.append(pd.DataFrame({"doc_id": g["doc_id"], "lang": lang, **got}))
    got = pd.concat(out) if out else pd.DataFrame({k: [] for k in ("doc_id", "lang", *FIGURES)})
    return got.assign(**{k: got[k].astype("Float64").where(got[k].notna(), pd.NA) for k in FIGURES})


def _block_scores(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    def models(lang: str) -> Lookup | None:
        known = answers[answers["lang"] == lang]
        if not len(known):
            return None
        return Lookup(Table(c.mix(_hash_rows(_points("".join(known["gram"])).reshape(-1, ORDER))), known["bits"].to_numpy(np.float32)))

    return _scored(docs, models)


def _hash_rows(points: np.ndarray) -> np.ndarray:
    """The rolling hash of each row."""
    up = c.powers(points.shape[1])[0]
    return ((points.astype(c.U64) + c.U64(1)) * up).sum(axis=1, dtype=c.U64)


def model(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From counts (lang, gram of ORDER characters, c): weights (lang, key, own, back), where a seen
    n-gram has its discounted probability `own` and a seen context its back-off weight `back`; and
    uniform (lang, start): the probability that an unseen character starts from."""
    spark = counts.sparkSession
    parts, level = [], counts
    for n in range(ORDER, 0, -1):
        size = level.groupBy("lang").agg(*(F.greatest(F.count_if(F.col("c") == k), F.lit(1)).alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        drop = [F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(float(k))).alias(f"d{k}") for k in (1, 2, 3)]
        each = level.join(F.broadcast(size.select("lang", *drop)), "lang")
        each = each.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("context", F.substring("gram", 1, n - 1))
        context = each.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("free"))
        parts += [
            each.join(context, ["lang", "context"]).select("lang", F.col("gram").alias("key"), ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), F.lit(None).cast("double").alias("back")),
            context.select("lang", F.col("context").alias("key"), F.lit(None).cast("double"), F.col("free") / F.col("total")),
        ]
        if n == 1:
            uniform = level.groupBy("lang").agg((F.lit(1.0) / (F.count("*") + 1)).alias("chance"))
        else:
            level = c.table(level.groupBy("lang", F.substring("gram", 2, n - 1).alias("gram")).agg(F.count("*").alias("c")), "continuations")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    weights = c.table(every.groupBy("lang", "key").agg(F.max("own").alias("own"), F.max("back").alias("back")), "weights")
    start = weights.where("key = ''").join(uniform, "lang").select("lang", (F.col("back") * F.col("chance")).alias("start"))
    return weights, c.table(start, "start")


def probabilities(grams: DataFrame, weights: DataFrame, start: DataFrame) -> DataFrame:
    """grams (lang, gram) with bits, the surprisal of the last character after the others; only
    languages with a model."""
    got = grams.join(F.broadcast(start), "lang").withColumn("p", F.col("start"))
    for n in range(1, ORDER + 1):
        own = weights.where(F.length("key") == n).select("lang", F.col("key").alias("k1"), "own")
        got = got.withColumn("k1", F.substring("gram", ORDER - n + 1, n)).join(own, ["lang", "k1"], "left")
        if n > 1:
            back = weights.where(F.length("key") == n - 1).where("back IS NOT NULL").select("lang", F.col("key").alias("k2"), "back")
            got = got.withColumn("k2", F.substring("gram", ORDER - n + 1, n - 1)).join(back, ["lang", "k2"], "left")
        p = F.coalesce("own", F.lit(0.0)) + (F.coalesce("back", F.lit(1.0)) * F.col("p") if n > 1 else F.col("p"))
        got = got.select("lang", "gram", p.alias("p"))
    return got.select("lang", "gram", (-F.log2("p")).alias("bits"))


def finished(weights: DataFrame, start: DataFrame) -> DataFrame:
    """lang, kind (own or back), n, key, bits: surprisals of all seen n-grams and weights of all seen
    contexts, from the shortest to the longest."""
    shorter = start.select("lang", F.lit("").alias("key"), F.col("start").alias("p"))
    parts = []
    for n in range(1, ORDER + 1):
        own = weights.where((F.length("key") == n) & F.col("own").isNotNull()).select("lang", "key", "own", F.substring("key", 1, n - 1).alias("k2"), F.substring("key", 2, n - 1).alias("k1"))
        low = shorter.select("lang", F.col("key").alias("k1"), "p")
        joined = own.join(F.broadcast(low), ["lang", "k1"]) if n == 1 else own.join(low, ["lang", "k1"])
        if n > 1:
            back = weights.where((F.length("key") == n - 1) & F.col("back").isNotNull()).select("lang", F.col("key").alias("k2"), "back")
            joined = joined.join(back, ["lang", "k2"])
            parts.append(back.select("lang", F.lit("back").alias("kind"), F.lit(n - 1).alias("n"), F.col("k2").alias("key"), (-F.log2("back")).alias("bits")))
        shorter = c.table(joined.select("lang", "key", (F.col("own") + (F.col("back") * F.col("p") if n > 1 else F.col("p"))).alias("p")), f"p{n}")
        parts.append(shorter.select("lang", F.lit("own").alias("kind"), F.lit(n).alias("n"), "key", (-F.log2("p")).alias("bits")))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for (lang, kind, n), g in pdf.groupby(["lang", "kind", "n"]):
            keys = c.mix(_hash_rows(_points("".join(g["key"])).reshape(-1, n)))
            yield pd.DataFrame({"lang": [lang], "kind": [kind], "n": [n], "keys": [keys.tobytes()], "bits": [g["bits"].to_numpy(np.float32).tobytes()]})


def gathered(table: DataFrame, start: DataFrame) -> dict[str, tuple]:
    """The finished tables of all languages, packed by the tasks. Only for tables of checked size."""
    found: dict[tuple, list] = {}
    for r in table.mapInPandas(c.freed(_packed), "lang string, kind string, n int, keys binary, bits binary").collect():
        found.setdefault((r.lang, r.kind, r.n), []).append((r["keys"], r.bits))
    out = {}
    for r in start.collect():
        tables = {"own": {}, "back": {}}
        for (lang, kind, n), parts in found.items():
            if lang == r.lang:
                tables[kind][n] = (b"".join(k for k, _ in parts), b"".join(v for _, v in parts))
        out[r.lang] = (tables["own"], tables["back"], -float(np.log2(r.start)))
    return out


def _moved(good: DataFrame) -> DataFrame:
    """doc_id, other: of each language whose trusted documents (two or more) are all in one half, the
    one with the least hash, and the half that it goes to."""
    halves = good.groupBy("lang").agg(F.count("*").alias("n"), F.min("half").alias("least"), F.max("half").alias("most"), F.min(F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id")).alias("first"))
    return halves.where("n > 1 AND least = most").select("first.doc_id", (1 - F.col("least")).alias("other"))


def score(documents: DataFrame, labels: DataFrame, trusted: Column | None = None, broadcast_rows: int = BROADCAST_ROWS, crossed: bool = False) -> DataFrame:
    """doc_id, lang, FIGURES, half (0 or 1, null: not trusted) of every document. The model is that of
    half 0; if crossed, each half has that of the other. labels: doc_id and what `trusted` reads (by
    default quality = 1 and toxic = 0)."""
    spark = c.session(documents.sparkSession)
    trusted = (F.col("quality") == 1) & (F.col("toxic") == 0) if trusted is None else trusted
    docs = c.texts(documents, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    good = labels.where("doc_id IS NOT NULL").where(trusted).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("half", half)
    good = c.table(good, "trusted")
    small = good.count() <= BROADCAST_IDS
    moved = c.table(_moved(docs.select("doc_id", "lang").join(F.broadcast(good) if small else good, "doc_id")), "moved")  # at most a row for each language
    if n := moved.count():
        moved = F.broadcast(moved) if n <= BROADCAST_LANGS else moved
        good = c.table(good.join(moved, "doc_id", "left").select("doc_id", F.coalesce("other", "half").alias("half")), "trusted")
        docs = docs.join(moved, "doc_id", "left").select("doc_id", "lang", "text", F.coalesce("other", half).alias("half"))
        half = F.col("half")
    train = (good if crossed else good.where("half = 0")).select("doc_id")
    learned = docs
    if crossed:  # two models a language, told apart by a digit before it
        learned, docs = (docs.withColumn("lang", F.concat(h.cast("string"), "lang")) for h in (half, 1 - half))
    docs = docs.select("doc_id", "lang", "text")
    counts = learned.where("text IS NOT NULL").join(F.broadcast(train) if small else train, "doc_id", "left_semi").select("lang", "text").mapInPandas(c.freed(_counts), "lang string, gram string, c long")
    weights, start = model(c.table(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "counts"))
    if weights.count() <= broadcast_rows:
        held = spark.sparkContext.broadcast(gathered(finished(weights, start), start))
        scored = docs.mapInPandas(c.freed(_local(held)), SCORES)
    else:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
        dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "lang", "text").repartition(blocks, "block")
        asked = dealt.mapInPandas(c.freed(_requests), "block int, lang string, gram string").distinct()
        answers = asked.join(probabilities(asked.select("lang", "gram").distinct(), weights, start), ["lang", "gram"])
        scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_block_scores, SCORES)
    scored = scored.withColumn("lang", F.expr("substring(lang, 2)")) if crossed else scored
    return c.table(scored, "scores").join(good, "doc_id", "left")


def _local(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: dict[str, Backoff] = {}

        def models(lang: str) -> Backoff | None:
            if lang not in built and lang in held.value:
                own, back, start = held.value[lang]
                made = [{n: Table(np.frombuffer(k, c.U64), np.frombuffer(v, np.float32)) for n, (k, v) in x.items()} for x in (own, back)]
                built[lang] = Backoff(*made, start)
            return built.get(lang)

        for pdf in batches:
            yield _scored(pdf, models)

    return run


def judge(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, peak_quantile: float = PEAK_QUANTILE) -> DataFrame:
    """score's columns with perplexity, the language's limits and kept."""
    scored = score(documents, labels, crossed=True)
    quantiles = {"bits": quantile, "peak": peak_quantile, "boundary": quantile, "repeated": peak_quantile}
    good = scored.where("half IS NOT NULL AND bits IS NOT NULL")
    own = good.groupBy("lang").agg(F.count("*").alias("n"), *(x for k, q in quantiles.items() for x in (F.avg(k).alias(f"mean_{k}"), F.percentile_approx(k, q, 100_000).alias(f"own_{k}"))))
    own = c.table(own, "own-limits")  # a row for each language
    own = F.broadcast(own) if own.count() <= BROADCAST_LANGS else own
    pooled = good.join(own, "lang").agg(*(F.percentile_approx(F.col(k) - F.col(f"mean_{k}"), q, 100_000).alias(f"far_{k}") for k, q in quantiles.items()))
    limits = own.join(F.broadcast(pooled)).select("lang", *(F.when(F.col("n") >= LEAST_TRUSTED, F.col(f"own_{k}")).otherwise(F.greatest(f"own_{k}", F.col(f"mean_{k}") + F.col(f"far_{k}"))).alias(f"most_{k}") for k in FIGURES))
    limits = c.table(limits, "limits")  # a row for each language
    highest = limits.agg(F.max("most_repeated").alias("_highest"))
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_LANGS else limits
    over = F.greatest(*(F.coalesce(F.col(k) > F.col(f"most_{k}"), F.lit(False)) for k in FIGURES))
    highest = F.broadcast(highest)  # one row
    return scored.join(limits, "lang", "left").join(highest).withColumn("most_repeated", F.coalesce("most_repeated", "_highest")).drop("_highest").withColumn("perplexity", F.pow(F.lit(2.0), "bits")).withColumn("kept", ~over)


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected."""
    documents = c.one_row(documents)
    return documents.join(judge(documents, labels).where("kept").select("doc_id"), "doc_id", "left_semi")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept documents with their figures and limits."""
    return judge(documents, labels).where("kept").select("doc_id", F.nullif("lang", F.lit("")).alias("lang"), "perplexity", "peak", "boundary", "repeated", F.pow(F.lit(2.0), "most_bits").alias("most_perplexity"), "most_peak", "most_boundary", "most_repeated")
