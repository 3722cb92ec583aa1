"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's subwords are its character 1-, 2- and 3-grams (lower case; all that is no letter counts as
one space), hashed into BUCKETS rows of an embedding table. Their mean goes through a linear layer
and a softmax. Table and layer are trained together by stochastic gradient descent in numpy on a
bounded sample: the PER_LANG labelled documents of each language with the least hashes, and fewer where
all would be more than SAMPLE, or more than SAMPLE_BYTES of subwords, but one of each language,
however many there are.

Calibration is cross-fitted: each half of the sample is scored by a model of the other half. These
scores fit a temperature and two limits, below which a prediction is marked as rejected: of the
score, and of the familiarity, the share of a text's subwords that training has seen. Each limit is
the REJECTED quantile among right predictions, so about that share of right ones is lost at every size
of the sample, and texts in a language that was not learned fall below one of them. The final model
learns from the whole sample.

Defined cases: null text and text without letters give `und` with score 0, rejected; without any
labelled document everything is `und`; the longest text is scored whole, in blocks; repeated rows give
repeated results; rows without doc_id go; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

BUCKETS, DIM, GRAMS = 1 << 15, 16, 3
PER_LANG, SAMPLE, SAMPLE_BYTES = 800, 20_000, 128 << 20
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Share of right predictions that a limit rejects.
REJECTED = 0.005
#: Characters that a task scores at a time.
BLOCK = 500_000


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code of each letter, 0 for everything else."""
    out = np.zeros(0x110000, np.uint32)
    for x in range(0x110000):
        ch = chr(x)
        if ch.isalpha():
            out[x] = ord(low) if len(low := ch.lower()) == 1 else x
    return out


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of about BLOCK characters and the text of each; each piece is followed by the GRAMS - 1
    codes after it, so that every n-gram is counted where it starts."""
    codes, owner, n = [], [], 0
    for i, text in enumerate(texts):
        full = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        for at in range(0, len(full), BLOCK):
            piece = full[at : at + BLOCK]
            tail = full[at + BLOCK : at + BLOCK + GRAMS - 1]
            codes += [piece, tail, np.zeros(GRAMS - 1 - len(tail), np.uint32)]
            owner += [np.full(len(piece), i, np.int32), np.full(GRAMS - 1, -1, np.int32)]
            n += len(piece)
            if n >= BLOCK:
                yield np.concatenate(codes), np.concatenate(owner)
                codes, owner, n = [], [], 0
    if n:
        yield np.concatenate(codes), np.concatenate(owner)


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each n-gram, 0 where it has no letter. The last n - 1 places hold no start."""
    m = len(codes) - GRAMS + 1
    h, some = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32), np.zeros(m, np.uint32)
    for k in range(n):
        x = codes[k : k + m]
        h = (h ^ x) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        some |= x
    return np.where(some > 0, 1 + h % np.uint32(BUCKETS - 1), 0).astype(np.int32)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their counts for each text."""
    sums: list[dict | None] = [np.zeros(BUCKETS, np.int64) for _ in texts]
    for codes, owner in _blocks(texts):
        for n in range(1, GRAMS + 1):
            h, o = _hashed(codes, n), owner[: len(codes) - GRAMS + 1]
            for i in np.unique(o[o >= 0]):
                sums[i] += np.bincount(h[o == i], minlength=BUCKETS)
    out = []
    for s in sums:
        s[0] = 0
        at = np.flatnonzero(s)
        out.append((at.astype(np.int32), s[at].astype(np.int32)))
    return out


def totals(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over each text's n-grams, and their number. table[0] is zero."""
    out, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    for codes, owner in _blocks(texts):
        o = owner[: len(codes) - GRAMS + 1]
        first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        who = o[first]
        ok = who >= 0
        for n in range(1, GRAMS + 1):
            h = _hashed(codes, n)
            np.add.at(out, who[ok], np.add.reduceat(table[h], first, axis=0)[ok])
            np.add.at(count, who[ok], np.add.reduceat((h > 0).astype(np.int64), first)[ok])
    return out, count


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows: language, buckets, shares. Embeddings, with a last column that says which buckets have
    been seen, layer and bias of a model of n languages."""
    y = np.array([r[0] for r in rows])
    rng = np.random.default_rng(SEED)
    emb, layer, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, n)), np.zeros(n)
    weight = np.minimum(len(rows) / (n * np.maximum(np.bincount(y, minlength=n), 1)), 10)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 16):
            batch = order[at : at + 16]
            h = np.array([rows[i][2] @ emb[rows[i][1]] for i in batch])
            g = _softmax(h @ layer + bias)
            g[np.arange(len(batch)), y[batch]] -= 1
            g *= weight[y[batch]][:, None] / len(batch)
            dh = g @ layer.T
            layer -= rate * h.T @ g
            bias -= rate * g.sum(axis=0)
            for i, d in zip(batch, dh, strict=True):  # embeddings get larger steps: a row sees few of the n-grams
                emb[rows[i][1]] -= rate * 50 * np.outer(rows[i][2], d)
    seen = np.zeros((BUCKETS, 1))
    for _, buckets, _ in rows:
        seen[buckets] = 1
    emb[0] = 0
    return np.hstack([emb, seen]).astype(np.float32), layer, bias


def _limit(values: np.ndarray) -> float:
    """The REJECTED quantile, or the least value where there are few."""
    return float(np.sort(values)[int(len(values) * REJECTED)]) if len(values) else 0.0


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> dict | None:
    """rows: language, buckets, counts. Returns langs, table, layer, bias, temperature and the limits
    of score and familiarity."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    number = {x: k for k, x in enumerate(langs)}
    rows = [(number[x], at, n / n.sum()) for x, at, n in rows]
    half = np.random.default_rng(SEED).permutation(len(rows)) % 2
    logits, known = np.zeros((len(rows), len(langs))), np.zeros(len(rows))
    for h in (0, 1):
        if len(other := [r for r, k in zip(rows, half, strict=True) if k != h]):
            table, layer, bias = fit(other, len(langs))
            for i in np.flatnonzero(half == h):
                mean = rows[i][2] @ table[rows[i][1]]
                logits[i], known[i] = mean[:-1] @ layer + bias, mean[-1]
    y = np.array([r[0] for r in rows])
    loss = {t: -np.log(_softmax(logits / t)[np.arange(len(rows)), y] + 1e-12).mean() for t in np.geomspace(0.05, 5, 41)}
    heat = float(min(loss, key=loss.get))
    p = _softmax(logits / heat)
    right = p.argmax(axis=1) == y
    table, layer, bias = fit(rows, len(langs))
    return {"langs": langs, "table": table, "layer": layer, "bias": bias, "heat": heat, "reject": _limit(p.max(axis=1)[right]), "familiar": _limit(known[right])}


def learn(documents: DataFrame, usable: Column) -> dict | None:
    """A model from a bounded sample of the rows of documents (doc_id, text, lang) where usable."""
    c.session(documents.sparkSession)
    rows = documents.where(usable).where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    langs = c.table(rows.groupBy("lang").count(), "langs")
    each = max(1, min(PER_LANG, SAMPLE // max(1, langs.count())))
    # the least hashes of each language: by a bound that far more than `each` of them keep, then by rank
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) / 1_000_000_000
    near = rows.select("doc_id", "lang").join(langs, "lang").withColumn("draw", draw).where(F.col("draw") < (4 * each + 50) / F.col("count"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id")).alias("place")
    chosen = c.table(near.select("doc_id", "lang", "draw").distinct().select("doc_id", "lang", place).where(F.col("place") <= each), "chosen")
    sample = rows.join(chosen, ["doc_id", "lang"]).select("lang", "text", "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = features(pdf["text"].tolist())
            yield pd.DataFrame({"lang": pdf["lang"], "place": pdf["place"], "at": [a.tobytes() for a, _ in found], "n": [n.tobytes() for _, n in found]})

    drawn = c.table(sample.mapInPandas(c.freed(run), "lang string, place int, at binary, n binary"), "sample")
    sizes = sorted(drawn.groupBy("place").agg(F.sum(F.length("at") + F.length("n"))).collect())  # a row a place
    fits = [k for (k, _), held in zip(sizes, np.cumsum([n for _, n in sizes]), strict=True) if held <= SAMPLE_BYTES or k == 1]
    got = drawn.where(F.col("place") <= (fits[-1] if fits else 0)).select("lang", "at", "n").collect()
    return train([(x, np.frombuffer(at, np.int32), np.frombuffer(n, np.int32).astype(float)) for x, at, n in sorted((r.lang, bytes(r["at"]), bytes(r["n"])) for r in got)])


def scored(texts: list[str], m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, of each text."""
    sums, count = totals(texts, m["table"])
    mean, some = sums / np.maximum(count, 1)[:, None], count > 0
    p = _softmax((mean[:, :-1] @ m["layer"] + m["bias"]) / m["heat"])
    lang = np.where(some, np.array(m["langs"], object)[p.argmax(axis=1)], "und")
    score = np.where(some, p.max(axis=1), 0.0)
    return lang, score, ~some | (score < m["reject"]) | (mean[:, -1] < m["familiar"])


def predict(documents: DataFrame, model: dict | None, *more: str | Column) -> DataFrame:
    """doc_id, `more`, lang_pred, score, rejected; only text is an input of a prediction."""
    spark = c.session(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    held = spark.sparkContext.broadcast(model)
    kept = [f for f in rows.columns if f != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            lang, score, rejected = scored(texts, m) if m else ("und", 0.0, True)
            yield pdf[kept].assign(lang_pred=lang, score=score, rejected=rejected)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInPandas(c.freed(run), f"{schema}, lang_pred string, score double, rejected boolean")


def digest(documents: DataFrame) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 1
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", "text", "lang")
    return predict(docs, learn(docs, ~held_out), held_out.alias("held_out"))
