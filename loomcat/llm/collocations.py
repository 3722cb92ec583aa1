"""Phrases whose words stand together more often than their parts would suggest.

Texts are cut into pieces at punctuation and line ends, pieces into words; A-Z are taken as a-z.
Everything is counted for each language. A phrase of 2 to `longest` words with at least `least`
occurrences is a candidate; of its cuts into two parts with l and r occurrences the one with the
lowest floor(scale * a / (l + r)) counts.

Hierarchical pair naming: every frequent word has an id; then, level by level, two neighbouring ids
of frequent (k-1)-grams, which overlap in k-2 words, are a pair, pairs are counted over the corpus,
and each frequent pair gets an id. Nothing is missed, since a frequent phrase has frequent parts.
The pair that an id stands for is its two parents: counts of all first and last parts follow along
them, and so does what a phrase is part of (of all longer phrases that hold it, those one word longer
have the most occurrences, so its two-sided children decide).

Documents go through tasks in blocks of a bounded number of words. A block keeps one number a word and
lists its distinct words or pairs once, with their counts. These lists are what is shuffled: sorted,
packed into bytes and dealt by a hash to `shards`, so that a shard has all counts of its pairs, names
the frequent ones, and answers each block with the ids of those that the block has. A very common
word or pair is one entry a block. Only frequent phrases ever become rows and text.

Defined cases: null texts are empty; a null lang is `und`, together with texts of that lang; empty
texts have no words; very long texts are counted whole, in as many blocks as they need; repeated rows
count each time, and rows without doc_id count as well; an empty table gives an empty result; other
columns are ignored. Arithmetic is in decimals of 38 digits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Words of a block.
BLOCK = 1 << 20
#: Ranks within a language come from this many parts of it, each cut to `top`.
PARTS = 64
#: What ends a piece, beside line ends.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(b"\t" + ENDS, b" " + b"\n" * len(ENDS))
BREAK = b"\n"
#: Rows of a level: a block's own (codes; at the first level its langs and their words), or its list
#: for a shard (data; at the first level words and langs).
LISTED = "block long, shard int, codes binary, langs array<string>, times array<long>, words binary, data binary"
#: Rows of what shards answer: to a block (data), or their frequent phrases.
ANSWERED = "block long, data binary, ids array<long>, langs array<string>, words array<string>, los array<long>, his array<long>, fs array<long>"


def words_and_breaks(text: str | None) -> list[bytes]:
    """The words of a text, with BREAK wherever a piece ends and behind the last."""
    if not isinstance(text, str):
        return [BREAK]
    folded = text.encode("utf-8", "surrogatepass").lower().translate(_FOLD)
    return [w for w in folded.replace(BREAK, b" \n ").split(b" ") if w] + [BREAK]


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each array in as few bytes a number as its largest needs, first bytes
    first, compressed."""
    out = []
    for a in arrays:
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
        out += [width.to_bytes(1, "little"), len(a).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(data), 0, []
    while at < len(data):
        width, n = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(data, np.uint8, width * n, at + 9).reshape(width, n).T
        out.append(a.view("<i8").ravel())
        at += 9 + width * n
    return out


def frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame({x: pd.Series([r.get(x) for r in rows], dtype=object) for x in (field.split()[0] for field in schema.split(", "))})


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Shard, start and end of each run of a sorted array."""
    if len(shard):
        start = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        yield from zip(shard[start].tolist(), start.tolist(), [*start[1:].tolist(), len(shard)], strict=True)


def _blocks(most: int, shards: int):
    """Documents to LISTED rows; codes number a block's words from 1, shard by shard, 0 is a break."""

    def listed(block: int, codes: np.ndarray, known: dict[str, dict[bytes, int]]) -> list[dict]:
        langs = list(known)
        words = [(xxhash.xxh3_64_intdigest(w) % shards, w, k, i) for k, lang in enumerate(langs) for w, i in known[lang].items() if i]
        words.sort()
        place = np.zeros(len(words) + 1, np.int64)
        place[[x[3] for x in words]] = np.arange(1, len(words) + 1)
        codes = place[codes]
        which, times = np.array([x[2] for x in words], np.int64), np.bincount(codes, minlength=len(words) + 1)[1:]
        rows = [{"block": block, "codes": packed(codes), "langs": langs, "times": np.bincount(which, times, len(langs)).astype(np.int64)}]
        for shard, s, t in by_shard(np.array([x[0] for x in words], np.int64)):
            joined = zstandard.compress(BREAK.join(x[1] for x in words[s:t]), 1)
            rows.append({"block": block, "shard": shard, "langs": langs, "words": joined, "data": packed(np.array([s]), which[s:t], times[s:t])})
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = count(TaskContext.get().partitionId() << 32)
        held, following, known, size = [], count(1).__next__, {}, 0
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                tokens = words_and_breaks(text)
                # a long text goes on in the next block: a break is where it may be cut
                for s, t in cuts(tokens, most):
                    if size + t - s > most and size:
                        yield frame(listed(next(number), np.concatenate(held), known), LISTED)
                        held, following, known, size = [], count(1).__next__, {}, 0
                    if lang not in known:
                        known[lang] = defaultdict(following, {BREAK: 0})
                    held.append(np.fromiter(map(known[lang].__getitem__, tokens[s:t]), np.int64, t - s))
                    size += t - s
        if size:
            yield frame(listed(next(number), np.concatenate(held), known), LISTED)

    return run


def cuts(tokens: list[bytes], most: int) -> list[tuple[int, int]]:
    """Ranges of whole pieces, each of at most `most` tokens unless one piece is longer."""
    if len(tokens) <= most:
        return [(0, len(tokens))]
    ends = [i + 1 for i, w in enumerate(tokens) if w == BREAK]
    return [(([0] + ends)[s], ends[t - 1]) for s, t in c.chunks(np.diff([0, *ends]).tolist(), most)]


def answers(blocks: np.ndarray, sizes: list[int], start: list[int], code: np.ndarray, ids: np.ndarray) -> list[dict]:
    """To each block the ids (-1: none) of those entries of its list that have one. Entry j of a list
    has the number start + j in its block; code numbers all lists' entries, one list after the other."""
    rows, at = [], 0
    for block, n, first in zip(blocks, sizes, start, strict=True):
        mine = ids[code[at : at + n]]
        found = np.flatnonzero(mine >= 0)
        if len(found):
            rows.append({"block": block, "data": packed(found + first, mine[found])})
        at += n
    return rows


def _name_words(least: int, shards: int):
    """All lists of a shard: words that are frequent in a lang get ids."""

    def run(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        start, sizes, keys, times = [], [], [], []
        for langs, words, data in zip(lists["langs"], lists["words"], lists["data"], strict=True):
            first, which, n = unpacked(data)
            start.append(int(first[0]))
            sizes.append(len(n))
            times.append(n)
            keys += zip(zstandard.decompress(words).split(BREAK), (langs[k] for k in which), strict=True)
        flat = np.empty(len(keys), object)
        flat[:] = keys
        code, distinct = pd.factorize(flat)
        f = np.zeros(len(distinct), np.int64)
        np.add.at(f, code, np.concatenate(times))
        often = np.flatnonzero(f >= least)
        ids = np.full(len(distinct), -1, np.int64)
        ids[often] = np.arange(len(often)) * shards + key[0]
        rows = [{"ids": ids[often], "langs": [distinct[i][1] for i in often], "words": [distinct[i][0].decode() for i in often], "fs": f[often]}]
        return frame(rows + answers(lists["block"], sizes, start, code, ids), ANSWERED)

    return run


def _name_pairs(least: int, shards: int):
    """All lists of a shard: frequent pairs get ids."""

    def run(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        first, los, his, times = zip(*(unpacked(x) for x in lists["data"]), strict=True)
        lo, hi = np.concatenate([np.cumsum(x) for x in los]), np.concatenate(his)
        (lo_code, lo_ids), (hi_code, hi_ids) = pd.factorize(lo), pd.factorize(hi)
        distinct, code = np.unique(lo_code * len(hi_ids) + hi_code, return_inverse=True)
        f = np.zeros(len(distinct), np.int64)
        np.add.at(f, code, np.concatenate(times))
        often = np.flatnonzero(f >= least)
        ids = np.full(len(distinct), -1, np.int64)
        ids[often] = np.arange(len(often)) * shards + key[0]
        pair = distinct[often]
        rows = [{"ids": ids[often], "los": lo_ids[pair // len(hi_ids)], "his": hi_ids[pair % len(hi_ids)], "fs": f[often]}]
        return frame(rows + answers(lists["block"], [len(x) for x in his], [int(x[0]) for x in first], code, ids), ANSWERED)

    return run


def _paired(shards: int, last: bool):
    """Cogroup of a block's own row and its answers, to LISTED rows: pairs of neighbouring ids."""

    def run(key: tuple, own: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(answer):
            return frame([], LISTED)
        i, ids = (np.concatenate(x) for x in zip(*map(unpacked, answer["data"]), strict=True))
        (codes,) = unpacked(own["codes"].iloc[0])
        place = np.full(max(int(i.max()) + 1, int(codes.max(initial=0))) + 1, -1, np.int64)
        place[i + 1] = np.arange(len(i))  # codes count from 1
        here = place[codes]
        pair = np.where((here[:-1] >= 0) & (here[1:] >= 0), here[:-1] * len(i) + here[1:], -1)
        distinct, code, times = np.unique(pair, return_inverse=True, return_counts=True)
        none = int(len(distinct) > 0 and distinct[0] < 0)
        distinct, times = distinct[none:], times[none:]
        lo, hi = ids[distinct // len(i)], ids[distinct % len(i)]
        shard = (c.mix(c.mix(lo.view(c.U64)) + hi.view(c.U64)) % c.U64(shards)).astype(np.int64)
        order = np.lexsort((hi, lo, shard))
        rows = []
        if not last:
            rank = np.zeros(len(order) + none, np.int64)
            rank[order + none] = np.arange(1, len(order) + 1)
            rows.append({"block": key[0], "codes": packed(rank[code])})
        lo, hi, times = lo[order], hi[order], times[order]
        for k, s, t in by_shard(shard[order]):
            rows.append({"block": key[0], "shard": k, "data": packed(np.array([s]), np.diff(lo[s:t], prepend=0), hi[s:t], times[s:t])})
        return frame(rows, LISTED)

    return run


def exact(column: str | Column) -> Column:
    return F.col(column).cast("decimal(19,0)") if isinstance(column, str) else column.cast("decimal(19,0)")


def grams(documents: DataFrame, least: int = 30, longest: int = 4) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by level, words first: id, lang, phrase, last_word, f, lo and hi (ids of the
    parents: all words but the last, all but the first), heads and tails (occurrences of the first
    1, 2, ... words, and of the words behind them); and the words of each lang (lang, n)."""
    spark = c.session(documents.sparkSession)
    shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    listed = c.table(docs.mapInPandas(c.freed(_blocks(BLOCK, shards)), LISTED), "words")
    totals = listed.where("shard IS NULL").select(F.explode(F.arrays_zip("langs", "times")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.times").alias("n")).where("n > 0")
    totals = c.table(totals, "totals")
    answered = c.table(listed.where("shard IS NOT NULL").groupBy("shard").applyInPandas(_name_words(least, shards), ANSWERED), "word-ids")
    none = F.array().cast("array<long>")
    words = answered.where("block IS NULL").select(F.explode(F.arrays_zip("ids", "langs", "words", "fs")).alias("x"))
    levels = [c.table(words.select(F.col("x.ids").alias("id"), F.col("x.langs").alias("lang"), F.col("x.words").alias("phrase"), F.col("x.words").alias("last_word"), F.col("x.fs").alias("f"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), none.alias("heads"), none.alias("tails")), "grams")]
    for k in range(2, longest + 1):
        own, back = listed.where("shard IS NULL").select("block", "codes"), answered.where("block IS NOT NULL").select(F.col("block").alias("of_block"), "data")
        after = c.table(own.groupBy("block").cogroup(back.groupBy("of_block")).applyInPandas(_paired(shards, k == longest), LISTED), f"pairs-{k}")
        c.drop(listed, answered)
        listed = after
        answered = c.table(listed.where("shard IS NOT NULL").groupBy("shard").applyInPandas(_name_pairs(least, shards), ANSWERED), f"pair-ids-{k}")
        often = answered.where("block IS NULL").select(F.explode(F.arrays_zip("ids", "los", "his", "fs")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.los").alias("lo"), F.col("x.his").alias("hi"), F.col("x.fs").alias("f"))
        levels.append(c.table(with_parents(often, levels[-1]), "grams"))
    c.drop(listed, answered)
    return levels, totals


def with_parents(often: DataFrame, level: DataFrame) -> DataFrame:
    lo = level.select(F.col("id").alias("lo"), "lang", F.col("phrase").alias("lo_phrase"), F.col("f").alias("lo_f"), F.col("heads").alias("lo_heads"))
    hi = level.select(F.col("id").alias("hi"), "last_word", F.col("f").alias("hi_f"), F.col("tails").alias("hi_tails"))
    phrase = F.concat_ws(" ", "lo_phrase", "last_word").alias("phrase")
    heads, tails = F.concat("lo_heads", F.array("lo_f")).alias("heads"), F.concat(F.array("hi_f"), "hi_tails").alias("tails")
    return often.join(lo, "lo").join(hi, "hi").select("id", "lang", phrase, "last_word", "f", "lo", "hi", heads, tails)


def scored(level: DataFrame, scale: int) -> DataFrame:
    """level with l, r and score of its lowest-scoring cut; of equal ones that after fewest words."""
    cut = F.transform(F.arrays_zip("heads", "tails"), lambda x, k: F.struct(_score(F.col("f"), x["heads"], x["tails"], scale).alias("score"), k.alias("k"), x["heads"].alias("l"), x["tails"].alias("r")))
    return level.withColumn("cut", F.array_min(cut)).select("*", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")).drop("cut")


def _score(a: Column, left: Column, right: Column, scale: int) -> Column:
    # 7 and 19 digits by 20: the quotient is floored exactly
    return F.call_function("div", F.lit(scale).cast("decimal(7,0)") * exact(a), exact(left) + exact(right))


def standing(level: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """level without phrases that have `share` percent or more of their occurrences inside a longer one."""
    inside = longer.select(F.explode(F.array("lo", "hi")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
    met = level.join(inside, "id", "left")
    return met.where(F.col("longer").isNull() | (exact("longer") * 100 < exact("f") * share)).drop("longer")


def collocations(documents: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, scale: int = 2_000_000, share: int = 80) -> DataFrame:
    """Each language's first `top` phrases by score: lang, rank, phrase, a, l, r, n, score, words."""
    if not (least >= 1 and longest >= 2 and top >= 1 and 1 <= scale < 10**7):
        raise ValueError("least and top are at least 1, longest at least 2, scale below 10 ** 7")
    levels, totals = grams(documents, least, longest)
    kept = None
    for k, level in enumerate(levels[1:], 2):
        found = scored(level if k == longest else standing(level, levels[k], share), scale).select("lang", "phrase", F.col("f").alias("a"), "l", "r", "score", F.lit(k).alias("words"))
        kept = found if kept is None else kept.union(found)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that no task sorts a whole one
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words")


def digest(documents: DataFrame) -> DataFrame:
    return collocations(documents)


SQL = r"""
WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(unnest(ps), '[ \x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*)::BIGINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g AS phrase, f AS a, string_split(g, ' ') AS s FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT c.*, j, array_to_string(s[1:j], ' ') AS one, array_to_string(s[j + 1:], ' ') AS two FROM c, (VALUES (1), (2), (3)) AS js(j) WHERE j < k),
sc AS (SELECT cut.lang, cut.k, phrase, a, s, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.g = one AND x.k = j JOIN f y ON y.lang = cut.lang AND y.g = two AND y.k = cut.k - j),
lowest AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, j) = 1),
sub AS (SELECT b.lang, array_to_string(b.s[i:i + m - 1], ' ') AS inner_phrase, m, max(b.a) AS longer FROM c b, (VALUES (2), (3)) AS ms(m), (VALUES (1), (2), (3)) AS froms(i) WHERE m < b.k AND i + m - 1 <= b.k GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN sub ON sub.lang = lowest.lang AND sub.m = lowest.k AND sub.inner_phrase = phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score, k::INTEGER AS words FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
