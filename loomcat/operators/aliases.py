"""Aliases of courses and initials of teachers, mined from entries that spell both out.

A course's alias stands beside its name (`name/alias`, `name（alias）`, `alias/name`), at any of the
name's occurrences. Initials follow the teachers they belong to: each run of names and the short
lower-case words behind it are aligned in order by dynamic programming, either side may be skipped,
and a pair counts if every best alignment has it. A word may belong to a name if it has as many letters as
the name has characters (words, if it has several); where readings of names are given, its letters
must be one of them.

What is written beside a name once may be anything. For each pair the number of entries that have it
is held against the numbers that have the alias and the name at all, by the log-likelihood ratio of
a two-by-two table; an alias goes to the name with the highest ratio, to none if two share it.

An entry is read in one task; counts are grouped sums of rows without repetition, so a very common
name or alias costs a row an entry. Null texts, names and lists have no pairs; repeated rows count
once for each entry_key; rows without one go; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import table

#: Short words that are no initials and no aliases.
NOISE = ("ppt", "sky", "ddl", "lz", "dz", "gpa")
#: What may stand between a name and its alias, and what ends an alias beside white space.
BESIDE, ENDS = "/／|=(（", "/／|=()（）[]【】,，.。;；:：!！?？、"
#: Letters of an alias; what skipping a name or a word costs in an alignment.
SHORTEST, LONGEST, SKIP = 2, 12, 0.4
SHORT = re.compile(r"(?<![A-Za-z])[a-z]{2,4}(?![A-Za-z])")


def beside(content: str, name: str, between: str = BESIDE) -> list[str]:
    """What stands beside each occurrence of name."""
    run, found = re.compile(rf"[^\s{re.escape(ENDS)}]+"), []
    for m in re.finditer(re.escape(name), content):
        if content[m.end() : m.end() + 1] and content[m.end()] in between and (after := run.match(content, m.end() + 1)):
            found.append(after[0])
        if m.start() > 1 and content[m.start() - 1] in between[:2]:
            before = run.findall(content[max(0, m.start() - 2 - LONGEST) : m.start() - 1])
            if before and content[: m.start() - 1].endswith(before[-1]):
                found.append(before[-1])
    return [x for x in found if SHORTEST <= len(x) <= LONGEST]


def runs(content: str, teachers: Iterable[str], noise: Iterable[str]) -> list[tuple[list[str], list[str]]]:
    """Names in the order of the text, with the short words between them and the next name."""
    names = sorted({re.sub(r"[(（].*?[)）]", "", x).strip() for x in teachers if x} - {""}, key=lambda x: (-len(x), x))
    marks = [(m.start(), 0, m[0]) for m in re.finditer("|".join(map(re.escape, names)), content)] if names else []
    marks += [(m.start(), 1, m[0]) for m in SHORT.finditer(content) if m[0] not in noise]
    out: list[tuple[list[str], list[str]]] = []
    after = True
    for _, kind, word in sorted(marks):
        if kind == 0:
            if after:
                out.append(([], []))
            if word not in out[-1][0]:
                out[-1][0].append(word)
            after = False
        elif out:
            out[-1][1].append(word)
            after = True
    return [x for x in out if x[1]]


def fits(name: str, word: str, readings: dict[str, set[str]]) -> float | None:
    """How well a word may stand for a name; None if it can't."""
    if name in readings:
        return 2.0 if word in readings[name] else None
    return 1.0 if len(word) == (len(name.split()) if " " in name else len(name)) else None


def best(names: list[str], words: list[str], readings: dict[str, set[str]], without: tuple[int, int] | None = None) -> tuple[float, list[tuple[int, int]]]:
    """The score of the best alignment in order, and one that has it."""
    score = [[-SKIP * (i + j) for j in range(len(words) + 1)] for i in range(len(names) + 1)]
    came = [["" if not i and not j else "name" if not j else "word" for j in range(len(words) + 1)] for i in range(len(names) + 1)]
    for i, name in enumerate(names, 1):
        for j, word in enumerate(words, 1):
            score[i][j], came[i][j] = max((score[i - 1][j] - SKIP, "name"), (score[i][j - 1] - SKIP, "word"))
            fit = fits(name, word, readings)
            if fit is not None and (i - 1, j - 1) != without and score[i - 1][j - 1] + fit > score[i][j]:
                score[i][j], came[i][j] = score[i - 1][j - 1] + fit, "both"
    i, j, pairs = len(names), len(words), []
    while i or j:
        step = came[i][j]
        if step == "both":
            pairs.append((i - 1, j - 1))
        i, j = i - (step != "word"), j - (step != "name")
    return score[-1][-1], pairs[::-1]


def aligned(names: list[str], words: list[str], readings: dict[str, set[str]] | None = None) -> list[tuple[str, str]]:
    """(name, word) pairs that every best alignment has."""
    readings = readings or {}
    top, pairs = best(names, words, readings)
    return [(names[i], words[j]) for i, j in pairs if best(names, words, readings, (i, j))[0] < top - 1e-9]


def log_likelihood_ratio(both: Column, one: Column, other: Column, total: Column) -> Column:
    """Of a two-by-two table: rows with both, with one, with the other, and all."""
    cells = ((both, one, other), (one - both, one, total - other), (other - both, total - one, other), (total - one - other + both, total - one, total - other))
    terms = [F.when(n > 0, n * F.log(n.cast("double") * total / (a.cast("double") * b))).otherwise(0.0) for n, a, b in cells]
    return 2 * sum(terms[1:], terms[0])


def mine(mentions: DataFrame, readings: DataFrame | None = None, noise: Iterable[str] = NOISE, least: int = 2, ratio: float = 3.84, between: str = BESIDE) -> DataFrame:
    """alias, entity_type (course or teacher), canonical_name, evidence_count and ratio from mentions
    (entry_key, content, course_name, teachers (array)); readings: teacher and initials, several rows
    a teacher if a character has several readings. A pair needs `least` entries and that ratio (3.84
    is one in twenty by chance)."""
    mentions = mentions.where("entry_key IS NOT NULL")
    noise, kind = frozenset(noise), dict(mentions.dtypes)["entry_key"]
    rows = mentions.select("entry_key", "content", "course_name", "teachers")
    if readings is not None:
        known = readings.groupBy("teacher").agg(F.collect_set(F.lower("initials")).alias("initials"))
        named = rows.select("entry_key", "content", F.explode("teachers").alias("_t")).withColumn("teacher", F.trim(F.regexp_replace("_t", r"[(（].*?[)）]", "")))
        spelled = named.join(known, "teacher").groupBy("entry_key").agg(F.collect_set(F.struct("teacher", "initials")).alias("spelled"))
        rows = rows.join(spelled, "entry_key", "left")
    else:
        rows = rows.withColumn("spelled", F.array().cast("array<struct<teacher:string,initials:array<string>>>"))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, content, course, teachers, spelled in zip(pdf["entry_key"], pdf["content"], pdf["course_name"], pdf["teachers"], pdf["spelled"], strict=True):
                if not content:
                    continue
                if course:
                    found = [x for x in beside(content, course, between) if x.lower() not in noise and x != course]
                    out += [(key, "course", x, course) for x in found] + [(key, "course", x, None) for x in found]
                    out += [(key, "course", None, course)] * (course in content)
                if teachers is not None and len(teachers):
                    spoken = {x["teacher"]: set(x["initials"]) for x in (spelled if spelled is not None else ())}
                    for names, words in runs(content, teachers, noise):
                        out += [(key, "teacher", w, n) for n, w in aligned(names, words, spoken)]
                        out += [(key, "teacher", w, None) for w in words] + [(key, "teacher", None, n) for n in names]
            yield pd.DataFrame(out, columns=["entry_key", "entity_type", "alias", "canonical_name"])

    seen = table(rows.mapInPandas(pairs, f"entry_key {kind}, entity_type string, alias string, canonical_name string").distinct(), "alias-pairs")
    total = mentions.agg(F.count_distinct("entry_key").alias("total"))
    count = F.count("*")
    both = seen.where("alias IS NOT NULL AND canonical_name IS NOT NULL").groupBy("entity_type", "alias", "canonical_name").agg(count.alias("evidence_count")).where(F.col("evidence_count") >= least)
    one = seen.where("canonical_name IS NULL").groupBy("entity_type", "alias").agg(count.alias("one"))
    other = seen.where("alias IS NULL").groupBy("entity_type", "canonical_name").agg(count.alias("other"))
    met = both.join(one, ["entity_type", "alias"]).join(other, ["entity_type", "canonical_name"]).crossJoin(F.broadcast(total))  # one row
    n, a, b, t = (F.col(x) for x in ("evidence_count", "one", "other", "total"))
    # more entries than by chance; where all entries have the pair nothing can be said, and it stands
    scored = met.withColumn("ratio", log_likelihood_ratio(n, a, b, t)).where(((n * t > a * b) & (F.col("ratio") >= ratio)) | ((n == t) & (a == t)))
    first = scored.groupBy("entity_type", "alias").agg(F.max(F.struct("ratio", "evidence_count")).alias("top"))
    led = scored.join(first, ["entity_type", "alias"]).where((F.col("ratio") == F.col("top.ratio")) & (F.col("evidence_count") == F.col("top.evidence_count")))
    alone = led.groupBy("entity_type", "alias").agg(count.alias("k"), F.first("canonical_name").alias("canonical_name"), F.first("evidence_count").alias("evidence_count"), F.first("ratio").alias("ratio"))
    return alone.where("k = 1").select("alias", "entity_type", "canonical_name", "evidence_count", "ratio")
