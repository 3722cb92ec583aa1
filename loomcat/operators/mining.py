"""Text mining over reviews: redaction, entity matching and highlighting, aliases, classification.

The rules below are this library's own; they are data, and every function takes them as parameters.
Dictionary matching runs as leftmost-longest search of an Aho-Corasick automaton in mapInPandas over
a broadcast dictionary of checked size; larger ones are joined by n-grams. The classifier of threads
and replies is learned from labelled rows. Everything else is built-in expressions.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import table

#: What stands for a contact (a fixed value).
HIDDEN = "[联系方式已隐藏]"
#: Contacts in a text, first to last, none of them part of a longer word or number, each with what a
#: text must hold for it to be looked for.
CONTACTS = (
    (r"(?i)(?:微信|(?<![a-z])(?:vx|wx|wechat|v信))\s*(?:号|id)?\s*[:：]?\s*[a-z][a-z0-9_-]{4,19}", "(?i)信|vx|wx|wechat"),
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@"),
    (r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])", "1[3-9][0-9]{9}"),
    (r"(?i)(?<![a-z])qq?\s*(?:号|群)?\s*[:：]?\s*[1-9][0-9]{5,10}(?![0-9])", "[0-9]{6}"),
)
#: Names of a dictionary that may be broadcast, and bytes of text in all of them: an automaton has a
#: node for each byte that no other name begins with, some 50 bytes large.
MOST_NAMES, MOST_BYTES = 500_000, 8 << 20
#: Bits, as a power of two, of the map of hashes that larger dictionaries are looked for with (16 MB).
MOST_BITS = 27
#: Bytes of text that are matched at a time.
SLICE = 1 << 20
#: Characters of a name that is spelled by initials.
MOST_SYLLABLES = 8
#: Kinds of texts that a classifier may have.
MOST_KINDS = 100
HIGHLIGHTS = "array<struct<start_offset:int,end_offset:int,entity_type:string,match_kind:string>>"


def redact(text: str | Column, patterns: Iterable[tuple[str, str]] = CONTACTS, hidden: str = HIDDEN) -> Column:
    """Contacts hidden and NUL characters removed; patterns: what is hidden, and a cheap pattern that
    a text without contacts of this kind lacks."""
    out = F.col(text) if isinstance(text, str) else text
    for p, hint in patterns:
        holds = out.contains(hint) if hint == re.escape(hint) else out.rlike(hint)
        out = F.when(holds, F.regexp_replace(out, p, hidden.replace("$", r"\$"))).otherwise(out)
    return F.replace(out, F.lit("\x00"), F.lit(""))


class Longest:
    """Leftmost-longest occurrences of names, found by one pass of an automaton over the text's UTF-8
    bytes (a small alphabet keeps the automaton's nodes narrow)."""

    def __init__(self, names: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        for n in names:
            if n:
                self.automaton.add_word(self._bytes(n), len(n.encode()))
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def _bytes(text: str) -> str:
        return text.encode("utf-8", "surrogatepass").decode("latin-1")

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) in code points, from left to right."""
        if not text or not len(self.automaton):
            return []
        raw = self._bytes(text)
        found = sorted(((end + 1 - n, -(end + 1)) for end, n in self.automaton.iter(raw)))
        if not found:
            return []
        code_points = np.arange(len(raw) + 1) if len(raw) == len(text) else np.concatenate(([0], np.cumsum((np.frombuffer(raw.encode("latin-1"), np.uint8) & 0xC0) != 0x80)))
        out, free = [], 0
        for start, end in found:
            if start >= free:
                free = -end
                # a place within a character counts that character already, hence the start's own
                out.append((int(code_points[start]), int(code_points[free])))
        return out


@dataclass(frozen=True)
class Rules:
    """What tells a course from a word of the same letters."""

    #: a name of two letters counts only near one of these, or on a line of a list
    context: tuple[str, ...] = ("课", "老师", "教授", "作业", "考试", "期末", "学分", "教材")
    near: int = 4
    #: other uses of a name: what follows it
    not_before: tuple[str, ...] = ("上来说", "上讲", "意义上", "角度")
    #: nickname: course; virtual courses need no listing
    nicknames: dict[str, str] = field(default_factory=dict)
    #: longer words in which a name or nickname doesn't count
    boundaries: tuple[str, ...] = ()
    titles: tuple[str, ...] = ("老师", "教授", "讲师", "助教")


class Matcher:
    """Courses that a text names: full names, 8-digit codes and nicknames, the longest wins."""

    def __init__(self, rows: Iterable[tuple[str, str]], rules: Rules = Rules(), meanings: dict[str, str | None] | None = None):  # noqa: B008
        """rows: code and name, in order; or meanings, the surfaces and what each stands for."""
        self.rules, self.names = rules, dict(meanings or {})
        for code, name in rows:
            if name:
                self.names[name] = name
                self.names.setdefault(name.replace("（", "").replace("）", "").replace("(", "").replace(")", ""), name)
            if code and re.fullmatch(r"\d{8}", code):
                self.names[code] = name
        self.names |= rules.nicknames
        self.found = Longest([*rules.boundaries, *self.names] if self.names else [])

    def spans(self, text: str | None) -> Iterator[tuple[int, int, str, str]]:
        """(start, end, course, full or alias), leftmost and longest first."""
        for s, e in self.found.spans(text):
            if (name := self.names.get(word := text[s:e])) and word not in self.rules.boundaries:
                yield s, e, name, "alias" if word in self.rules.nicknames else "full"

    def _in_context(self, text: str, start: int, end: int) -> bool:
        around = text[max(0, start - self.rules.near) : start] + "\n" + text[end : end + self.rules.near]
        line = text[text.rfind("\n", 0, start) + 1 : start].strip()
        return any(w in around for w in self.rules.context) or line in ("-", "–", "—", "•", "·", "*")

    def match(self, text: str | None, allow_short: bool = False) -> set[str]:
        return {name for s, e, name, _ in self.spans(text) if e - s > 2 or text[s:e] in self.rules.nicknames or (allow_short and self._in_context(text, s, e))}

    def match_contextual(self, text: str | None) -> set[str]:
        """Names that are used as courses: in context, and not as a field of study."""
        return {name for s, e, name, _ in self.spans(text) if self._in_context(text, s, e) and not text[e:].startswith(self.rules.not_before)}


class Highlighter:
    """Spans of courses and of teachers. A teacher counts if a course of the text is theirs or a
    title follows; initials of two letters must be capitals. initials: (teacher, initials) pairs."""

    def __init__(self, rows: Iterable[tuple[str, str]], rules: Rules = Rules(), initials: Iterable[tuple[str, str]] = ()):  # noqa: B008
        rows = list(rows)
        self.matcher, self.rules = Matcher([("", name) for name, _ in rows], rules), rules
        self.teachers: dict[str, set[str]] = {}
        for name, teachers in rows:
            for x in re.split(r"[,，]", teachers or ""):
                if who := re.sub(r"[(（].*?[)）]", "", x).strip():
                    self.teachers.setdefault(who, set()).add(name)
        self.initials: dict[str, set[str]] = {}
        for who, short in initials:
            self.initials.setdefault(short.lower(), set()).add(who)
        self.people = Longest(self.teachers)

    def match(self, text: str | None, courses: set[str]) -> list[tuple[int, int, str, str]]:
        text = text or ""
        found = [(s, e, "course", kind) for s, e, name, kind in self.matcher.spans(text) if name in courses]
        people = [(s, e, {text[s:e]}, "full") for s, e in self.people.spans(text)]
        for m in re.finditer(r"(?<![A-Za-z])[A-Za-z]{2,4}(?![A-Za-z])", text):
            if (who := self.initials.get(m[0].lower())) and (len(m[0]) > 2 or m[0].isupper()):
                people.append((m.start(), m.end(), who, "alias"))
        for s, e, who, kind in people:
            own = any(self.teachers.get(w, set()) & courses for w in who)
            if own or text[e:].startswith(self.rules.titles):
                found.append((s, e, "teacher", kind))
        out: list[tuple[int, int, str, str]] = []
        for x in sorted(found, key=lambda x: (x[0], -x[1])):
            if not out or x[0] >= out[-1][1]:
                out.append(x)
        return out


def _held(rows: DataFrame, most: int) -> list | None:
    """Distinct rows, sorted, if they may be broadcast: no more than `most` and MOST_BYTES of text in
    all, by a count before anything is collected; else None."""
    rows = rows.distinct()
    size = sum((F.coalesce(F.octet_length(x), F.lit(0)) for x, kind in rows.dtypes if kind == "string"), F.lit(0))
    n, held = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return sorted(rows.collect(), key=lambda r: tuple((x is not None, x) for x in r)) if n <= most and held <= MOST_BYTES else None


def _bare(name: Column) -> Column:
    return F.translate(name, "（）()", "")


def _occurring(entries: DataFrame, surfaces: DataFrame, gram: int = 12) -> DataFrame:
    """entry_key and the columns of surfaces: which of a dictionary's surfaces (column surface) stand in
    an entry, a row for each place."""
    met = _gram_join(entries, surfaces.where(F.length("surface") > 0), "entry_key", "content", "surface", gram)
    met = met.join(entries.select("entry_key", F.col("content").alias("_text")), "entry_key")
    return met.where(F.expr("substring(_text, _at + 1, length(surface))") == F.col("surface")).select("entry_key", *surfaces.columns)


def _meanings(rows: DataFrame) -> DataFrame:
    """surface (unique) and name: what a word stands for in a Matcher of all rows (code, name). The last row
    that has it as its name or code counts, else the first whose name it is without brackets."""
    form = lambda x, own: F.struct(x.alias("surface"), F.lit(own).alias("own"))
    forms = F.array(form(F.col("name"), True), form(_bare(F.col("name")), False), form(F.when(F.col("code").rlike(r"(?U)\A\d{8}\z"), F.col("code")), True))
    each = rows.select(F.struct("code", "name").alias("row"), F.inline(forms)).where(F.length("surface") > 0)
    ends = each.groupBy("surface").agg(F.max(F.when(F.col("own"), F.col("row"))).alias("last"), F.min(F.when(~F.col("own"), F.col("row"))).alias("first"))
    return ends.select("surface", F.coalesce("last", "first")["name"].alias("name"))


def tag_courses(entries: DataFrame, names: DataFrame, rules: Rules = Rules(), allow_short: bool = True, most: int = MOST_NAMES) -> DataFrame:  # noqa: B008
    """entry_key and course_name for each course that an entry names; names: code, name.

    A dictionary of up to `most` names and MOST_BYTES is broadcast. Of a larger one each entry is given
    the surfaces that stand in it, found by a join of hashes, each with the one name that it stands for
    (a name may have any number of codes), and is matched with those: which of the names in a text win
    depends on names in that text alone, so both ways say the same."""
    rows = names.select("code", "name")
    if (got := _held(rows, most)) is not None:
        held = entries.sparkSession.sparkContext.broadcast(Matcher([(r[0], r[1]) for r in got], rules))
        return entries.select("entry_key", "content").mapInPandas(_tagged(lambda _: held.value, allow_short), "entry_key string, course_name string")
    found = _occurring(entries, _meanings(rows)).groupBy("entry_key").agg(F.collect_set(F.struct("surface", "name")).alias("_rows"))
    own = entries.select("entry_key", "content").join(found, "entry_key", "left")
    return own.mapInPandas(_tagged(lambda xs: Matcher((), rules, dict(_pairs(xs, "surface", "name"))), allow_short), "entry_key string, course_name string")


def _pairs(rows, *names: str) -> list[tuple]:
    """A text's rows of a dictionary, sorted as the whole one is."""
    got = [tuple(r[x] for x in names) for r in (rows if rows is not None else ())]
    return sorted(got, key=lambda r: tuple((x is not None, x) for x in r))


def _tagged(matcher, allow_short: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = pdf["_rows"] if "_rows" in pdf else [None] * len(pdf)
            rows = [(k, c) for k, t, xs in zip(pdf["entry_key"], pdf["content"], own, strict=True) for c in sorted(matcher(xs).match(t, allow_short))]
            yield pd.DataFrame(rows, columns=["entry_key", "course_name"])

    return run


def highlight(entries: DataFrame, listings: DataFrame, initials: DataFrame | None = None, rules: Rules = Rules(), most: int = MOST_NAMES) -> DataFrame:  # noqa: B008
    """entry_key with highlights; entries: entry_key, content, courses (array); listings: course_name,
    teacher; initials: teacher, initials. Larger dictionaries as in tag_courses: an entry is given the
    courses and teachers that stand in it, spelled out or by initials, and of a teacher's courses
    those that are the entry's."""
    texts, both = entries.select("entry_key", "content", "courses"), listings.select("course_name", "teacher")
    schema = f"entry_key string, highlights {HIGHLIGHTS}"
    got, short = _held(both, most), _held(initials.select("teacher", "initials"), most) if initials is not None else []
    if got is not None and short is not None:
        held = entries.sparkSession.sparkContext.broadcast(Highlighter([(r[0], r[1]) for r in got], rules, [(r[0], r[1]) for r in short]))
        return texts.mapInPandas(_highlighted(lambda *_: held.value), schema)
    both = table(both.distinct(), "listings")
    who = F.transform(F.split("teacher", "[,，]"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[(（].*?[)）]", ""), r"(?U)^\s+|\s+$", ""))
    teaching = both.select("course_name", F.explode(who).alias("teacher")).where("teacher <> ''").distinct()
    names = both.where(F.length("course_name") > 0).select("course_name", F.explode(F.array_distinct(F.array("course_name", _bare(F.col("course_name"))))).alias("surface")).distinct()
    courses = _occurring(texts, names).select("entry_key", "course_name", F.lit(None).cast("string").alias("teacher"))
    people = _occurring(texts, teaching.select(F.col("teacher").alias("surface")).distinct()).select("entry_key", F.col("surface").alias("teacher")).distinct()
    spelled = None
    if initials is not None:
        words = texts.select("entry_key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("(?<![a-z])([a-z]{2,4})(?![a-z])"), 1))).alias("initials"))
        spelled = words.join(initials.select("teacher", F.lower("initials").alias("initials")).distinct(), "initials").select("entry_key", "teacher", "initials")
        people = people.union(spelled.select("entry_key", "teacher")).distinct()
    own = texts.select("entry_key", F.explode("courses").alias("course_name")).distinct()
    # an entry's people with its courses first: a teacher may have any number of courses
    taught = people.join(own, "entry_key").join(teaching, ["course_name", "teacher"]).select("entry_key", "course_name", "teacher")
    rows = courses.union(taught).union(people.select("entry_key", F.lit(None).cast("string"), "teacher"))
    found = rows.groupBy("entry_key").agg(F.collect_set(F.struct("course_name", "teacher")).alias("_rows"))
    given = texts.join(found, "entry_key", "left")
    if spelled is not None:
        given = given.join(spelled.groupBy("entry_key").agg(F.collect_set(F.struct("teacher", "initials")).alias("_short")), "entry_key", "left")
    return given.mapInPandas(_highlighted(lambda xs, ys: Highlighter(_pairs(xs, "course_name", "teacher"), rules, _pairs(ys, "teacher", "initials"))), schema)


def _highlighted(highlighter):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("start_offset", "end_offset", "entity_type", "match_kind")
        for pdf in frames:
            own, short = (pdf[x] if x in pdf else [None] * len(pdf) for x in ("_rows", "_short"))
            found = [[dict(zip(names, x, strict=True)) for x in highlighter(xs, ys).match(t, set(c if c is not None else ()))] for t, c, xs, ys in zip(pdf["content"], pdf["courses"], own, short, strict=True)]
            yield pd.DataFrame({"entry_key": pdf["entry_key"], "highlights": found})

    return run


def _slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches (key, text) cut into neighbours of about `most` bytes of text (one larger text stands
    alone), so that what is found in them never depends on the number of rows of a batch. What the
    last batch took is given back at the end: workers outlive their tasks."""
    try:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), b.num_rows]):
                yield b.slice(lo, hi - lo)
    finally:
        pa.default_memory_pool().release_unused()


def longest_matches(texts: DataFrame, key: str, text: str, names: DataFrame, name: str = "name", most: int = MOST_NAMES, gram: int = 12) -> DataFrame:
    """key (unique), name, start (0-based code point), end of leftmost-longest occurrences of names. Up to
    `most` distinct names go into a broadcast automaton; more of them are joined by hashes of their
    first `gram` characters, and each text's occurrences are then thinned out, longest first."""
    kind = dict(texts.dtypes)[key]
    rows = names.where(F.length(name) > 0).select(F.col(name).alias("name")).distinct()
    schema = f"`{key}` {kind}, name string, start long, end long"
    if (got := _held(rows, most)) is not None:
        held = texts.sparkSession.sparkContext.broadcast(Longest(r[0] for r in got))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                found = [(i, t[s:e], s, e) for i, t in enumerate(b.column(1).to_pylist()) for s, e in held.value.spans(t)]
                of, met, starts, ends = zip(*found, strict=True) if found else ((), (), (), ())
                columns = [b.column(0).take(pa.array(of, pa.int64())), pa.array(met, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "name", "start", "end"])

        return texts.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
    met = _gram_join(texts, rows, key, text, "name", gram).join(texts.select(key, F.col(text).alias("_text")), key)
    met = met.where(F.expr("substring(_text, _at + 1, length(name))") == F.col("name"))
    # the longest name at each place; a text's occurrences are no more than its characters
    best = met.groupBy(key, "_at").agg(F.max(F.struct(F.length("name").alias("n"), "name")).alias("m")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "m.n", "m.name"))).alias("_found"))

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, found in zip(pdf[key], pdf["_found"], strict=True):
                free = 0
                for f in found:
                    if f["_at"] >= free:
                        free = f["_at"] + f["n"]
                        out.append((k, f["name"], f["_at"], free))
            yield pd.DataFrame(out, columns=[key, "name", "start", "end"])

    return best.mapInPandas(thin, schema)


def _grams(texts: list[str], sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of sizes the places, in the texts put end to end, where so many characters of one text
    begin, and their hashes (a polynomial in the code points, its bits spread)."""
    sizes, lengths = set(sizes), np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left, h = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes)), np.zeros(len(codes) + 1, np.uint64)
    for n in range(1, min(max(sizes, default=0), len(codes)) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in sizes:
            at = np.flatnonzero(left[: len(h)] >= n)
            x = h[at] + np.uint64(n)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            yield n, at, x ^ (x >> np.uint64(31))


def _first_grams(names: DataFrame, name: str, gram: int) -> DataFrame:
    """names with _n, the number of their first characters that are hashed, and the hash _gram."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            heads = [x[:gram] for x in pdf[name]]
            lengths = np.fromiter(map(len, heads), np.int64, len(heads))
            starts, hashes = np.cumsum(lengths) - lengths, np.zeros(len(heads), np.uint64)
            for n, at, x in _grams(heads, lengths.tolist()):
                hashes[lengths == n] = x[np.searchsorted(at, starts[lengths == n])]
            yield pdf.assign(_n=lengths.astype(np.int32), _gram=hashes.view(np.int64))

    schema = ", ".join(f"`{x}` {kind}" for x, kind in names.dtypes)
    return names.mapInPandas(run, f"{schema}, _n int, _gram long")


def _bits(known: DataFrame, grams: int) -> np.ndarray:
    """A bit map of the hashes _gram, two bits each, by which most places where none stands are told. No larger
    than 1 << MOST_BITS bits, so with very many hashes it tells less, and the join does the rest."""
    size = 1 << min(MOST_BITS, max(16, (16 * grams).bit_length()))
    slots = known.select(F.explode(F.array(F.col("_gram"), F.shiftrightunsigned("_gram", 32))).alias("x")).select(F.col("x").bitwiseAND(size - 1).alias("x"))
    words = slots.groupBy(F.shiftright("x", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _gram_join(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, gram: int) -> DataFrame:
    """key, _at and the names' columns where the first `gram` characters (all, of shorter names) of a
    name stand at a place, by their hash. Of the texts only keys, places and hashes are shuffled, and
    of these only the ones that a bit map of the names' hashes lets through; the names are written
    first, so that adaptive execution can split a hot one."""
    known = table(_first_grams(names, name, gram), "names")
    sizes = {r["_n"]: r["n"] for r in known.groupBy("_n").agg(F.count_distinct("_gram").alias("n")).collect()}  # at most `gram` numbers
    held = texts.sparkSession.sparkContext.broadcast(_bits(known, sum(sizes.values())))

    def may(h: np.ndarray) -> np.ndarray:
        out, last = np.ones(len(h), bool), np.uint64(held.value.size * 64 - 1)
        for x in (h & last, (h >> np.uint64(32)) & last):
            out &= (held.value[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1
        return out

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> Iterator[pd.DataFrame]:
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            starts = np.cumsum(lengths) - lengths
            for _, at, h in _grams(pieces, sizes):
                fits = may(h)
                at, h = at[fits], h[fits]
                of = np.searchsorted(starts, at, "right") - 1
                own = at - starts[of] < np.array(counts)[of]
                at, h, of = at[own], h[own], of[own]
                yield pd.DataFrame({key: np.array(keys, object)[of], "_at": np.array(los)[of] + at - starts[of], "_gram": h.view(np.int64)})
            for x in (keys, los, counts, pieces):
                x.clear()

        keys, los, counts, pieces, most = [], [], [], [], max(sizes, default=0)
        for pdf in frames:
            held_back = 0
            for k, t in zip(pdf[key], pdf[text], strict=True):
                for lo in range(0, len(t or ""), 100_000):
                    keys.append(k)
                    los.append(lo)
                    counts.append(min(100_000, len(t) - lo))  # what follows a piece is read for the names that cross its end
                    pieces.append(t[lo : lo + 100_000 + most - 1])
                    held_back += len(pieces[-1])
                    if held_back > 200_000:
                        yield from flush()
                        held_back = 0
            if pieces:
                yield from flush()

    kind = dict(texts.dtypes)[key]
    places = texts.select(key, text).mapInPandas(grams, f"`{key}` {kind}, _at long, _gram long")
    return places.join(known.drop("_n"), "_gram").drop("_gram")


def spans_of(text: Column, needle: Column) -> tuple[Column, Column]:
    """Half-open code point span of a needle's first occurrence; NULL without one."""
    at = F.nullif(F.instr(text, needle), F.lit(0)) - 1
    return at, at + F.length(needle)


def entity_pairs(texts: DataFrame, names: DataFrame, key: str, text: str, name_key: str, name: str, most: int = MOST_NAMES, gram: int = 12) -> DataFrame:
    """key and name_key of each text and each name that it holds. Up to `most` names go into a
    broadcast automaton that reads every text once; more of them are joined by hashes of their first
    `gram` characters (of all, for shorter names), and the whole name is checked then."""
    kinds = f"`{key}` {dict(texts.dtypes)[key]}, `{name_key}` {dict(names.dtypes)[name_key]}"
    rows = names.where(F.length(name) > 0).select(name_key, name)
    if (got := _held(rows, most)) is not None:
        automaton = ahocorasick.Automaton()
        for k, n in got:
            automaton.add_word(n, automaton.get(n, ()) + (k,))
        if got:
            automaton.make_automaton()
        held = texts.sparkSession.sparkContext.broadcast(automaton)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                found = [(k, x) for k, t in zip(pdf[key], pdf[text], strict=True) if t and len(held.value) for x in sorted({x for _, xs in held.value.iter(t) for x in xs})]
                yield pd.DataFrame(found, columns=[key, name_key])

        return texts.select(key, text).mapInPandas(run, kinds)
    met = _gram_join(texts, rows, key, text, name, gram).select(key, name_key, F.col(name).alias("_name")).distinct()
    return met.join(texts.select(key, text), key).where(F.contains(text, "_name")).select(key, name_key).distinct()


def teacher_initials(teachers: DataFrame, syllables: DataFrame, noise: Iterable[str] = ("lz", "dz", "ddl", "ppt", "gpa", "sky")) -> DataFrame:
    """teacher and initials: the first letters of the syllables (letter, syllable) of a name's
    characters, in order; a row for each choice where characters have several. Names with a character
    that has no syllable, names of one character or of over eight, and initials that mean something
    else get none."""
    names = teachers.select("teacher").where(F.length("teacher").between(2, MOST_SYLLABLES)).distinct()
    spelled = names.select("teacher", F.posexplode(F.filter(F.split("teacher", ""), lambda x: x != "")).alias("at", "letter"))
    first = syllables.where(F.length("syllable") > 0).groupBy("letter").agg(F.array_sort(F.collect_set(F.lower(F.substring("syllable", 1, 1)))).alias("firsts"))
    joined = spelled.join(first, "letter", "left")
    one = joined.groupBy("teacher").agg(F.array_sort(F.collect_list(F.struct("at", "firsts"))).alias("xs"), F.count("firsts").alias("known"), F.count("*").alias("n"))
    grown = F.aggregate("xs", F.array(F.lit("")), lambda got, x: F.flatten(F.transform(got, lambda head: F.transform(x["firsts"], lambda v: F.concat(head, v)))))
    out = one.where("known = n").select("teacher", F.explode(F.array_distinct(grown)).alias("initials"))
    return out.where(~F.col("initials").isin(*noise))


#: Words of a text, and neighbouring pairs of Chinese characters.
WORDS, PAIRS = "[a-z0-9]+", "(?=([\\u4e00-\\u9fff]{2}))"


def features(text: str | Column) -> Column:
    """Distinct words (lower case, ASCII) and character pairs of a text."""
    x = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.array_distinct(F.concat(F.regexp_extract_all(x, F.lit(WORDS), 0), F.regexp_extract_all(x, F.lit(PAIRS), 1)))


@dataclass(frozen=True)
class Classifier:
    """A naive Bayes model learned from labelled texts: weights (feature, and the log-probability of
    the feature under each kind) and the kinds' log-priors. Scores are sums over a text's distinct
    features that training has seen; the kind with the highest wins, the first of equals."""

    kinds: tuple[str, ...]
    priors: tuple[float, ...]
    weights: DataFrame

    @staticmethod
    def learn(labelled: DataFrame, smooth: float = 1.0) -> Classifier:
        """labelled: text and kind; rows without a kind go. Counts are grouped sums over all rows."""
        rows = labelled.where("kind IS NOT NULL").select("kind", features("text").alias("f"))
        numbers = sorted((r["kind"], r["n"]) for r in rows.groupBy("kind").agg(F.count("*").alias("n")).limit(MOST_KINDS + 1).collect())
        if not 0 < len(numbers) <= MOST_KINDS:
            raise ValueError(f"{len(numbers)} kinds: 1 to {MOST_KINDS} are possible")
        kinds, total = tuple(k for k, _ in numbers), sum(n for _, n in numbers)
        grid = rows.select("kind", F.explode("f").alias("feature")).groupBy("feature").agg(*(F.count_if(F.col("kind") == k).alias(f"n{i}") for i, k in enumerate(kinds)))
        grid = table(grid, "feature-counts")
        sums = grid.agg(F.count("*").alias("size"), *(F.sum(f"n{i}").alias(f"s{i}") for i in range(len(kinds)))).first()
        weight = lambda i: F.log((F.col(f"n{i}") + smooth) / F.lit((sums[f"s{i}"] or 0) + smooth * max(1, sums["size"]))).alias(f"w{i}")
        return Classifier(kinds, tuple(float(np.log(n / total)) for _, n in numbers), table(grid.select("feature", *(weight(i) for i in range(len(kinds)))), "weights"))

    def classify(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """key (unique), kind and margin (by how much it leads) of each row."""
        found = rows.select(key, F.explode(features(text)).alias("feature")).join(self.weights, "feature")
        sums = found.groupBy(key).agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(len(self.kinds))))
        scores = F.array(*(F.coalesce(f"w{i}", F.lit(0.0)) + F.lit(p) for i, p in enumerate(self.priors)))
        named = rows.select(key).join(sums, key, "left").withColumn("_s", scores)
        best = F.array_max("_s")
        second = F.element_at(F.sort_array("_s", asc=False), 2) if len(self.kinds) > 1 else best
        return named.select(key, F.element_at(F.array(*map(F.lit, self.kinds)), F.array_position("_s", best).cast("int")).alias("kind"), (best - second).alias("margin"))


def kept_replies(replies: DataFrame, posts: DataFrame) -> DataFrame:
    """Useful replies (pid, cid, content, courses, useful) of posts that are kept (pid, courses). A
    reply that names no course takes the post's, if that has exactly one."""
    rows = replies.where("useful").drop("useful").join(posts.select("pid", F.col("courses").alias("_post")), "pid")
    own = F.coalesce("courses", F.array().cast("array<string>"))
    return rows.withColumn("courses", F.when((F.size(own) == 0) & (F.size("_post") == 1), F.col("_post")).otherwise(own)).drop("_post")
