"""Alias mining: alignment against all alignments, association against counts by hand."""

import itertools
import math
import random

import pytest

from loomcat.operators import aliases

SCHEMA = "entry_key string, course_name string, teachers array<string>, content string, alias string, ratio int"
#: Entries and the relations that must and must not come out.
ENTRIES = [
    ("软件设计实践", ["谢涛", "马郓"], "软件设计实践/软设 谢涛，马郓 xt my"),
    ("普通生物学(C)", ["罗述金(教授)"], "普通生物学(C)/普生C 罗述金 ppt sky"),
    ("经济学", ["刘俏", "王辉", "陈玉宇"], "经济学 刘俏 王辉 陈玉宇 lq wh cyy"),
]
RELATIONS = {("软设", "course", "软件设计实践"), ("普生C", "course", "普通生物学(C)"), ("xt", "teacher", "谢涛"), ("my", "teacher", "马郓"), ("lq", "teacher", "刘俏"), ("wh", "teacher", "王辉"), ("cyy", "teacher", "陈玉宇")}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def relations(df):
    return {(r.alias, r.entity_type, r.canonical_name) for r in df.collect()}


def test_relations(spark):
    rows = [(f"p{k}{n}", *x) for n in range(2) for k, x in enumerate(ENTRIES)]
    assert relations(aliases.mine(frame(spark, rows))) == RELATIONS


def all_best(names, words):
    """Pairs that all alignments of the highest score have, by trying every one."""
    found = []
    for k in range(min(len(names), len(words)) + 1):
        for a in itertools.combinations(range(len(names)), k):
            for b in itertools.combinations(range(len(words)), k):
                each = [aliases.fits(names[i], words[j], {}) for i, j in zip(a, b, strict=True)]
                if None not in each:
                    found.append((sum(each) - aliases.SKIP * (len(names) + len(words) - 2 * k), set(zip(a, b, strict=True))))
    top = max(x for x, _ in found)
    return sorted(set.intersection(*(p for x, p in found if abs(x - top) < 1e-9)))


@pytest.mark.parametrize("seed", range(60))
def test_alignment_is_what_all_best_ones_share(seed):
    rng = random.Random(seed)
    names = [rng.choice(["山水", "木火土", "石", "Ann Bo", "Cy"]) + str(i)[:0] for i in range(rng.randint(0, 5))]
    words = [rng.choice(["ab", "abc", "abcd"]) for _ in range(rng.randint(0, 5))]
    want = [(names[i], words[j]) for i, j in all_best(names, words)]
    assert aliases.aligned(names, words) == want


def test_runs_readings_and_noise():
    assert aliases.runs("王辉 wh 陈玉宇 cyy ddl", ["王辉", "陈玉宇(x)", None], {"ddl"}) == [(["王辉"], ["wh"]), (["陈玉宇"], ["cyy"])]
    assert aliases.runs("lq 王辉", ["王辉"], ()) == [] == aliases.runs("wh", [], ())
    assert aliases.aligned(["王辉", "单乐"], ["sl"]) == []  # either may be meant
    assert aliases.aligned(["王辉", "单乐"], ["sl"], {"单乐": {"sl", "dl", "sy"}, "王辉": {"wh"}}) == [("单乐", "sl")]


def test_all_occurrences_and_forms():
    text = "Tides/td then Tides（Td2）, ebb/Tides|flow and a\\Eb(/x Tides/waytoolongaword Tides"
    assert aliases.beside(text, "Tides") == ["td", "Td2", "flow", "ebb"]
    assert aliases.beside("a\\Eb(/xy", "a\\Eb(") == ["xy"]


def test_association_and_ties(spark):
    say = lambda k, course, text: (f"e{k}", course, [], text)
    rows = [say(k, "Law", "Law/lw") for k in range(6)] + [say(k, "Sea", "Sea/lw") for k in range(6, 9)] + [say(k, "Sea", "Sea/se Sea/se") for k in range(9, 14)]
    rows += [say(k, c, f"{c}/tie") for k, c in zip(range(20, 24), ("Up", "Up", "Low", "Low"), strict=True)] + [say(30, "Mid", "Mid/once"), (None, "Up", None, "Up/once"), ("n", None, None, None), say(0, "Law", "Law/lw")]
    got = {r.alias: r for r in aliases.mine(frame(spark, rows)).collect()}
    assert set(got) == {"lw", "se"} and got["lw"].canonical_name == "Law" and got["lw"].evidence_count == 6
    n, a, b, t = 6, 9, 6, 20
    cells = [(n, a, b), (a - n, a, t - b), (b - n, t - a, b), (t - a - b + n, t - a, t - b)]
    assert got["lw"].ratio == pytest.approx(2 * sum(k * math.log(k * t / (x * y)) for k, x, y in cells if k))


def test_what_all_entries_say_stands(spark):
    assert relations(aliases.mine(frame(spark, [(f"e{k}", "Law", None, "Law/lw") for k in range(2)]))) == {("lw", "course", "Law")}
    assert aliases.mine(frame(spark, []).limit(0)).count() == 0


def test_readings_come_as_a_table(spark):
    rows = [(f"e{k}", "x", ["单乐(讲师)", "王辉"], f"单乐 王辉 {'dl wh' if k % 2 else 'xx wh'} {k}") for k in range(8)] + [(f"o{k}", "y", ["石山"], "石山 tt") for k in range(8)]
    known = spark.createDataFrame([("单乐", "SL"), ("单乐", "dl"), ("王辉", "wh")], "teacher string, initials string")
    got = relations(aliases.mine(frame(spark, rows), known))
    assert ("dl", "teacher", "单乐") in got and ("wh", "teacher", "王辉") in got and not any(x[0] == "xx" for x in got)


# ---- dictionaries beyond a broadcast


def courses_and_texts(seed):
    rng = random.Random(seed)
    names = ["海洋地图学", "海洋地图学进阶", "海洋", "潮汐", "Knots（II）", "Knots", "Knots(II)", "Law", "Law and Order", "航"]
    rows = [(rng.choice([None, "90000001", "9000", f"9{i:07d}"]), n) for i, n in enumerate(names)] + [(None, None), ("90000009", "")]
    bits = [*names, "KnotsII", "90000001", "90000003", "课", "老师", " ", "\n", "•", "and", "王石", "李水", "李水山", "Ada Quill", "adq", "AQ", "aq", "ws", "\U0001f30a"]
    texts = [(f"e{i}", "".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 9))), rng.sample(names, rng.randint(0, 4)) if rng.random() < 0.8 else None) for i in range(150)]
    return rows, texts + [("n", None, None), ("n2", "", [])]


@pytest.mark.parametrize("seed", range(3))
def test_tags_are_the_same_on_both_sides_of_the_limit(spark, seed):
    from loomcat.operators import mining

    rows, texts = courses_and_texts(seed)
    rules = mining.Rules(nicknames={"地图": "海洋地图学", "gone": "Virtual"}, boundaries=("and Order",))
    names = spark.createDataFrame(rows + rows[:3], "code string, name string")
    entries = spark.createDataFrame(texts, "entry_key string, content string, courses array<string>").repartition(3)
    near, far = (sorted(map(tuple, mining.tag_courses(entries, names, rules, most=most).collect())) for most in (1000, 0))
    assert near == far and near
    matcher = mining.Matcher(sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)), rules)
    assert near == sorted((k, c) for k, t, _ in texts for c in matcher.match(t, True))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("with_initials", [True, False])
def test_highlights_are_the_same_on_both_sides_of_the_limit(spark, seed, with_initials):
    from loomcat.operators import mining

    rows, texts = courses_and_texts(seed)
    rng = random.Random(seed)
    listings = spark.createDataFrame([(n, rng.choice([None, "李水(教授)，王石", "李水山", "Ada Quill, 王石", ""])) for _, n in rows for _ in range(2)], "course_name string, teacher string")
    initials = spark.createDataFrame([("Ada Quill", "adq"), ("Ada Quill", "AQ"), ("王石", "ws"), ("Nobody", "aq")], "teacher string, initials string") if with_initials else None
    entries = spark.createDataFrame(texts, "entry_key string, content string, courses array<string>")
    near, far = ({r.entry_key: [tuple(x) for x in r.highlights] for r in mining.highlight(entries, listings, initials, most=most).collect()} for most in (1000, 0))
    assert near == far and set(near) == {x[0] for x in texts} and any(near.values())


def test_dictionaries_are_bounded_in_bytes(spark, monkeypatch):
    from loomcat.operators import mining

    names = spark.createDataFrame([("long name " * 20,), ("x",)], "name string")
    assert [r.name for r in mining._held(names, 5)] == ["long name " * 20, "x"] and mining._held(names, 1) is None
    monkeypatch.setattr(mining, "MOST_BYTES", 100)
    assert mining._held(names, 5) is None
    texts = spark.createDataFrame([(1, "a x " + "long name " * 21)], "k long, t string")
    assert {(r.name, r.start) for r in mining.longest_matches(texts, "k", "t", names).collect()} == {("x", 2), ("long name " * 20, 4)}


def test_a_text_is_given_one_meaning_of_a_name_with_many_codes(spark, monkeypatch):
    from loomcat.operators import mining

    names = spark.createDataFrame([(f"9{i:07d}", "Tides") for i in range(300)] + [("٩٠٠٠٠٠٠١", "Knots"), ("90000001\n", "Law"), ("90000299", None), (None, "90000005"), (None, "Kn(ots)"), ("1", "Kn（ots）")], "code string, name string")
    entries = spark.createDataFrame([("a", "Tides, Tides and 90000007"), ("b", "٩٠٠٠٠٠٠١ 90000001\n 90000299 90000005 Knots"), (None, None)], "entry_key string, content string")
    near, far = (sorted(map(tuple, mining.tag_courses(entries, names, most=most).collect())) for most in (10_000, 0))
    assert near == far and ("b", "Knots") in far and ("a", "Tides") in far

    def count(matcher, allow_short):
        def run(frames):
            for pdf in frames:
                yield pdf.assign(course_name=[str(len(x) if x is not None else 0) for x in pdf["_rows"]])[["entry_key", "course_name"]]

        return run

    monkeypatch.setattr(mining, "_tagged", count)
    assert {r.entry_key: int(r.course_name) for r in mining.tag_courses(entries, names, most=0).collect()} == {"a": 2, "b": 5, None: 0}


def test_places_of_long_texts_and_the_bit_map(spark):
    import re

    import numpy as np

    from loomcat.operators import mining

    long = "🌊b " * 33_332 + "b 🌊Tides of the North" + "x" * 99_990 + "a🌊 end"
    texts = spark.createDataFrame([(1, long), (2, "a"), (3, ""), (4, None), (5, "a🌊")], "k long, t string")
    words = ["Tides of the North", "Tides of the South", "a🌊", "end", "a"]
    met = mining._gram_join(texts, spark.createDataFrame([(w,) for w in words], "name string"), "k", "t", "name", 12)
    want = sorted((k, m.start(), w) for k, t in ((1, long), (2, "a"), (5, "a🌊")) for w in words for m in re.finditer(re.escape(w[:12]), t))
    assert sorted((r.k, r._at, r.name) for r in met.collect()) == want
    known = mining._first_grams(spark.createDataFrame([(f"name {i}",) for i in range(5000)], "name string"), "name", 12)
    bits = mining._bits(known, 5000)
    held = lambda h: all(bits[(x & (bits.size * 64 - 1)) >> 6] >> np.uint64(x & 63) & np.uint64(1) for x in (h, h >> 32))
    assert all(held(r._gram % (1 << 64)) for r in known.collect())
    assert sum(held(int(h)) for h in np.random.default_rng(1).integers(0, 1 << 63, 5000)) < 250


def test_matching_holds_few_texts_at_a_time(spark):
    import pyarrow as pa

    from loomcat.operators import mining

    batch = pa.RecordBatch.from_pydict({"k": list(range(3000)), "t": ["ab the " * 150, None, ""] * 1000})
    parts = list(mining._slices(iter([batch, batch.slice(0, 0)]), 50_000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 20
    assert max(sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts) < 100_000
    texts = spark.createDataFrame([("a", "🌊 the then"), (None, "the"), ("c", None), ("d", "x" * 2_000_000 + "the"), ("e", "")], "k string, t string").coalesce(1)
    got = mining.longest_matches(texts, "k", "t", spark.createDataFrame([("the",), ("then",)], "name string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "the", 2, 5), ("a", "then", 6, 10), (None, "the", 0, 3), ("d", "the", 2_000_000, 2_000_003)], key=str)
