import pytest
from pyspark.sql import functions as F

from loomcat.functions import text as t
from loomcat.functions.params import Page, ParameterError, Search, message_text, review_query, split_id
from loomcat.operators import catalog
from loomcat.operators.catalog import COURSE

COLUMNS = ["id", "local_id", "level", *catalog.BASIC, "english_name", "grading", "language", "audience", "display_course_name", "display_classroom", "display_notes", "completeness"]
KIND = {"local_id": "long", "completeness": "long", "credits": "double", "first_period": "int"}


def source(spark, *rows):
    schema = ", ".join(f"{c} {KIND.get(c, 'string')}" for c in COLUMNS)
    base = {"level": "a", "course_code": "c", "class_no": "1", "teacher": "T", "completeness": 1}
    full = [base | r for r in rows]
    return catalog.with_group_key(spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in full], schema))


def test_fold_is_ascii_only(spark):
    rows = spark.createDataFrame([("ABC",), ("É",), ("é",), ("100%",), ("a_b",), ("a\\b",), (None,)], "x string")
    hit = lambda n: sorted(r.x for r in rows.where(t.contains("x", n)).collect())
    assert hit("b") == ["ABC", "a\\b", "a_b"] and hit("é") == ["é"] and hit("É") == ["É"]
    assert hit("%") == ["100%"] and hit("_") == ["a_b"] and hit("\\") == ["a\\b"]


def test_blank_kinds(spark):
    r = spark.createDataFrame([(" ", "\t", "\xa0", None)], "a string, b string, c string, d string")
    got = r.select(*(t.filled(x).alias(x) for x in r.columns)).first()
    assert (got.a, got.b, got.c, got.d) == (False, True, True, False)  # only U+0020 is a space here
    assert r.select(t.stripped("b").alias("b"), t.stripped("c").alias("c")).first() == ("", "")


def test_normalise():
    assert t.normalise(" ＡＢ（上） 高·数 ") == "ab(上)高数" and t.normalise("·-— ") == ""


def test_fallback_fills_as_a_whole(spark):
    rows = [
        {"id": "a1", "local_id": 1, "completeness": 10, "major": " ", "grade": None, "course_type": "X", "category": "b"},
        {"id": "a2", "local_id": 2, "completeness": 8, "major": "Brewing", "grade": "4", "course_type": "Y", "category": "a"},
        {"id": "a3", "local_id": 3, "completeness": 7, "major": "Weaving", "grade": "2", "course_type": "X", "category": "a,c"},
    ]
    card = catalog.cards(source(spark, *rows), F.lit(True)).first()
    assert (card.id, card.fallback_id, card.major, card.grade) == ("a1", "a2", "Brewing", "4")
    assert (card.course_type, card.category) == ("X,Y", "a,a,c,b")
    narrow = catalog.cards(source(spark, *rows), F.col("major") == "Weaving").first()
    assert narrow == card  # a filter picks groups and changes no card


def test_columns_that_fill_but_do_not_count(spark):
    rows = [{"id": "a1", "local_id": 1, "completeness": 5, "grading": ""}, {"id": "a2", "local_id": 2, "completeness": 4, "grading": "P"}]
    assert catalog.cards(source(spark, *rows), F.lit(True)).first().fallback_id is None
    rows[1]["credits"] = 2.0
    card = catalog.cards(source(spark, *rows), F.lit(True)).first()
    assert (card.fallback_id, card.grading, card.credits) == ("a2", "P", 2.0)


def test_blank_teachers_never_merge(spark):
    rows = [{"id": f"a{k}", "local_id": k, "teacher": who} for k, who in enumerate(["   ", "\t", None, "Teacher", "Teacher"])]
    keys = [r.group_key for r in source(spark, *rows).orderBy("local_id").collect()]
    assert len(set(keys)) == 4 and keys[0].endswith("\x1fa0") and keys[3] == keys[4]


def test_null_keys_are_counted_but_not_listed(spark):
    rows = source(spark, {"id": "a1", "local_id": 1, "course_code": None}, {"id": "a2", "local_id": 2})
    assert catalog.count_cards(rows, F.lit(True)).first().total == 2 and catalog.cards(rows, F.lit(True)).count() == 1


def test_count_plan_has_no_ranking(spark):
    plan = catalog.count_cards(source(spark, {"id": "a1", "local_id": 1}), F.lit(True))._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "Window" not in plan and "collect_set" not in plan


def test_translations(spark):
    rows = source(spark, *({"id": f"a{k}", "local_id": k, "course_name": "源"} for k in (1, 2, 3)))
    tr = spark.createDataFrame([(1, "course_name", "en", "   "), (2, "course_name", "en", " x "), (3, "course_name", "fr", "y"), (2, "secret", "en", "z")], "course_id long, field string, lang string, text string")
    shown = catalog.with_display(rows.drop("display_course_name", "display_classroom", "display_notes"), tr, "en")
    assert {r.local_id: r.display_course_name for r in shown.collect()} == {1: "源", 2: "x", 3: "源"}
    over = catalog.overlay(rows, tr, "en", "local_id")
    assert {r.local_id: r.course_name for r in over.collect()} == {1: "源", 2: " x ", 3: "源"}


def test_seeded_order_is_stable_and_differs(spark):
    ids = spark.createDataFrame([(f"{p}{k}",) for p in "ugsar" for k in range(1, 30)], "id string")
    orders = []
    for seed in (0, 1, -1, 52, 30011):
        by = [catalog.seeded(seed).asc(), F.col("id").asc()]
        one = [r.id for r in ids.orderBy(*by).collect()]
        assert one == [r.id for r in ids.repartition(5).orderBy(*by).collect()]
        orders.append(tuple(one))
        mul, add = (seed * 1664525) % 999983 or 7, (seed * 1013904223) % 999983
        off = {"g": 333331, "s": 666661, "a": 111113, "r": 444449}
        assert one == sorted(one, key=lambda i: ((int(i[1:]) * mul + off.get(i[0], 0) + add) % 999983, i))
    assert len(set(orders)) == 5


def test_pages_join_to_the_total(spark):
    rows = source(spark, *({"id": f"a{k}", "local_id": k, "class_no": str(k), "display_course_name": f"n{k % 7}" if k % 5 else ""} for k in range(23)))
    seen = []
    for p in range(1, 5):
        total, shown = catalog.search(rows, Search(page=Page(p, 7)))
        assert total.first().total == 23
        seen += [r.id for r in shown.collect()]
    assert len(seen) == 23 == len(set(seen)) and catalog.search(rows, Search(page=Page(9, 7)))[1].count() == 0
    down = [r.course_name for r in catalog.search(rows, Search(sort="name_desc", page=Page(1, 50)))[1].collect()]
    assert down[-5:] == [None] * 5  # a blank name that nothing fills is NULL


def test_summer_puts_sociology_first(spark):
    rows = source(spark, *({"id": f"s{k}", "local_id": k, "class_no": str(k), "level": "s", "course_name": n, "display_course_name": n, "department": d} for k, (n, d) in enumerate([("甲", "x"), ("b", "社会学系"), ("社会学导论", None)])))
    assert [r.id for r in catalog.search(rows, Search(term="summer"))[1].collect()][:2] == ["s1", "s2"]


def test_listings_of_all_levels(spark):
    basic = spark.createDataFrame([(7, "必修", "c1", "1", "名", 2.0, " ")], "id long, course_type string, course_code string, class_no string, course_name string, credits double, major string")
    for c in ("category", "teacher", "department", "grade", "schedule", "classroom", "weekdays", "enrollment", "pnp", "notes"):
        basic = basic.withColumn(c, F.lit(None).cast("string"))
    basic = basic.withColumn("first_period", F.lit(1))
    out = []
    for level in "ugsar":
        names = catalog.DETAIL[catalog.LEVELS[level]]
        detail = spark.createDataFrame([(7, *("d" for _ in names))], ", ".join(["course_id long", *(f"{n} string" for n in names)]))
        out.append(catalog.listings(basic, detail, level))
    got = {r.level: r for r in catalog.union_levels(*out).collect()}
    assert {k: r.completeness for k, r in got.items()} == {"u": 13, "s": 13, "a": 13, "g": 10, "r": 11}
    assert got["g"].course_type == "研究生课" and got["g"].grading == "" and got["u"].audience == "" and got["r"].id == "r7"
    shown = catalog.detail(basic, detail, "r", 7).first()
    assert shown.intro_cn == "d" and shown.prerequisites == "" and shown.major == " " and shown.textbook == ""
    assert catalog.detail(basic, detail, "r", 8).count() == 0


@pytest.mark.parametrize("bad", [{"page": True}, {"page": Page}, {"credits": 1.0}, {"credits": "nan"}, {"credits": "x"}, {"sort": "size"}, {"lang": "xx"}, {"term": None}, {"weekday": "Monday"}])
def test_bad_parameters(bad):
    with pytest.raises(ParameterError) as e:
        Search(**bad)
    assert e.value.status == 422


def test_pages_and_ids():
    for page, size, most in ((0, 1, 200), (10_001, 1, 200), (True, 1, 200), (1, 201, 200), (1, 101, 100), (1, 1.0, 200)):
        with pytest.raises(ParameterError):
            Page(page, size, most)
    assert split_id("r12") == ("fall", "r", 12)
    for bad in ("r0", "x1", "u01", "u1 ", "", None, 5):
        with pytest.raises(ParameterError) as e:
            split_id(bad)
        assert e.value.status == 404
    assert review_query(" q ") == "q" and message_text(" m ") == "m"
    for bad in ("", "  ", "x" * 501, None):
        with pytest.raises(ParameterError):
            message_text(bad)


def test_default_columns_are_the_documented_ones():
    assert len(COURSE.texts) == 15 and len(COURSE.values) == 2 and len(COURSE.counted_texts) == 12 and len(COURSE.counted_values) == 1
