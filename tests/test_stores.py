"""Visitor bitmaps, stored orders, quarantined rows and day tables against plain ways."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomcat.operators import activity
from loomcat.operators.paging import StoredOrder
from loomcat.operators.visitors import Visitors
from loomcat.sources import publish, quarantine
from loomcat.sources.quarantine import Field
from loomcat.streaming.upserts import DayTable

NOW = 1_700_000_000


def visits(spark, seed, n=400, first=0, last=20):
    rng = random.Random(seed)
    rows = [(NOW - rng.randint(first, last) * 86400 + rng.randint(0, 80_000), f"ip{rng.randint(0, 60)}", rng.choice(["Mozilla", "Mozilla", "curl/8", "", None]), "x") for _ in range(n)]
    return spark.createDataFrame(rows, "at long, ip_hash string, agent string, day string")


def test_bitmaps_count_what_is_counted(spark, tmp_path):
    rows = visits(spark, 1).union(spark.createDataFrame([(None, "ip1", "Mozilla", "x"), (NOW, None, "Mozilla", "x")], "at long, ip_hash string, agent string, day string"))
    visitors = Visitors(spark, str(tmp_path / "v"))
    assert visitors.stats(NOW).first().asDict() == dict.fromkeys(visitors.stats(NOW).columns, 0)
    seen = rows.where("at IS NOT NULL AND ip_hash IS NOT NULL")
    late = activity.t.beijing_day("at") >= "2023-11-12"
    for part in (rows.where(~late), rows.where(late)):
        visitors.add(part)
    assert visitors.stats(NOW).first() == activity.visit_stats(activity.visit_days(seen), NOW).first()
    numbers = [r.number for r in spark.read.parquet(str(tmp_path / "v/numbers")).collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_a_day_that_comes_again_replaces_itself_alone(spark, tmp_path):
    visitors, rows = Visitors(spark, str(tmp_path / "v")), visits(spark, 2, last=5)
    visitors.add(rows)
    before = visitors.stats(NOW).first()
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "v/days").rglob("*.parquet")}
    day = rows.select(F.max(activity.t.beijing_day("at"))).first()[0]
    visitors.add(rows.where(activity.t.beijing_day("at") == day))
    assert visitors.stats(NOW).first() == before
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "v/days").rglob("*.parquet")}
    changed = {p.parent.name for p in set(files.items()) ^ set(now.items()) for p in [p[0]]}
    assert changed == {f"day={day}"}


def test_many_visitors_take_several_bitmaps(spark, tmp_path):
    rows = spark.range(70_000).select(F.lit(NOW).alias("at"), F.concat(F.lit("ip"), "id").alias("ip_hash"), F.lit("Mozilla").alias("agent"))
    visitors = Visitors(spark, str(tmp_path / "v"))
    visitors.add(rows)
    assert spark.read.parquet(str(tmp_path / "v/days")).count() == 3
    assert visitors.between().first().asDict() == {"views": 70_000, "visitors": 70_000}


@pytest.mark.parametrize("per_range", [1, 7, 1000])
def test_pages_are_limit_and_offset(spark, tmp_path, per_range):
    rng = random.Random(per_range)
    rows = spark.createDataFrame([(i, rng.choice([None, "", "a", "Ä", "b"]), rng.choice([1.5, None, 2.0]), 9) for i in range(60)], "k long, name string, x double, _place int").drop("_place")
    by = [F.desc_nulls_last("name"), F.asc_nulls_first("x"), F.asc("k")]
    order = StoredOrder.build(rows, by, str(tmp_path / "o"), per_range)
    want = [tuple(r) for r in rows.orderBy(*by).collect()]
    for offset, size in ((0, 60), (0, 7), (13, 20), (58, 9), (60, 5), (1000, 3), (5, 0)):
        assert [tuple(r) for r in order.page(offset, size).collect()] == want[offset : offset + size]
    with pytest.raises(ValueError):
        order.page(-1, 5)


def test_a_page_reads_one_folder(spark, tmp_path):
    order = StoredOrder.build(spark.range(1000), [F.asc("id")], str(tmp_path / "o"), 100)
    page = order.page(505, 10)
    assert len(order.spans(505, 10)) == 1 and [r.id for r in page.collect()] == list(range(505, 515))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(_range" in plan or "PartitionFilters: [isnotnull(_range" in plan
    assert StoredOrder.build(spark.range(0), [F.asc("id")], str(tmp_path / "none")).page(0, 5).count() == 0


def test_quarantine_adds_up(spark, tmp_path):
    say = ['{"id": 1, "who": {"name": "A"}}', '{"id": 2', '{"id": "x"}', '{"who": {"name": "B"}}', "[]", " ", "7", '{"id": 3} trailing', '{"id": NaN}', '{"id": null}', '{"id": 4, "who": {"name": {}}, "more": [1]}', '{"id": 5, "who": null}', "null", '{"id": "6"}', '{"id": 1}, {"id": 2}', '{"id": 1}], [', '{"id": 1}}, {', '{"id": 1}, "k": 2']
    (tmp_path / "a.json").write_text("\n".join(say) + "\n")
    (tmp_path / "b.json").write_text('{"id": 9}\n\n{"id": true, "who": {"name": []}}\n')
    lines = quarantine.numbered_lines(spark, f"file://{tmp_path}/*.json")
    got = {(r.file.rpartition("/")[2], r.row): r.value for r in lines.collect()}
    assert [got["a.json", i] for i in range(len(say))] == say and len(got) == len(say) + 3
    good, bad = quarantine.split(lines, [Field("id", "$.id", "long"), Field("name", "$.who.name", "string", False)])
    fine = {(r.file.rpartition("/")[2], r.row): (r.id, r.name) for r in good.collect()}
    wrong = {(r.file.rpartition("/")[2], r.row, r.path, r.reason) for r in bad.collect()}
    assert fine["a.json", 0] == (1, "A") and fine["a.json", 11] == (5, None) and fine["b.json", 0] == (9, None)
    assert wrong >= {("a.json", 1, "$", "no JSON"), ("a.json", 2, "$.id", "kind"), ("a.json", 3, "$.id", "missing"), ("a.json", 4, "$", "no object"), ("a.json", 5, "$", "empty"), ("a.json", 6, "$", "no object"), ("a.json", 7, "$", "no JSON"), ("a.json", 8, "$", "no JSON"), ("a.json", 9, "$.id", "missing"), ("a.json", 10, "$.who.name", "kind"), ("a.json", 12, "$", "no object"), *(("a.json", i, "$", "no JSON") for i in (14, 15, 16, 17)), ("b.json", 1, "$", "empty")}
    assert set(fine) | {x[:2] for x in wrong} == set(got) and not set(fine) & {x[:2] for x in wrong}


def test_quarantine_of_nothing(spark):
    good, bad = quarantine.split(spark.createDataFrame([], "file string, row long, value string"), [Field("id", "$.id", "long")])
    assert good.count() == bad.count() == 0


def day_rows(spark, seed):
    rng = random.Random(seed)
    rows = {(f"2024-01-{rng.randint(1, 6):02d}", f"ip{rng.randint(0, 9)}"): (rng.randint(1, 5), rng.randint(1, 99)) for _ in range(12)}
    return spark.createDataFrame([(*k, *x) for k, x in rows.items()], "day string, ip_hash string, views long, last_at long")


def test_day_tables_hold_a_row_a_key_in_few_files(spark, tmp_path):
    table, sums = DayTable(spark, str(tmp_path / "t")), {}
    assert table.read().count() == 0
    for n in range(12):
        rows = day_rows(spark, n)
        for r in rows.collect():
            views, last = sums.get((r.day, r.ip_hash), (0, 0))
            sums[r.day, r.ip_hash] = views + r.views, max(last, r.last_at)
        assert table.upsert(rows, n) and not table.upsert(rows, n)  # the second is a replay
        table.compact(2)
    got = [(r.day, r.ip_hash, r.views, r.last_at) for r in table.read().collect()]
    assert len(got) == len(sums) and {x[:2]: x[2:] for x in got} == sums
    assert len(list((tmp_path / "t/versions").rglob("*.parquet"))) <= 2 * 6 and len(publish.manifests(spark, str(tmp_path / "t"))) == 2
    assert {r.day for r in table.read(days=["2024-01-02", "2030-01-01"]).collect()} == {"2024-01-02"}


def test_batches_touch_their_days_only(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"))
    table.upsert(day_rows(spark, 1), 0)
    before = json.loads((tmp_path / "t/manifests/000000000000").read_text())["days"]
    day = day_rows(spark, 2).first().day
    table.upsert(day_rows(spark, 2).where(F.col("day") == day), 1)
    after = json.loads((tmp_path / "t/manifests/000000000001").read_text())["days"]
    assert {d for d in after if after[d] != before.get(d)} == {day}
    assert table.read(number=0).count() == day_rows(spark, 1).count()


def test_another_writer_between_look_and_claim(spark, tmp_path, monkeypatch):
    table, claim = DayTable(spark, str(tmp_path / "t")), publish._claim
    one, two = (spark.createDataFrame([("d", "ip", n, n)], "day string, ip_hash string, views long, last_at long") for n in (1, 10))

    def beaten(*args):
        monkeypatch.setattr(publish, "_claim", claim)
        table.upsert(one, 5)
        return claim(*args)

    monkeypatch.setattr(publish, "_claim", beaten)
    assert table.upsert(two, 6)
    assert [tuple(r) for r in table.read().collect()] == [("d", "ip", 11, 10)]
