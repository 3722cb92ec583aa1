"""Operators on small fixtures, each beside the rows that must come out (see test_fixtures.py)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcat.functions.params import Search
from loomcat.functions.storage import fresh
from loomcat.operators import catalog, checks, mining
from loomcat.sources import catalog_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expect(columns: str, *rows: tuple):
    """Registers a query with its rows: columns as `name kind`, kinds of DuckDB."""
    names, kinds = zip(*(x.strip().split(" ") for x in columns.split(",")), strict=True)
    one = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    cells = ", ".join(f'CAST(c{i} AS {k}) AS "{n}"' for i, (n, k) in enumerate(zip(names, kinds, strict=True)))
    values = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)

    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = f"SELECT {cells} FROM (VALUES {values}) t({', '.join(f'c{i}' for i in range(len(names)))})"
        return fn

    return add


def _listing(spark: SparkSession, level: str) -> DataFrame:
    shape = catalog.LEVELS[level]
    basic = spark.createDataFrame([(1, "T", "Tides", 2.0, "Sea", " "), (2, None, None, None, "", None)], "id long, course_type string, course_name string, credits double, department string, notes string")
    filled = {"english_name": "Tides", "grading": "P", "weekly_hours": "2", "audience": "all"}
    names = catalog.DETAIL[shape]
    return catalog.listings(basic, spark.createDataFrame([(1, *(filled.get(x) for x in names))], "course_id long, " + ", ".join(f"{x} string" for x in names)), level)


@expect(
    "id VARCHAR, course_type VARCHAR, pnp VARCHAR, english_name VARCHAR, grading VARCHAR, audience VARCHAR, completeness BIGINT",
    *((f"{x}1", "T", None, "Tides", "P", "", 5) for x in "usa"), *((f"{x}2", None, None, None, None, "", 0) for x in "usa"),
    *((f"{x}1", "研究生课", "", "Tides", "", "all", 6) for x in "gr"), *((f"{x}2", "研究生课", "", None, "", None, 0) for x in "gr"),
)
def catalog_levels(spark, sf_dir):
    rows = catalog.union_levels(*(_listing(spark, x) for x in catalog.LEVELS))
    return rows.select("id", "course_type", "pnp", "english_name", "grading", "audience", "completeness")


@expect("id VARCHAR", ("1",), ("2",))
def filter_classroom(spark, sf_dir):
    rows = spark.createDataFrame([("1", "HALL 20", "x"), ("2", "Lab", "the hall 2b"), ("3", "Hall 3", None), ("4", None, None), ("5", "Hall%2", "Hall_2")], "id string, classroom string, display_classroom string")
    return rows.where(catalog.matches(Search(classroom="Hall 2"))).select("id")


@expect("id VARCHAR", ("1",), ("3",))
def filter_weekday(spark, sf_dir):
    rows = spark.createDataFrame([("1", "周一周三"), ("2", "周四"), ("3", "周三"), ("4", None), ("5", "")], "id string, weekdays string")
    return rows.where(catalog.matches(Search(weekday="周三"))).select("id")


_NAMES = [("90000001", "潮汐"), ("90000002", "海洋地图学"), ("90000003", "海洋地图学进阶"), ("", "Knots（II）")]


@expect("entry_key VARCHAR, course_name VARCHAR", ("e1", "海洋地图学"), ("e2", "潮汐"), ("e4", "海洋地图学"), ("e5", "海洋地图学进阶"), ("e6", "Knots（II）"), ("e7", "潮汐"))
def matcher_default(spark, sf_dir):
    texts = ["海洋地图学里的潮汐部分", "潮汐课明年还有", "去海边看潮汐", "90000002 or 90000009", "海洋地图学进阶", "KnotsII then Knots II", "•潮汐", None]
    entries = spark.createDataFrame([(f"e{k}", x) for k, x in enumerate(texts, 1)], "entry_key string, content string")
    return mining.tag_courses(entries, spark.createDataFrame(_NAMES, "code string, name string"))


@expect(
    "entry_key VARCHAR, start_offset BIGINT, end_offset BIGINT, entity_type VARCHAR, match_kind VARCHAR",
    ("h1", 0, 2, "course", "full"), ("h1", 3, 5, "teacher", "full"), ("h3", 2, 4, "teacher", "full"), ("h4", 1, 6, "course", "full"), ("h4", 8, 11, "teacher", "alias"),
)
def highlighter_default(spark, sf_dir):
    listings = spark.createDataFrame([("潮汐", "李水(教授)，王石"), ("海洋地图学", "Ada Quill"), (None, None)], "course_name string, teacher string")
    texts = [("h1", "潮汐 李水", ["潮汐"]), ("h2", "李水来过", []), ("h3", "问下王石老师", []), ("h4", "🌊海洋地图学, adq", ["海洋地图学"]), ("h5", None, None)]
    initials = spark.createDataFrame([("Ada Quill", "adq")], "teacher string, initials string")
    got = mining.highlight(spark.createDataFrame(texts, "entry_key string, content string, courses array<string>"), listings, initials)
    return got.select("entry_key", F.explode("highlights").alias("h")).select("entry_key", F.col("h.start_offset").cast("long").alias("start_offset"), F.col("h.end_offset").cast("long").alias("end_offset"), "h.entity_type", "h.match_kind")


@expect("id BIGINT, weekdays VARCHAR, first_period BIGINT, classroom VARCHAR", (1, "周三", 3, "北楼7"), (2, "周一周四", 1, "A12"), (3, "", None, ""))
def schedule_parts(spark, sf_dir):
    rows = spark.createDataFrame([(1, "1~16周 双周周三3~4节 北楼7"), (2, "1~8周 每周周一5~6节 A12 每周周四1~2节 A12"), (3, "")], "id long, schedule string")
    return rows.select("id", *(x.cast("long").alias(k) if k == "first_period" else x.alias(k) for k, x in catalog_json.schedule_parts().items()))


def _file(spark: SparkSession, body: object) -> str:
    path = fresh(spark, "json")
    spark.createDataFrame([(json.dumps(body, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    return path


def _row(seq: str, shape: str, kind: str | None, without: tuple[str, ...] = (), **fields: str) -> dict:
    basic = {k: "" for k in catalog_json.BASIC_FIELDS if shape == "undergraduate" or k != "自选PNP"} | {"课程号": f"c{seq}", "课程名": "Tides", "班号": "1"}
    detail = {k: "" for k in catalog_json.DETAIL_FIELDS[shape]}
    for k, x in fields.items():
        (basic if k in basic else detail)[k] = x
    own = {k: {n: x for n, x in v.items() if n not in without} for k, v in (("基本信息", basic), ("详细信息", detail))}
    return {"数据学期": "x", "详情链接": "https://h.example", "课程序号": seq, **own} | ({"课程类型": kind} if kind else {})


@expect("seq VARCHAR, course_name VARCHAR, credits VARCHAR, weekly_hours VARCHAR, total_hours VARCHAR, audience VARCHAR, intro VARCHAR, syllabus VARCHAR", ("1", "Tides", "2.0", "2", "32", "all", "about", "list"), ("2", "Tides", "", "", "", "", "", ""))
def graduate_listings(spark, sf_dir):
    rows = [_row("1", "graduate", None, 学分="2.0", 周学时="2", 总学时="32", 修读对象="all", 课程简介="about", 大纲="list"), _row("2", "graduate", None, ("周学时",))]
    got = catalog_json.listing_columns(catalog_json.read_listings(spark, _file(spark, rows)), "graduate")
    return got.select("seq", "course_name", "credits", "weekly_hours", "total_hours", "audience", "intro", "syllabus")


@expect("seq VARCHAR, fault VARCHAR", ("2", "missing detail field: 教材"), ("3", "unknown detail field: weight"), ("4", "missing basic field: 课程号"), ("4", "missing basic field: 备注"))
def listing_field_faults(spark, sf_dir):
    rows = [_row("1", "undergraduate", "T"), _row("2", "undergraduate", "T", ("教材",)), _row("3", "undergraduate", "T", weight="9"), _row("4", "undergraduate", "T", ("课程号", "备注"))]
    return catalog_json.field_faults(catalog_json.read_listings(spark, _file(spark, rows)))


@expect("pid BIGINT, ordinal BIGINT, cid BIGINT, floor BIGINT, posted_at BIGINT, content VARCHAR", (5, 0, 1, 1, 10, "first"), (5, 2, 3, None, 12, "third"))
def shard_replies(spark, sf_dir):
    comments = [{"cid": 1, "floor": 1, "text": "first", "timestamp": 10, "authorTag": "who"}, {"cid": 2, "floor": 2, "text": " ", "timestamp": 11}, {"cid": 3, "text": "third", "timestamp": 12}]
    shard = {"version": 2, "key": "2030-01", "posts": {"5": {"pid": 5, "text": "t", "timestamp": 9, "url": "u", "comments": comments}, "6": {"pid": 6, "text": "alone", "timestamp": 9, "url": "u"}}}
    got = catalog_json.post_replies(catalog_json.shard_posts(catalog_json.read_shards(spark, _file(spark, shard))))
    return got.select("pid", F.col("ordinal").cast("long").alias("ordinal"), "cid", F.col("floor").cast("long").alias("floor"), "posted_at", "content")


def _envelope(spark: SparkSession, rows: list[dict], **changes: object) -> DataFrame:
    kinds = [r["课程类型"] for r in rows]
    seqs = [r["课程序号"] for r in rows]
    body = {"term": "30-31-2", "stats": {k: kinds.count(k) for k in set(kinds)}, "rows": rows, "errors": [], "validation": {"totalRows": len(rows), "duplicateSeqs": sorted({x for x in seqs if seqs.count(x) > 1})} | {x: [] for x in checks.EMPTY_LISTS}}
    for k, x in changes.items():
        (body["validation"] if k in body["validation"] else body)[k] = x
    e = catalog_json.read_envelopes(spark, _file(spark, body))
    return checks.envelope_faults(e, catalog_json.listing_columns(catalog_json.envelope_rows(e)), "30-31-2", ["A", "B"], "undergraduate_fall")


@expect(
    "payload VARCHAR, fault VARCHAR, detail VARCHAR",
    ("bad", "term", "30-31-1"), ("bad", "errors", "1"), ("bad", "stats", "B"), ("bad", "stats", "C"), ("bad", "kinds", "A,B,C"), ("bad", "total", "9"), ("bad", "duplicateSeqs", "1"), ("bad", "duplicateSeqs", "7"),
    ("bad", "duplicate key", "A|c1|1|"), ("bad", "no code", "3"), ("bad", "no link", "4"), ("bad", "stated", "suspiciousPages"),
)
def envelope_faults(spark, sf_dir):
    good = [_row("1", "undergraduate", "A"), _row("1", "undergraduate", "B"), _row("2", "undergraduate", "B")]
    bad = [_row("1", "undergraduate", "A"), _row("1", "undergraduate", "A"), _row("3", "undergraduate", "B", 课程号=" "), _row("4", "undergraduate", "B") | {"详情链接": ""}]
    wrong = _envelope(spark, bad, term="30-31-1", errors=["x"], stats={"A": 2, "B": 1, "C": 4}, totalRows=9, duplicateSeqs=["7"], suspiciousPages=["p"])
    return _envelope(spark, good).withColumn("payload", F.lit("good")).union(wrong.withColumn("payload", F.lit("bad"))).select("payload", "fault", "detail")


@expect("profile VARCHAR, n BIGINT", ("summer", 1), ("graduate", 1))
def unique_profiles(spark, sf_dir):
    rows = spark.createDataFrame([("T", "c", "1", "Ann", "Sea"), ("T", "c", "1", "Bo", "Sea"), ("U", "c", "1", "Ann", "Sea"), ("T", "c", "2", None, "Sea")], "course_type string, course_code string, class_no string, teacher string, department string")
    return catalog.union_levels(*(checks.profile_duplicates(rows, p).groupBy(F.lit(p).alias("profile")).agg(F.count("*").alias("n")) for p in checks.UNIQUE))


@expect("fault VARCHAR", ("entries: missing",), ("threads: columns content, pid",))
def store_faults(spark, sf_dir):
    root = fresh(spark, "store")
    spark.createDataFrame([("1", 2)], "pid string, posted_at long").write.parquet(f"{root}/threads")
    spark.createDataFrame([(1,)], "pid long").write.parquet(f"{root}/replies")
    found = checks.store_faults(spark, root, {"threads": "pid long, posted_at long, content string", "replies": "pid long", "entries": "pid long"})
    return spark.createDataFrame([(x,) for x in found], "fault string")
