"""Sources that the given tables don't have as such (listings with details, scraped JSON, review shards,
indexes, published versions), derived from them by Spark, and the operators on them, each beside
its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.params import Search
from ..functions.storage import fresh
from ..operators import catalog, checks, mining
from ..operators.paging import StoredOrder
from ..operators.trigrams import TrigramIndex
from ..operators.visitors import Visitors
from ..sources import catalog_json, html_rows, publish, quarantine
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FOLD = f"translate({{0}}, '{t.UPPER}', '{t.LOWER}')"
DAYS = "一二三四五六日"


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- listings of three shapes: part is what they have in common, lineitem their details


def _basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_type").alias("course_type"), F.col("p_name").alias("course_name"), F.col("p_brand").alias("course_code"), F.when(k % 4 != 1, F.col("p_retailprice")).alias("credits"),
        F.when(k % 3 != 0, F.col("p_brand")).alias("department"), F.when(k % 2 == 0, F.col("p_name")).otherwise("  ").alias("notes"),
    )


def _detail(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    has = {"english_name": F.concat(F.lit("Part "), F.max("l_returnflag")), "grading": F.min("l_linestatus"), "weekly_hours": F.count("*").cast("string"), "audience": F.when(F.count("*") % 2 == 0, "all").otherwise(" ")}
    names = catalog.DETAIL[shape]
    found = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("course_id")).agg(*(has[x].alias(x) for x in names if x in has))
    return found.select("course_id", *(F.col(x) if x in has else F.lit(None).cast("string").alias(x) for x in names))


_BASIC_SQL = "SELECT p_partkey AS k, p_type, p_name, CASE WHEN p_partkey % 4 <> 1 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + 1 AS filled FROM part"
_DETAIL_SQL = "SELECT l_partkey, 'Part ' || max(l_returnflag) AS en, min(l_linestatus) AS grading, count(*) AS n FROM lineitem GROUP BY l_partkey"


@query(f"""WITH b AS ({_BASIC_SQL}), d AS ({_DETAIL_SQL}), x AS (SELECT * FROM b LEFT JOIN d ON l_partkey = k)
SELECT 'u' || k AS id, p_type AS course_type, NULL::VARCHAR AS pnp, en AS english_name, grading, '' AS audience, (filled + CASE WHEN en IS NULL THEN 0 ELSE 2 END)::BIGINT AS completeness FROM x
UNION ALL SELECT l || k, '研究生课', '', en, '', CASE WHEN n IS NULL THEN NULL WHEN n % 2 = 0 THEN 'all' ELSE ' ' END, (filled + CASE WHEN en IS NULL THEN 0 WHEN n % 2 = 0 THEN 3 ELSE 2 END)::BIGINT FROM x, (VALUES ('g'), ('r')) AS ls(l)""")
def catalog_levels(spark, sf_dir):
    rows = catalog.union_levels(*(catalog.listings(_basic(spark, sf_dir), _detail(spark, sf_dir, catalog.LEVELS[x]), x) for x in "ugr"))
    return rows.select("id", "course_type", "pnp", "english_name", "grading", "audience", "completeness")


@query(f"SELECT p_partkey FROM part WHERE (p_partkey % 3 = 0 AND contains({FOLD.format('p_name')}, 'old ro')) OR (p_partkey % 2 = 0 AND contains({FOLD.format('upper(p_name)')}, 'old ro'))")
def filter_classroom(spark, sf_dir):
    k = F.col("p_partkey")
    rows = _read(spark, sf_dir, "part").withColumns({"classroom": F.when(k % 3 == 0, F.col("p_name")), "display_classroom": F.when(k % 2 == 0, F.upper("p_name")).when(k % 5 == 0, "Old  Ro")})
    return rows.where(catalog.matches(Search(classroom="Old Ro"))).select("p_partkey")


def _day(at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), (at % 7 + 1).cast("int"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0 AND (p_partkey % 7 = 2 OR (p_partkey % 2 = 1 AND (p_partkey * 3) % 7 = 2))")
def filter_weekday(spark, sf_dir):
    k = F.col("p_partkey")
    days = F.concat(F.lit("周"), _day(k), F.when(k % 2 == 1, F.concat(F.lit("周"), _day(k * 3))).otherwise(""))
    return _read(spark, sf_dir, "part").withColumn("weekdays", F.when(k % 11 != 0, days)).where(catalog.matches(Search(weekday="周三"))).select("p_partkey")


@query(f"""WITH s AS (SELECT p_partkey AS k, p_size AS z, substr('{DAYS}', (p_partkey % 7)::INT + 1, 1) AS one, substr('{DAYS}', (p_partkey * 3 % 7)::INT + 1, 1) AS two FROM part)
SELECT k AS p_partkey, CASE WHEN k % 5 = 0 THEN '' WHEN k % 2 = 1 AND one <> two THEN '周' || one || '周' || two ELSE '周' || one END AS weekdays,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 1 THEN least(k % 5 + 1, k % 3 + 1) ELSE k % 5 + 1 END AS first_period, CASE WHEN k % 5 = 0 THEN '' ELSE 'R' || z END AS classroom FROM s""")
def schedule_parts(spark, sf_dir):
    k, room = F.col("p_partkey"), F.concat(F.lit("节 R"), "p_size")
    one = F.concat(F.lit("1~16周 每周周"), _day(k), k % 5 + 1, F.lit("~12"), room)
    two = F.concat(F.lit(" 1~8周 双周周"), _day(k * 3), k % 3 + 1, F.lit("~12"), room)
    rows = _read(spark, sf_dir, "part").withColumn("schedule", F.when(k % 5 == 0, "时间待定").otherwise(F.concat(one, F.when(k % 2 == 1, two).otherwise(""))))
    return rows.select("p_partkey", *(x.cast("long").alias(n) if n == "first_period" else x.alias(n) for n, x in catalog_json.schedule_parts().items()))


@query("""WITH l AS (SELECT p_type AS course_type, p_brand AS course_code, CAST(p_size % 4 AS VARCHAR) AS class_no, p_name AS teacher, p_type AS department FROM part),
d AS (SELECT 'summer' AS profile, count(*) AS n FROM l GROUP BY course_type, course_code, class_no UNION ALL SELECT 'undergraduate_fall', count(*) FROM l GROUP BY course_type, course_code, class_no, teacher UNION ALL SELECT 'graduate', count(*) FROM l GROUP BY course_code, class_no, teacher, department)
SELECT profile, count(*)::BIGINT AS duplicate_keys, sum(n)::BIGINT AS rows FROM d WHERE n > 1 GROUP BY profile""")
def unique_profiles(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.col("p_type").alias("course_type"), F.col("p_brand").alias("course_code"), (F.col("p_size") % 4).cast("string").alias("class_no"), F.col("p_name").alias("teacher"), F.col("p_type").alias("department"))
    return catalog.union_levels(*(checks.profile_duplicates(rows, p).groupBy(F.lit(p).alias("profile")).agg(F.count("*").alias("duplicate_keys"), F.sum("n").alias("rows")) for p in checks.UNIQUE))


# ---- matching


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that name a part, the next one, and the code of the one after that."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("after"))
    content = F.concat_ws(", ", F.concat(F.lit("about "), "p_name"), "after", F.concat(F.lit("code "), F.lit(90000000) + F.col("p_partkey") + 2))
    return p.join(after, "p_partkey", "left").select("p_partkey", "p_name", "p_brand", content.alias("content"))


@query("""SELECT DISTINCT 'e' || p.p_partkey AS entry_key, x.p_name AS course_name FROM part p JOIN part x ON x.p_partkey IN (p.p_partkey, p.p_partkey + 1, p.p_partkey + 2)""")
def matcher_default(spark, sf_dir):
    entries = _entries(spark, sf_dir).select(F.concat(F.lit("e"), "p_partkey").alias("entry_key"), "content")
    return mining.tag_courses(entries, _read(spark, sf_dir, "part").select((F.lit(90000000) + F.col("p_partkey")).cast("string").alias("code"), F.col("p_name").alias("name")))


@query(ORACLES["matcher_default"])
def matcher_joined(spark, sf_dir):
    """With a dictionary that is not broadcast."""
    entries = _entries(spark, sf_dir).select(F.concat(F.lit("e"), "p_partkey").alias("entry_key"), "content")
    return mining.tag_courses(entries, _read(spark, sf_dir, "part").select((F.lit(90000000) + F.col("p_partkey")).cast("string").alias("code"), F.col("p_name").alias("name")), most=0)


@query("""SELECT 'h' || p_partkey AS entry_key, 0::BIGINT AS start_offset, length(p_name) AS end_offset, 'course' AS entity_type, 'full' AS match_kind FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT 'h' || p_partkey, length(p_name) + 4, length(p_name) + 4 + length(p_brand), 'teacher', 'full' FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0""")
def highlighter_default(spark, sf_dir):
    return _highlights(spark, sf_dir, mining.MOST_NAMES)


@query(ORACLES["highlighter_default"])
def highlighter_joined(spark, sf_dir):
    """With dictionaries that are not broadcast."""
    return _highlights(spark, sf_dir, 0)


def _highlights(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    p, k = _read(spark, sf_dir, "part"), F.col("p_partkey")
    content = F.concat("p_name", F.lit(" by "), "p_brand", F.when(k % 2 == 0, "老师").otherwise(""))
    entries = p.select(F.concat(F.lit("h"), k).alias("entry_key"), content.alias("content"), F.when(k % 3 != 0, F.array("p_name")).alias("courses"))
    got = mining.highlight(entries, p.select(F.col("p_name").alias("course_name"), F.col("p_brand").alias("teacher")), most=most)
    return got.select("entry_key", F.explode("highlights").alias("h")).select("entry_key", F.col("h.start_offset").cast("long").alias("start_offset"), F.col("h.end_offset").cast("long").alias("end_offset"), "h.entity_type", "h.match_kind")


# ---- scraped JSON, written from part and conversations and read back


def _json(rows: DataFrame, body: Column, group: Column, name: str) -> str:
    """Files with one JSON value each, one for each group of bounded size."""
    path = fresh(rows.sparkSession, name)
    rows.groupBy(group.alias("part")).agg(F.to_json(body).alias("value")).write.partitionBy("part").text(path)
    return path


def _scraped(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    k = F.col("p_partkey")
    basic = {"课程号": F.col("p_brand"), "课程名": F.col("p_name"), "学分": F.col("p_size").cast("string"), "班号": k.cast("string")}
    detail = {"英文名称": F.initcap("p_name"), "周学时": (k % 7).cast("string"), "课程简介": F.col("p_type"), "授课语言": F.col("p_type")}
    pairs = lambda names, has: F.map_from_entries(F.array(*(F.struct(F.lit(x).alias("key"), has.get(x, F.lit("")).alias("value")) for x in names)))
    one = pairs([x for x in catalog_json.BASIC_FIELDS if shape == "undergraduate" or x != "自选PNP"], basic)
    two = pairs(catalog_json.DETAIL_FIELDS[shape], detail)
    one = F.map_filter(one, lambda x, _: ~((x == "备注") & (k % 90 == 0)))
    two = F.map_concat(F.map_filter(two, lambda x, _: ~((x == "参考书") & (k % 50 == 0))), F.when(k % 77 == 0, F.create_map(F.lit("weight"), F.lit("9"))).otherwise(F.create_map().cast("map<string,string>")))
    row = F.struct(F.lit("x").alias("数据学期"), F.lit("https://h.example").alias("详情链接"), k.cast("string").alias("课程序号"), F.col("p_type").alias("课程类型"), one.alias("基本信息"), two.alias("详细信息"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", row.alias("row"))
    return catalog_json.read_listings(spark, _json(rows, F.collect_list("row"), F.expr("p_partkey div 500"), f"listings-{shape}"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS seq, p_name AS course_name, CAST(p_size AS VARCHAR) AS credits, CAST(p_partkey % 7 AS VARCHAR) AS weekly_hours, p_type AS intro, '' AS syllabus, '' AS reference_book FROM part")
def graduate_listings(spark, sf_dir):
    return catalog_json.listing_columns(_scraped(spark, sf_dir, "graduate"), "graduate").select("seq", "course_name", "credits", "weekly_hours", "intro", "syllabus", "reference_book")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS seq, 'missing basic field: 备注' AS fault FROM part WHERE p_partkey % 90 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'missing detail field: 参考书' FROM part WHERE p_partkey % 50 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'unknown detail field: weight' FROM part WHERE p_partkey % 77 = 0""")
def listing_field_faults(spark, sf_dir):
    return catalog_json.field_faults(_scraped(spark, sf_dir, "undergraduate"))


@query("""SELECT conv_id + 1 AS pid, turn - 1 AS ordinal, conv_id * 1000 + turn AS cid, CASE WHEN turn % 3 <> 0 THEN turn END AS floor, 1766000000 + conv_id * 60 + turn AS posted_at, text AS content
FROM conversations WHERE turn > 0 AND turn % 4 <> 3 AND trim(coalesce(text, ''), ' ') <> ''""")
def shard_replies(spark, sf_dir):
    c, at = _read(spark, sf_dir, "conversations"), F.lit(1766000000) + F.col("conv_id") * 60
    comment = F.struct(
        "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("cid"), F.when(F.col("turn") % 3 != 0, F.col("turn")).alias("floor"), F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text")).alias("text"),
        (at + F.col("turn")).alias("timestamp"), F.lit(None).cast("string").alias("replyTo"), F.col("role").alias("authorTag"),
    )
    post = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("text"), F.array_sort(F.collect_list(F.when(F.col("turn") > 0, comment))).alias("comments"))
    whole = F.struct((F.col("conv_id") + 1).alias("pid"), "text", at.alias("timestamp"), F.lit("u").alias("url"), F.transform("comments", lambda x: x.dropFields("turn")).alias("comments"))
    posts = post.select("conv_id", F.struct((F.col("conv_id") + 1).cast("string").alias("key"), whole.alias("value")).alias("post"))
    body = F.struct(F.lit(2).alias("version"), F.lit("2030-01").alias("key"), F.map_from_entries(F.collect_list("post")).alias("posts"))
    got = catalog_json.post_replies(catalog_json.shard_posts(catalog_json.read_shards(spark, _json(posts, body, F.expr("conv_id div 50"), "shards"))))
    return got.select("pid", F.col("ordinal").cast("long").alias("ordinal"), "cid", F.col("floor").cast("long").alias("floor"), "posted_at", "content")


# ---- indexed search, published versions

NEEDLES = ("The H", "über", "Über", "ndtion", "qu", "zzzz", "e de la ", ". E")


@query(" UNION ALL ".join(f"SELECT '{n}' AS needle, doc_id FROM documents WHERE contains({FOLD.format('text')}, {FOLD.format(repr(n))})" for n in NEEDLES))
def search_indexed(spark, sf_dir):
    index = TrigramIndex.build(_read(spark, sf_dir, "documents"), "doc_id", "text", fresh(spark, "trigrams"))
    return catalog.union_levels(*(index.search(n).select(F.lit(n).alias("needle"), "doc_id") for n in NEEDLES))


@query("""SELECT 0::BIGINT AS number, count(*) AS rows, sum(p_partkey)::BIGINT AS keys FROM part UNION ALL SELECT 1, count(*), sum(k)::BIGINT FROM (SELECT l_partkey AS k FROM lineitem GROUP BY l_partkey)""")
def published_versions(spark, sf_dir):
    root = fresh(spark, "published")
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    sold = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))

    def unique(df: DataFrame) -> None:
        checks.require_none(checks.duplicate_keys(df, ["k"]), "keys")

    for batch, df in (("parts", parts), ("sold", sold), ("parts", sold)):  # the last is published already
        publish.publish(df, root, unique, batch)
    found = [publish.current(spark, root, m["number"]).agg(F.lit(m["number"]).cast("long").alias("number"), F.count("*").alias("rows"), F.sum("k").alias("keys")) for m in publish.manifests(spark, root)]
    return catalog.union_levels(*found)


# ---- visitors by bitmaps, stored orders, damaged rows


@query(
    "WITH " + v.DAYS + f""", w AS (SELECT strftime(TIMESTAMP '1970-01-01' + to_seconds({v.NOW} + 28800), '%Y-%m-%d') AS today, strftime(TIMESTAMP '1970-01-01' + to_seconds({v.NOW} + 28800 - 6 * 86400), '%Y-%m-%d') AS start)
SELECT sum(CASE WHEN day = today THEN views ELSE 0 END)::BIGINT AS today_views, count(DISTINCT CASE WHEN day = today THEN ip_hash END) AS today_visitors, sum(CASE WHEN day >= start THEN views ELSE 0 END)::BIGINT AS week_views,
  count(DISTINCT CASE WHEN day >= start THEN ip_hash END) AS week_visitors, sum(views)::BIGINT AS total_views, count(DISTINCT ip_hash) AS total_visitors FROM day, w"""
)
def visit_bitmaps(spark, sf_dir):
    visits, visitors = v.visits(spark, sf_dir), Visitors(spark, fresh(spark, "visitors"))
    first = t.beijing_day("at") < "2024-01-15"
    for days in (first, ~first):  # the later days come on their own
        visitors.add(visits.where(days))
    return visitors.stats(v.NOW)


PAGES = ((0, 20), (150, 50), (977, 13), (10**9, 5))


@query(f"""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_name DESC, p_retailprice, p_partkey) - 1 AS k FROM part)
SELECT o::BIGINT AS page_offset, k - o + 1 AS place, p_partkey FROM r, (VALUES {", ".join(str(x) for x in PAGES)}) AS p(o, n) WHERE k >= o AND k < o + n""")
def page_stored_order(spark, sf_dir):
    order = StoredOrder.build(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), [F.desc("p_name"), F.asc("p_retailprice"), F.asc("p_partkey")], fresh(spark, "order"), per_range=500)
    keys = Window.orderBy(F.desc("p_name"), F.asc("p_retailprice"), F.asc("p_partkey"))  # of a page
    return catalog.union_levels(*(order.page(o, n).select(F.lit(o).cast("long").alias("page_offset"), F.row_number().over(keys).cast("long").alias("place"), "p_partkey") for o, n in PAGES))


_DAMAGED = """CASE WHEN event_id % 13 = 0 THEN substr(props, 1, length(props) - 1) WHEN event_id % 17 = 0 THEN '{"k": "many"}' WHEN event_id % 19 = 0 THEN '{"other": 1}' WHEN event_id % 23 = 0 THEN '[1]' WHEN event_id % 29 = 0 THEN '  '
  WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN '{"k": NaN}' WHEN event_id % 41 = 0 THEN '{"k": 5, "who": {"name": 7}}' WHEN event_id % 43 = 0 THEN '{"k": null, "who": {"name": [1]}}' ELSE props END"""


@query(f"""WITH e AS (SELECT event_id AS row, {_DAMAGED} AS value, CASE WHEN event_id % 13 = 0 THEN 'no JSON' WHEN event_id % 17 = 0 THEN 'kind' WHEN event_id % 19 = 0 THEN 'missing' WHEN event_id % 23 = 0 THEN 'no object'
  WHEN event_id % 29 = 0 THEN 'empty' WHEN event_id % 31 = 0 THEN 'empty' WHEN event_id % 37 = 0 THEN 'no JSON' WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN 'missing' END AS reason FROM events)
SELECT row, CASE WHEN reason IS NULL THEN CAST(json_extract_string(value, '$.k') AS BIGINT) END AS k, CASE WHEN reason IN ('kind', 'missing') THEN '$.k' WHEN reason IS NOT NULL THEN '$' END AS path, reason FROM e
UNION ALL SELECT row, NULL, '$.who.name', 'kind' FROM e WHERE reason = 'missing' AND contains(value, '[1]')""")
def quarantined_rows(spark, sf_dir):
    lines = _read(spark, sf_dir, "events").select(F.lit("events").alias("file"), F.col("event_id").alias("row"), F.expr(_DAMAGED).alias("value"))
    good, bad = quarantine.split(lines, [quarantine.Field("k", "$.k", "long"), quarantine.Field("who", "$.who.name", "string", False)])
    return good.select("row", "k", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("reason")).union(bad.select("row", F.lit(None).cast("long"), "path", "reason"))


# ---- pages

_ITEM = '<li><a href="([^"]*)">([^<]*)</a></li>'


@query(f"""WITH p AS (SELECT page_id, regexp_extract_all(html, '{_ITEM}', 1) AS links, regexp_extract_all(html, '{_ITEM}', 2) AS texts FROM pages), i AS (SELECT page_id, links, texts, unnest(range(len(links))) AS k FROM p)
SELECT page_id, 0::BIGINT AS row, k AS "column", trim(regexp_replace(replace(replace(replace(replace(texts[k + 1], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS text,
  replace(links[k + 1], '&amp;', '&') AS link FROM i""")
def page_rows(spark, sf_dir):
    return html_rows.page_cells(_read(spark, sf_dir, "pages"), rows=("ul", "tr"), columns=("li", "td", "th"))
