"""The library's operators as queries over the driver's tables, each beside the SQL that must give
the same rows. Sorted results carry their rank, since rows are compared in no order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.params import Page, Search
from ..functions.storage import ranked
from ..operators import activity, aliases, catalog, checks, kinds, mining, reviews, translation
from ..streaming import activity as streams
from . import derived
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(derived.QUERIES)
ORACLES: dict[str, str] = dict(derived.ORACLES)
CARD_SQL = """
matching AS (SELECT DISTINCT group_key FROM listing WHERE {where}),
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY group_key ORDER BY completeness DESC, local_id, id) AS rank FROM listing l JOIN matching USING (group_key)),
rep AS (SELECT * FROM ranked WHERE rank = 1),
gain AS (SELECT c.*, {gain} AS fill FROM ranked c JOIN rep r USING (group_key) WHERE c.id <> r.id),
other AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY fill DESC, completeness DESC, local_id, id) AS fallback_rank FROM gain WHERE fill > 0),
badge AS (SELECT group_key, string_agg(DISTINCT course_type, ',' ORDER BY course_type) FILTER (trim(coalesce(course_type, ''), ' ') <> '') AS course_type,
    string_agg(DISTINCT category, ',' ORDER BY category) FILTER (trim(coalesce(category, ''), ' ') <> '') AS category FROM ranked GROUP BY group_key),
card AS (SELECT r.group_key, r.id, o.id AS fallback_id, b.course_type, b.category, r.course_code, r.class_no, r.teacher,
    {texts}, coalesce(r.credits, o.credits) AS credits, coalesce(r.first_period, o.first_period) AS first_period
  FROM rep r LEFT JOIN other o ON o.group_key = r.group_key AND o.fallback_rank = 1 LEFT JOIN badge b ON b.group_key = r.group_key)"""
_TEXTS = ", ".join(f"CASE WHEN trim(coalesce(r.{x}, ''), ' ') <> '' THEN r.{x} ELSE o.{x} END AS {y}" for x, y in v.CARD.texts.items())
_GAIN = " + ".join(
    [f"CASE WHEN trim(coalesce(r.{x}, ''), ' ') = '' AND trim(coalesce(c.{x}, ''), ' ') <> '' THEN 1 ELSE 0 END" for x in v.CARD.counted_texts]
    + ["CASE WHEN r.credits IS NULL AND c.credits IS NOT NULL THEN 1 ELSE 0 END"]
)
FOLD = f"translate({{0}}, '{t.UPPER}', '{t.LOWER}')"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def cards_sql(where: str, tail: str) -> str:
    return "WITH " + v.LISTINGS + "," + CARD_SQL.format(where=where, gain=_GAIN, texts=_TEXTS) + tail


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return v.read(spark, sf_dir, name)


# ---- catalog


def _cards(spark: SparkSession, sf_dir: str, search: Search = Search()) -> DataFrame:  # noqa: B008
    return catalog.cards(v.listings(spark, sf_dir), catalog.matches(search), v.CARD)


_SHOWN = "SELECT id, fallback_id, course_type, category, course_code, class_no, teacher, course_name, department, major, notes, credits, first_period FROM card"
_CARD_COLUMNS = ("id", "fallback_id", "course_type", "category", "course_code", "class_no", "teacher", "course_name", "department", "major", "notes", "credits", "first_period")


@query(cards_sql("course_type = 'ECONOMY'", _SHOWN))
def course_cards(spark, sf_dir):
    return _cards(spark, sf_dir, Search(type="ECONOMY")).select(*_CARD_COLUMNS)


@query("WITH " + v.LISTINGS + " SELECT CAST(count(DISTINCT group_key) AS BIGINT) AS total FROM listing WHERE course_type = 'ECONOMY'")
def course_cards_count(spark, sf_dir):
    return catalog.count_cards(v.listings(spark, sf_dir), catalog.matches(Search(type="ECONOMY")))


@query("SELECT 'c' || c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'c' AS level, CAST(CASE WHEN trim(c_mktsegment, ' ') <> '' THEN 3 ELSE 2 END AS BIGINT) AS completeness FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, '', 's', 2 FROM supplier")
def list_union_levels(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("c").alias("level"), catalog.completeness(["c_name", "c_acctbal", "c_mktsegment"]).alias("completeness"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("segment"), F.lit("s").alias("level"), catalog.completeness(["s_name", "s_acctbal"]).alias("completeness"))
    return catalog.union_levels(c, s)


@query("WITH " + v.LISTINGS + " SELECT id, completeness, group_key FROM (SELECT id, CAST(completeness AS BIGINT) AS completeness, group_key FROM listing)")
def completeness_and_keys(spark, sf_dir):
    return v.listings(spark, sf_dir).select("id", "completeness", "group_key")


@query("WITH " + v.LISTINGS + """ SELECT 'course_type' AS facet, course_type AS value FROM listing WHERE course_type <> '' UNION SELECT 'course_type', 'EXTRA' UNION SELECT 'category', category FROM listing WHERE category <> ''
UNION SELECT 'department', department FROM listing WHERE department <> '' UNION SELECT 'first_period', CAST(first_period AS VARCHAR) FROM listing""")
def facet_values(spark, sf_dir):
    return catalog.facets(v.listings(spark, sf_dir), ["course_type", "category", "department"], ["first_period"], {"course_type": ["EXTRA"]})


@query(f"SELECT doc_id FROM documents WHERE contains({FOLD.format('text')}, 'the h')")
def search_ascii_ci(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(t.contains("text", "The H")).select("doc_id")


@query(f"SELECT p_partkey FROM part WHERE contains({FOLD.format('p_name')}, 'ring') OR contains({FOLD.format('p_brand')}, 'ring') OR contains({FOLD.format('p_type')}, 'ring')")
def search_multi_column(spark, sf_dir):
    return read(spark, sf_dir, "part").where(t.any_contains(["p_name", "p_brand", "p_type"], "RING")).select("p_partkey")


@query("WITH " + v.LISTINGS + " SELECT id FROM listing WHERE course_type = 'SMALL' AND category = 'size1'")
def filter_equality(spark, sf_dir):
    return v.listings(spark, sf_dir).where(catalog.matches(Search(type="SMALL", category="size1"))).select("id")


@query("WITH " + v.LISTINGS + " SELECT id FROM listing WHERE credits = 901.5")
def filter_credits(spark, sf_dir):
    return v.listings(spark, sf_dir).where(catalog.matches(Search(credits="901.50"))).select("id")


@query("SELECT o_orderkey FROM orders WHERE contains(o_orderpriority, 'NOT')")
def filter_contains_token(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(F.col("o_orderpriority").contains("NOT")).select("o_orderkey")


@query(cards_sql("category = 'size1'", " SELECT * FROM (SELECT id, fallback_id, course_type, category FROM card)"))
def filtered_group_identity(spark, sf_dir):
    return _cards(spark, sf_dir, Search(category="size1")).select("id", "fallback_id", "course_type", "category")


@query(cards_sql(f"contains({FOLD.format('course_name')}, 'bolt') AND department = 'SMALL'", " SELECT id, course_name, department FROM card"))
def search_and_filter(spark, sf_dir):
    source = v.listings(spark, sf_dir).withColumns({"english_name": F.lit(None).cast("string"), "classroom": F.lit(""), "display_classroom": F.lit("")})
    return catalog.cards(source, catalog.matches(Search(q="BOLT", department="SMALL")), v.CARD).select("id", "course_name", "department")


_DISPLAY = "WITH " + v.LISTINGS + "," + v.TRANSLATIONS


@query(_DISPLAY + " SELECT id, coalesce(nullif(trim(n.text, ' '), ''), course_name) AS display_course_name, coalesce(nullif(trim(x.text, ' '), ''), notes) AS display_notes FROM listing LEFT JOIN translation n ON n.course_id = local_id AND n.field = 'course_name' AND n.lang = 'en' LEFT JOIN translation x ON x.course_id = local_id AND x.field = 'notes' AND x.lang = 'en'")
def translated_display(spark, sf_dir):
    return catalog.with_display(v.listings(spark, sf_dir), v.translations(spark, sf_dir), "en", ("course_name", "notes")).select("id", "display_course_name", "display_notes")


@query(_DISPLAY + " SELECT id, CASE WHEN trim(n.text, ' ') <> '' THEN n.text ELSE course_name END AS course_name, CASE WHEN trim(x.text, ' ') <> '' THEN x.text ELSE notes END AS notes FROM listing LEFT JOIN translation n ON n.course_id = local_id AND n.field = 'course_name' AND n.lang = 'en' LEFT JOIN translation x ON x.course_id = local_id AND x.field = 'notes' AND x.lang = 'en'")
def detail_overlay(spark, sf_dir):
    return catalog.overlay(v.listings(spark, sf_dir), v.translations(spark, sf_dir), "en", "local_id", ("course_name", "notes")).select("id", "course_name", "notes")


@query("SELECT 'a' || p_partkey AS id, p_name AS course_name, p_brand AS course_code, 'en ' || p_name AS english_name, '' AS weekly_hours, '' AS pnp FROM part WHERE p_partkey = 7")
def detail_lookup(spark, sf_dir):
    p = read(spark, sf_dir, "part").where("p_partkey = 7")
    basic = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("course_name"), F.col("p_brand").alias("course_code"))
    names = [x for x in catalog.DETAIL["undergraduate"] if x != "english_name"]
    details = p.select(F.col("p_partkey").alias("course_id"), F.concat(F.lit("en "), "p_name").alias("english_name"), *(F.lit(None).cast("string").alias(x) for x in names))
    return catalog.detail(basic, details, "a", 7).select("id", "course_name", "course_code", "english_name", "weekly_hours", "pnp")


_NAME = f"(CASE WHEN course_name IS NULL OR course_name = '' THEN 1 ELSE 0 END), {FOLD.format('course_name')}"


def _sort(name: str, search: Search, sql: str, boost: Column | None = None):
    def fn(spark, sf_dir):
        return ranked(_cards(spark, sf_dir), catalog.order(search, boost), "id")

    fn.__name__ = name
    query(cards_sql("true", f" SELECT id, row_number() OVER (ORDER BY {sql}) AS rank FROM card"))(fn)


_sort("sort_name_asc", Search(sort="name_asc"), f"{_NAME} NULLS FIRST, id")
_sort("sort_name_desc", Search(sort="name_desc"), f"{_NAME} DESC NULLS LAST, id")
_sort("sort_credits_asc", Search(sort="credits_asc"), f"(CASE WHEN credits IS NULL THEN 1 ELSE 0 END), credits, {_NAME} NULLS FIRST, id")
_sort("sort_credits_desc", Search(sort="credits_desc"), f"(CASE WHEN credits IS NULL THEN 1 ELSE 0 END), credits DESC, {_NAME} NULLS FIRST, id")
_sort("sort_time", Search(sort="time_asc"), f"(CASE WHEN first_period IS NULL THEN 1 ELSE 0 END), first_period, {_NAME} NULLS FIRST, id")
_MUL, _ADD = (731 * 1664525) % catalog.PRIME, (731 * 1013904223) % catalog.PRIME
_sort("sort_random_seeded", Search(sort="random", random_seed=731), f"(CAST(substr(id, 2) AS BIGINT) * {_MUL} + 111113 + {_ADD}) % {catalog.PRIME}, id")


@query(cards_sql("true", f" SELECT id, row_number() OVER (ORDER BY (CASE WHEN department = 'SMALL' OR contains(course_name, 'gear') THEN 0 ELSE 1 END), {_NAME} NULLS FIRST, id) AS rank FROM card"))
def sort_boosted(spark, sf_dir):
    boost = F.coalesce(F.col("department") == "SMALL", F.lit(False)) | F.col("course_name").contains("gear")
    return ranked(_cards(spark, sf_dir), catalog.order(Search(), boost), "id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_limit_offset(spark, sf_dir):
    return catalog.page(read(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], Page(3, 50)).select("o_orderkey", "o_totalprice")


@query("WITH " + v.LISTINGS + " SELECT group_key, string_agg(DISTINCT course_type, ',' ORDER BY course_type) AS course_type, string_agg(DISTINCT category, ',' ORDER BY category) FILTER (trim(category, ' ') <> '') AS category FROM listing GROUP BY group_key")
def badge_arrays(spark, sf_dir):
    return catalog.badges(v.listings(spark, sf_dir), ("course_type", "category"))


# ---- reviews

_T = "WITH " + v.THREADS


@query(_T + f" SELECT pid FROM thread WHERE contains({FOLD.format('content')}, 'heon') OR pid IN (SELECT pid FROM entry WHERE contains({FOLD.format('content')}, 'heon')) OR pid IN (SELECT pid FROM entry WHERE contains(replace(lower(course_name), '-', ''), 'heon'))")
def review_search(spark, sf_dir):
    x = v.threads(spark, sf_dir)
    return reviews.search_threads(x["threads"], x["entries"], x["thread_courses"], " heon ").select("pid")


@query(_T + " SELECT DISTINCT pid FROM entry WHERE contains(replace(lower(course_name), '-', ''), 'system3')")
def review_search_by_course(spark, sf_dir):
    x = v.threads(spark, sf_dir)
    return reviews.search_threads(x["threads"], x["entries"], x["thread_courses"], "System - 3").select("pid")


_SCORE = "(CASE WHEN post_kind = 'review' THEN 120 ELSE 0 END) + relevant_reply_count * 40 + least(length(content), 900) // 6"


@query(_T + f" SELECT pid, CAST({_SCORE} AS BIGINT) AS quality FROM thread")
def review_quality(spark, sf_dir):
    return v.threads(spark, sf_dir)["threads"].select("pid", reviews.quality().cast("long").alias("quality"))


@query(_T + f""", featured AS (SELECT pid, {_SCORE} AS quality FROM thread WHERE posted_at >= {reviews.YEAR[0]} AND posted_at < {reviews.YEAR[1]} ORDER BY quality DESC, pid DESC LIMIT 10)
SELECT t.pid, row_number() OVER (ORDER BY (CASE WHEN f.pid IS NULL THEN 1 ELSE 0 END), f.quality DESC NULLS LAST, f.pid DESC NULLS LAST, t.posted_at DESC, t.pid DESC) AS rank FROM thread t LEFT JOIN featured f ON f.pid = t.pid""")
def review_featured_order(spark, sf_dir):
    rows, by = reviews.default_order(v.threads(spark, sf_dir)["threads"])
    return ranked(rows, by, "pid")


@query(_T + """, own AS (SELECT DISTINCT pid, course_name FROM entry),
marks AS (SELECT entry_key, (strpos(content, 'on') - 1) || '-' || (strpos(content, 'on') + 1) || ':' || CASE WHEN kind = 'post' THEN 'course' ELSE 'teacher' END AS mark FROM entry WHERE strpos(content, 'on') > 0)
SELECT t.pid, (SELECT string_agg(course_name, ',' ORDER BY course_name) FROM own WHERE own.pid = t.pid) AS courses,
  (SELECT string_agg(e.kind || ' ' || e.floor || ' ' || e.course_name || ' ' || coalesce(m.mark, ''), ';' ORDER BY CASE WHEN e.kind = 'post' THEN 0 ELSE 1 END, e.floor, e.cid) FROM entry e LEFT JOIN marks m USING (entry_key) WHERE e.pid = t.pid) AS entries,
  (SELECT mark FROM marks WHERE entry_key = 'p' || t.pid) AS post_mark FROM thread t""")
def review_nested_threads(spark, sf_dir):
    x = v.threads(spark, sf_dir)
    got = reviews.nested(x["threads"], x["entries"], x["thread_courses"], x["entry_courses"], x["highlights"])
    mark = lambda h: F.concat(h["start_offset"], F.lit("-"), h["end_offset"], F.lit(":"), h["entity_type"])
    line = lambda e: F.concat_ws(" ", e["kind"], e["floor"].cast("string"), F.array_join(e["courses"], ","), F.array_join(F.transform(e["highlights"], mark), ","))
    return got.select("pid", F.array_join("courses", ",").alias("courses"), F.array_join(F.transform("entries", line), ";").alias("entries"), F.nullif(F.array_join(F.transform("highlights", mark), ","), F.lit("")).alias("post_mark"))


@query(_T + f""", featured AS (SELECT pid, {_SCORE} AS quality FROM thread WHERE posted_at >= {reviews.YEAR[0]} AND posted_at < {reviews.YEAR[1]} ORDER BY quality DESC, pid DESC LIMIT 10)
SELECT t.pid, (SELECT count(*) FROM entry e WHERE e.pid = t.pid) AS n_entries FROM thread t LEFT JOIN featured f ON f.pid = t.pid
ORDER BY (CASE WHEN f.pid IS NULL THEN 1 ELSE 0 END), f.quality DESC NULLS LAST, f.pid DESC NULLS LAST, t.posted_at DESC, t.pid DESC LIMIT 20 OFFSET 20""")
def review_list_page(spark, sf_dir):
    x = v.threads(spark, sf_dir)
    _, shown = reviews.list_reviews(x["threads"], x["entries"], x["thread_courses"], x["entry_courses"], x["highlights"], "", Page(2, 20, 100))
    return shown.select("pid", F.size("entries").cast("long").alias("n_entries"))


@query(_T + " SELECT t.pid, (SELECT count(*) FROM entry e WHERE e.pid = t.pid AND kind = 'reply') AS reply_count, (SELECT string_agg(cast(e.cid AS VARCHAR), ',' ORDER BY cid) FROM entry e WHERE e.pid = t.pid AND kind = 'reply') AS replies FROM thread t WHERE pid = 4")
def review_thread_detail(spark, sf_dir):
    x = v.threads(spark, sf_dir)
    got = reviews.thread_detail(x["threads"], x["replies"], 4)
    return got.select("pid", "reply_count", F.array_join(F.transform("replies", lambda r: r["cid"].cast("string")), ",").alias("replies"))


@query(_T + " SELECT course_name, count(DISTINCT pid) AS thread_count, count(DISTINCT entry_key) AS entry_count FROM entry GROUP BY course_name")
def catalog_rollup(spark, sf_dir):
    return reviews.course_catalog(v.threads(spark, sf_dir)["mentions"])


@query(_T + ", c AS (SELECT course_name, count(DISTINCT pid) AS thread_count, count(DISTINCT entry_key) AS entry_count FROM entry GROUP BY course_name) SELECT course_name, replace(course_name, '-', '|') AS course_codes, thread_count, entry_count FROM c WHERE contains(course_name, 's') ORDER BY thread_count DESC, entry_count DESC, course_name LIMIT 5")
def course_suggestions(spark, sf_dir):
    rows = reviews.course_catalog(v.threads(spark, sf_dir)["mentions"]).withColumns({"search_name": F.regexp_replace("course_name", "-", ""), "course_codes": F.regexp_replace("course_name", "-", ",,")})
    return reviews.suggestions(rows, "S", 5).withColumn("course_codes", F.array_join("course_codes", "|"))


@query("SELECT string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS settings FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def metadata_map(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").cast("string").alias("value"))
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return reviews.metadata_map(rows).select(F.array_join(pairs, ";").alias("settings"))


@query("SELECT strftime(min(ts) + INTERVAL 8 HOUR, '%Y-%m-%d') AS start_date, strftime(max(ts) + INTERVAL 8 HOUR, '%Y-%m-%d') AS end_date FROM events")
def date_range_utc8(spark, sf_dir):
    return reviews.date_range(v.visits(spark, sf_dir), "at")


_ZERO = [x for x in reviews.COUNTERS if x not in ("source_posts", "source_replies", "uncached_reply_difference")]


@query(
    "SELECT CAST(max(conv_id) AS VARCHAR) AS snapshot_date, '' AS classifier_version, '3' AS highlight_version, count(*) FILTER (turn = 0) AS source_posts, count(*) FILTER (turn > 0) AS source_replies, count(*) FILTER (role = 'user') AS uncached_reply_difference, "
    + ", ".join(f"0::BIGINT AS {x}" for x in _ZERO)
    + ", round(100.0 * count(*) FILTER (length(text) > 100) / count(*), 4)::DOUBLE AS cached_reply_coverage_percent, strftime(TIMESTAMP '2025-12-17' + to_seconds(CAST(min(conv_id) * 43200 AS BIGINT)) + INTERVAL 8 HOUR, '%Y-%m-%d') AS start_date, strftime(TIMESTAMP '2025-12-17' + to_seconds(CAST(max(conv_id) * 43200 AS BIGINT)) + INTERVAL 8 HOUR, '%Y-%m-%d') AS end_date FROM conversations"
)
def metadata_payload(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    said = {"snapshot_date": F.max("conv_id"), "highlightVersion": F.lit(3), "sourcePosts": F.count_if(F.col("turn") == 0), "source_replies": F.count_if(F.col("turn") > 0), "uncachedReplyDifference": F.count_if(F.col("role") == "user"), "cachedReplyCoveragePercent": F.round(100.0 * F.count_if(F.length("text") > 100) / F.count("*"), 4)}
    rows = c.agg(F.array(*(F.struct(F.lit(k).alias("key"), x.cast("string").alias("value")) for k, x in said.items())).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return reviews.metadata_payload(rows, reviews.date_range(c.select((F.lit(1765929600) + F.col("conv_id") * 43200).alias("posted_at"))))


# ---- checks


@query("WITH o AS (SELECT DISTINCT o_custkey + 7 AS k FROM orders) SELECT k AS key, 'right' AS side FROM o WHERE k NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'left' FROM customer WHERE c_custkey NOT IN (SELECT k FROM o)")
def set_equality_check(spark, sf_dir):
    return checks.key_difference(read(spark, sf_dir, "customer"), "c_custkey", read(spark, sf_dir, "orders").select((F.col("o_custkey") + 7).alias("k")), "k")


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS distinct_keys, count(*) = count(DISTINCT l_orderkey) AS is_unique FROM lineitem")
def unique_key_check(spark, sf_dir):
    return checks.count_profile(read(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def fk_check(spark, sf_dir):
    return checks.missing_keys(read(spark, sf_dir, "lineitem"), "l_orderkey", read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), "o_orderkey")


@query("SELECT count(*) AS basic, true AS basic_unique, count(*) AS detail, true AS detail_unique, CAST(0 AS BIGINT) AS unpaired, (SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5))) AS orphans, false AS healthy FROM part WHERE p_size > 5")
def catalog_health(spark, sf_dir):
    p = read(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"))
    return checks.catalog_health(p, p.withColumnRenamed("id", "course_id"), read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("course_id")))


@query(_T + ", m AS (SELECT * FROM entry WHERE strpos(content, 'on') > 0) SELECT 'matched_threads' AS key, count(*) AS value FROM thread UNION ALL SELECT 'matched_entries', count(*) FROM entry UNION ALL SELECT 'posts', count(*) FROM entry WHERE kind = 'post' UNION ALL SELECT 'snapshot_replies', count(*) FROM entry WHERE kind = 'reply' UNION ALL SELECT CASE WHEN kind = 'post' THEN 'course' ELSE 'teacher' END || '_highlights', count(*) FROM m GROUP BY 1 UNION ALL SELECT CASE WHEN kind = 'post' THEN 'course' ELSE 'teacher' END || '_alias_highlights', count(*) FROM m WHERE cid % 2 = 1 GROUP BY 1 UNION ALL SELECT split_part(course_name, '-', 1) || '_aliases', count(DISTINCT course_name) FROM entry GROUP BY 1")
def review_counters(spark, sf_dir):
    return checks.review_counts(**_store(spark, sf_dir))


def _store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    x = v.threads(spark, sf_dir)
    aliases = x["mentions"].select(F.split("course_name", "-")[0].alias("entity_type"), F.col("course_name").alias("normalized_alias"))
    return {"threads": x["threads"], "entries": x["entries"], "replies": x["replies"], "highlights": x["highlights"], "aliases": aliases}


_STATED = ("matched_threads", "matched_entries", "snapshot_replies")


#: The metadata states what is counted, but one entry too many.
@query(
    ORACLES["review_counters"].replace("SELECT 'matched_threads' AS key", ", k AS (SELECT 'matched_threads' AS key", 1).replace(", , k AS", ", k AS")
    + "), n AS (SELECT " + ", ".join(f"coalesce(max(value) FILTER (key = '{x}'), 0) AS {x}" for x in (*_STATED, "posts", "course_highlights", "teacher_highlights", "course_alias_highlights", "teacher_alias_highlights")) + " FROM k) "
    + " UNION ALL ".join(
        [f"""SELECT '{x}' AS "check", CAST({x} + {int(x == 'matched_entries')} AS VARCHAR) AS expected, CAST({x} AS VARCHAR) AS found, {x != 'matched_entries'} AS fine FROM n""" for x in _STATED]
        + [f"SELECT '{x}_aliases', NULL, '0', false FROM n" for x in ("course", "teacher")]
        + ["SELECT 'highlights', CAST(course_highlights + teacher_highlights AS VARCHAR), CAST(course_highlights + teacher_highlights AS VARCHAR), true FROM n"]
        + [f"SELECT '{x}_alias_highlights', CASE WHEN {x}_highlights > 0 THEN CAST({x}_highlights AS VARCHAR) END, CASE WHEN {x}_alias_highlights > 0 THEN CAST({x}_alias_highlights AS VARCHAR) END, true FROM n" for x in ("course", "teacher")]
        + ["SELECT 'highlight_version', '3', '3', true FROM n", "SELECT 'posts', CAST(matched_threads AS VARCHAR), CAST(posts AS VARCHAR), posts = matched_threads FROM n"]
        + ["SELECT 'entries', CAST(matched_threads AS VARCHAR), CAST(matched_entries AS VARCHAR), true FROM n", "SELECT 'invalid highlight spans', '0', '0', true FROM n"]
    )
)
def review_health(spark, sf_dir):
    store = _store(spark, sf_dir)
    counts = checks.review_counts(**store)
    stated = counts.select("key", (F.col("value") + F.when(F.col("key") == "matched_entries", 1).otherwise(0)).cast("string").alias("value"))
    return checks.review_health_checks(**store, metadata=stated.union(spark.createDataFrame([("highlight_version", "3")], "key string, value string")))


@query("SELECT doc_id, strpos(text, substr(text, 11, 15)) - 1 AS start_offset, strpos(text, substr(text, 11, 15)) - 1 + length(substr(text, 11, 15)) AS end_offset FROM documents")
def highlight_offsets(spark, sf_dir):
    start, end = mining.spans_of(F.col("text"), F.substring("text", 11, 15))
    return read(spark, sf_dir, "documents").select("doc_id", start.cast("long").alias("start_offset"), end.cast("long").alias("end_offset"))


@query("WITH h AS (SELECT doc_id, l.s AS s, l.s + 20 AS e, length(text) AS n FROM documents, (SELECT unnest([0, 15, 40, 900]) AS s) l), o AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s, e) AS before FROM h) SELECT CAST(doc_id AS VARCHAR) AS entry_key, CAST(s AS BIGINT) AS start_offset, CAST(e AS BIGINT) AS end_offset FROM o WHERE s < before OR s < 0 OR e <= s OR e > n")
def highlight_validity(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entry_key"), F.col("text").alias("content"))
    h = d.select("entry_key", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 15, 40, 900)))).alias("start_offset")).withColumn("end_offset", F.col("start_offset") + 20)
    return checks.bad_spans(h, d)


@query("SELECT DISTINCT text, lang FROM documents")
def exact_dedup(spark, sf_dir):
    return checks.collapse(read(spark, sf_dir, "documents"), ["text"], ["lang"])[0]


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS variants FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_partkey, l_suppkey, l_quantity)) > 1")
def conflicting_keys(spark, sf_dir):
    return checks.collapse(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])[1]


@query("SELECT page_id, CASE WHEN regexp_extract(url, '^([A-Za-z]+)://', 1) <> 'https' THEN 'scheme' WHEN contains(regexp_extract(url, '^https://([^/?#]*)', 1), '@') THEN 'user' WHEN regexp_extract(url, '^https://([^/?#]*)', 1) <> 'thther.example.org' THEN 'host' WHEN regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1) <> '/en/685' THEN 'path' WHEN ends_with(url, '&') THEN 'trailing' END AS fault FROM pages")
def url_contract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", checks.link_fault(F.col("url"), "thther.example.org", "/en/685").alias("fault"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1)) AS BIGINT) AS links FROM pages")
def html_contract(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit(r'<li><a href="([^"]*)"'), 1)
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("links"))


@query("WITH r AS (SELECT o_orderkey // 7 AS seq, o_orderstatus AS kind, CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE 'x' END AS link, CAST(o_custkey AS VARCHAR) AS code FROM orders) SELECT 'duplicate_seq' AS fault, CAST(seq AS VARCHAR) AS key FROM r GROUP BY seq HAVING count(*) > 1 UNION ALL SELECT 'duplicate_key', kind || '|' || code FROM r GROUP BY kind, code HAVING count(*) > 1 UNION ALL SELECT 'missing_link', CAST(seq AS VARCHAR) FROM r WHERE link = ' '")
def payload_faults(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 7").alias("seq"), F.col("o_orderstatus").alias("kind"), F.when(F.col("o_orderkey") % 50 == 0, " ").otherwise("x").alias("link"), F.col("o_custkey").cast("string").alias("code"))
    return checks.payload_faults(o, "seq", "link", "code", "kind", ["kind", "code"])


@query("SELECT o_orderpriority AS kind, count(*) AS counted, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE count(*) - 1 END AS stated FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1 UNION ALL SELECT 'OTHER', NULL, 3")
def payload_stats_check(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'")
    stated = o.where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("kind")).agg((F.count("*") - 1).alias("n")).union(spark.createDataFrame([("OTHER", 3)], "kind string, n long"))
    return checks.stats_mismatch(o, "o_orderpriority", stated)


@query("WITH g AS (SELECT l_returnflag AS kind, l_orderkey % 40 AS page, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT * FROM g WHERE n < (SELECT max(n) FROM g x WHERE x.kind = g.kind) AND page < (SELECT max(page) FROM g x WHERE x.kind = g.kind)")
def short_pages(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") % 40).alias("page")).agg(F.count("*").alias("n"))
    return checks.short_pages(g, "kind", "page", "n")


@query("SELECT p_partkey AS row_index, CASE WHEN p_partkey % 13 = 0 THEN 'blank code' WHEN p_partkey % 17 = 0 THEN 'credits are no number' ELSE 'blank type' END AS fault FROM part WHERE p_partkey % 13 = 0 OR p_partkey % 17 = 0 OR p_partkey % 19 = 0")
def builder_input_check(spark, sf_dir):
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(k.alias("row_index"), F.when(k % 13 == 0, " ").otherwise("c").alias("course_code"), F.when(k % 17 == 0, "two").otherwise("2.5").alias("credits"), F.when(k % 19 != 0, "t").alias("course_type"))
    return checks.builder_faults(rows)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long", {"mode": "FAILFAST"})["k"].alias("k"))


# ---- mining


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def entity_match(spark, sf_dir):
    return mining.entity_pairs(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


#: RE2 takes the first alternative that matches, so the longest come first; places follow from the
#: lengths of the pieces between the matches.
@query("""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part UNION SELECT unnest(['the', 'then', 'thering'])),
p AS (SELECT string_agg(name, '|' ORDER BY length(name) DESC, name) AS pattern FROM n WHERE name <> ''),
m AS (SELECT doc_id, regexp_extract_all(text, pattern) AS ms, regexp_split_to_array(text, pattern) AS gs FROM documents, p),
k AS (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT doc_id, ms[i] AS name, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM k)
SELECT doc_id, name, start, start + length(name) AS "end" FROM s""")
def entity_match_longest(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.split("p_name", " ")[1].alias("name")).union(spark.createDataFrame([("the",), ("then",), ("thering",)], "name string"))
    return mining.longest_matches(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", names)


#: Of each text the first word is taken as a name and the second as written beside it; what else stands
#: beside the name in the text counts as well.
_BESIDE = r"[^\s/／|=()（）\[\]【】,，.。;；:：!！?？、]+"


@query(r"""WITH d AS (SELECT doc_id, regexp_extract(text, '^(\S+) (\S)', 1) AS name, regexp_replace(text, '^(\S+) (\S)', '\1/\2') AS content FROM documents WHERE regexp_matches(text, '^(\S+) (\S)')),
f AS (SELECT doc_id, name, unnest(regexp_extract_all(content, '\Q' || name || '\E/(""" + _BESIDE + r""")', 1)) AS alias FROM d
  UNION ALL SELECT doc_id, name, unnest(regexp_extract_all(content, '(""" + _BESIDE + r""")/\Q' || name || '\E', 1)) FROM d),
p AS (SELECT DISTINCT doc_id, name, alias FROM f WHERE length(alias) BETWEEN 2 AND 12 AND alias <> name AND lower(alias) NOT IN ('ppt', 'sky', 'ddl', 'lz', 'dz', 'gpa')),
b AS (SELECT name, alias, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2), o AS (SELECT alias, count(DISTINCT doc_id) AS a FROM p GROUP BY ALL), c AS (SELECT name, count(*) AS c FROM d GROUP BY ALL), t AS (SELECT count(*) AS t FROM documents),
m AS (SELECT name, alias, n, a, c, t, unnest([{'n': n, 'x': a, 'y': c}, {'n': a - n, 'x': a, 'y': t - c}, {'n': c - n, 'x': t - a, 'y': c}, {'n': t - a - c + n, 'x': t - a, 'y': t - c}]) AS z FROM b JOIN o USING (alias) JOIN c USING (name), t),
s AS (SELECT name, alias, n, 2 * sum(CASE WHEN z.n > 0 THEN z.n * ln(z.n::DOUBLE * t / (z.x::DOUBLE * z.y)) ELSE 0 END) AS ratio FROM m WHERE n * t > a * c GROUP BY ALL),
k AS (SELECT *, round(ratio, 6) AS r, rank() OVER (PARTITION BY alias ORDER BY round(ratio, 6) DESC, n DESC) AS place FROM s WHERE ratio >= 3.84)
SELECT alias, 'course' AS entity_type, any_value(name) AS canonical_name, any_value(n)::BIGINT AS evidence_count, any_value(r) AS ratio FROM k WHERE place = 1 GROUP BY alias HAVING count(*) = 1""")
def alias_mining(spark, sf_dir):
    name = F.regexp_extract("text", r"^(\S+) (\S)", 1)
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_key"), F.when(name != "", name).alias("course_name"), F.regexp_replace("text", r"^(\S+) (\S)", "$1/$2").alias("content"), F.array().cast("array<string>").alias("teachers"))
    return aliases.mine(rows, between="/").withColumn("ratio", F.round("ratio", 6))


#: Counts, weights and scores of the naive Bayes classifier.
_BAYES = """f AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS feature FROM documents),
l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'dropped' WHEN quality = 1 THEN 'review' ELSE 'request' END AS kind FROM labels),
n AS (SELECT feature, count(*) FILTER (kind = 'dropped') AS a, count(*) FILTER (kind = 'request') AS b, count(*) FILTER (kind = 'review') AS c FROM f JOIN l USING (doc_id) GROUP BY 1),
s AS (SELECT count(*) AS v, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc FROM n),
w AS (SELECT feature, ln((a + 1) / (sa + v)) AS a, ln((b + 1) / (sb + v)) AS b, ln((c + 1) / (sc + v)) AS c FROM n, s),
p AS (SELECT ln(count(*) FILTER (kind = 'dropped') / count(*)) AS a, ln(count(*) FILTER (kind = 'request') / count(*)) AS b, ln(count(*) FILTER (kind = 'review') / count(*)) AS c FROM l)"""


def _classifier(spark: SparkSession, sf_dir: str) -> mining.Classifier:
    kind = F.when(F.col("toxic") == 1, "dropped").when(F.col("quality") == 1, "review").otherwise("request").alias("kind")
    return mining.Classifier.learn(read(spark, sf_dir, "labels").select("doc_id", kind).join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


@query("WITH " + _BAYES + """, t AS (SELECT doc_id, coalesce(sum(w.a), 0) + any_value(p.a) AS a, coalesce(sum(w.b), 0) + any_value(p.b) AS b, coalesce(sum(w.c), 0) + any_value(p.c) AS c FROM documents LEFT JOIN f USING (doc_id) LEFT JOIN w USING (feature), p GROUP BY doc_id)
SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'dropped' WHEN b >= c THEN 'request' ELSE 'review' END AS kind, round(greatest(a, b, c) - greatest(least(a, b), least(greatest(a, b), c)), 6) AS margin FROM t""")
def thread_classifier(spark, sf_dir):
    return _classifier(spark, sf_dir).classify(read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("margin", F.round("margin", 6))


@query()
def thread_kinds(spark, sf_dir):
    kind = F.when(F.col("toxic") == 1, "dropped").when(F.col("quality") == 1, "review").otherwise("request").alias("kind")
    labelled = read(spark, sf_dir, "labels").select("doc_id", kind).join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "key")
    learned = kinds.Kinds.learn(labelled)
    given = learned.classify(read(spark, sf_dir, "documents"), "doc_id", "text").groupBy("kind").agg(F.count("*").alias("documents"))
    return learned.report().join(kinds.naive_bayes_out_of_fold(labelled), "kind").join(given, "kind", "left")


_HIDE = (
    r"regexp_replace(regexp_replace({0}, '(?i)微信\s*(?:号|id)?\s*[:：]?\s*[a-z][a-z0-9_-]{{4,19}}', '[联系方式已隐藏]', 'g'), '(?i)(^|[^a-z])(?:vx|wx|wechat|v信)\s*(?:号|id)?\s*[:：]?\s*[a-z][a-z0-9_-]{{4,19}}', '\1[联系方式已隐藏]', 'g')",
    r"regexp_replace({0}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[联系方式已隐藏]', 'g')",
    r"regexp_replace({0}, '(^|[^0-9])1[3-9][0-9]{{9}}([^0-9]|$)', '\1[联系方式已隐藏]\2', 'g')",
    r"regexp_replace({0}, '(?i)(^|[^a-z])qq?\s*(?:号|群)?\s*[:：]?\s*[1-9][0-9]{{5,10}}([^0-9]|$)', '\1[联系方式已隐藏]\2', 'g')",
)
_CONTACT = "(text || ' VX: some_one' || doc_id || ', q ' || (doc_id + 1000000) || ', a.b@mail.example ')"


@query(
    # RE2 looks neither back nor ahead, so what stands around a contact is put back; twice, as one sign
    # may stand between two of them
    "SELECT doc_id, " + _HIDE[3].format(_HIDE[3].format(_HIDE[2].format(_HIDE[2].format(_HIDE[1].format(_HIDE[0].format(_HIDE[0].format(_CONTACT))))))) + " AS text FROM documents"
)
def redact_contacts(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" VX: some_one"), "doc_id", F.lit(", q "), F.col("doc_id") + 1000000, F.lit(", a.b@mail.example ")).alias("text"))
    return rows.select("doc_id", mining.redact("text").alias("text"))


@query("WITH " + _BAYES + """, g AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS feature FROM conversations),
t AS (SELECT conv_id, turn, coalesce(sum(w.a), 0) + any_value(p.a) AS a, coalesce(sum(w.b), 0) + any_value(p.b) AS b, coalesce(sum(w.c), 0) + any_value(p.c) AS c FROM conversations LEFT JOIN g USING (conv_id, turn) LEFT JOIN w USING (feature), p GROUP BY 1, 2),
k AS (SELECT conv_id, turn, CASE WHEN a >= b AND a >= c THEN 'dropped' WHEN b >= c THEN 'request' ELSE 'review' END AS kind FROM t)
SELECT r.conv_id AS pid, r.turn AS cid, 'only' AS courses FROM k r JOIN k post ON post.conv_id = r.conv_id AND post.turn = 0 AND post.kind <> 'dropped' WHERE r.turn > 0 AND r.kind = 'review'""")
def reply_relevance(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    rows = c.join(_classifier(spark, sf_dir).classify(c, "key", "text"), "key")
    replies = rows.where("turn > 0").select(F.col("conv_id").alias("pid"), F.col("turn").alias("cid"), F.col("text").alias("content"), F.array().cast("array<string>").alias("courses"), (F.col("kind") == "review").alias("useful"))
    posts = rows.where("turn = 0 AND kind <> 'dropped'").select(F.col("conv_id").alias("pid"), F.array(F.lit("only")).alias("courses"))
    return mining.kept_replies(replies, posts).select("pid", "cid", F.array_join("courses", ",").alias("courses"))


# ---- activity


@query("WITH " + v.DAYS + " SELECT day, ip_hash, views, last_at FROM day")
def visit_upsert(spark, sf_dir):
    return activity.visit_days(v.visits(spark, sf_dir))


@query("WITH " + v.DAYS + """ SELECT CAST(coalesce(sum(views) FILTER (day = '2024-01-20'), 0) AS BIGINT) AS today_views, count(*) FILTER (day = '2024-01-20') AS today_visitors, CAST(coalesce(sum(views) FILTER (day >= '2024-01-14'), 0) AS BIGINT) AS week_views,
count(DISTINCT ip_hash) FILTER (day >= '2024-01-14') AS week_visitors, CAST(sum(views) AS BIGINT) AS total_views, count(DISTINCT ip_hash) AS total_visitors FROM day""")
def visit_stats(spark, sf_dir):
    return activity.visit_stats(activity.visit_days(v.visits(spark, sf_dir)), v.NOW)


@query("WITH " + v.DAYS + ", n AS (SELECT strftime(DATE '2024-02-03' - CAST(i AS INTEGER), '%Y-%m-%d') AS day FROM range(7) r(i)) SELECT n.day, CAST(coalesce(sum(views), 0) AS BIGINT) AS views FROM n LEFT JOIN day d ON d.day = n.day GROUP BY n.day")
def visit_trend_filled(spark, sf_dir):
    return activity.trend(activity.visit_days(v.visits(spark, sf_dir)), v.NOW + 14 * 86400)


_LIMITS = ((3600, 2), (86400, 20))
_ACCEPTED = """WITH RECURSIVE a AS (SELECT user_id AS sender, CAST(floor(epoch(ts)) AS BIGINT) AS "at", event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events WHERE event_type = 'click'),
r AS (SELECT sender, "at", id, k, true AS ok, ["at"] AS past FROM a WHERE k = 1 UNION ALL
  SELECT a.sender, a."at", a.id, a.k, len(list_filter(r.past, lambda x: x > a."at" - 3600)) < 2 AND len(list_filter(r.past, lambda x: x > a."at" - 86400)) < 20,
    CASE WHEN len(list_filter(r.past, lambda x: x > a."at" - 3600)) < 2 AND len(list_filter(r.past, lambda x: x > a."at" - 86400)) < 20 THEN list_append(list_filter(r.past, lambda x: x > a."at" - 86400), a."at") ELSE r.past END
  FROM r JOIN a ON a.sender = r.sender AND a.k = r.k + 1) SELECT sender, "at", id, ok FROM r"""


@query(_ACCEPTED)
def rate_limit_accepted(spark, sf_dir):
    return activity.accepted(streams.event_attempts(read(spark, sf_dir, "events"), "click"), _LIMITS)


@query(_ACCEPTED)
def rate_limit_stream(spark, sf_dir):
    return streams.limiter_stream(streams.event_attempts(streams.file_stream(spark, f"{sf_dir}/events.parquet"), "click"), _LIMITS)


@query("WITH " + v.DAYS + " SELECT day, ip_hash, views, last_at FROM day")
def visit_stream(spark, sf_dir):
    events = streams.file_stream(spark, f"{sf_dir}/events.parquet")
    rows = events.select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.sha2(F.col("user_id").cast("string"), 256).alias("ip_hash"), F.when(F.col("event_type") == "error", "curl/8").otherwise("Mozilla/5.0").alias("agent"))
    return streams.visit_stream(rows)


@query("SELECT event_id, sha256(CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END) AS ip_hash FROM events")
def hash_identity(spark, sf_dir):
    ip = F.when(F.col("event_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "user_id"))
    return read(spark, sf_dir, "events").select("event_id", activity.sender(ip).alias("ip_hash"))


@query("WITH m AS (" + _ACCEPTED + """) SELECT 7 + row_number() OVER (ORDER BY "at", id) AS id, "at" AS posted_at, 'click' AS content, sender AS ip_hash FROM m WHERE ok""")
def messages_accepted(spark, sf_dir):
    clicks = read(spark, sf_dir, "events").where("event_type = 'click'")
    attempts = clicks.select(F.col("event_id").alias("attempt"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("posted_at"), F.col("event_type").alias("content"), F.col("user_id").alias("ip_hash"))
    there = spark.createDataFrame([(7, 0, "first", -1)], "id long, posted_at long, content string, ip_hash long")
    return activity.post_messages(there, attempts, _LIMITS)


@query("SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS posted_at, event_type AS content FROM events ORDER BY event_id DESC LIMIT 20 OFFSET 20")
def message_page(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("posted_at"), F.col("event_type").alias("content"), F.lit("x").alias("ip_hash"))
    return activity.message_page(rows, 20, 20)


@query(f"SELECT event_id FROM events WHERE floor(epoch(ts)) > {v.NOW} - 3600")
def trailing_window(spark, sf_dir):
    return activity.in_window(read(spark, sf_dir, "events").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp"))), "at", v.NOW, 3600).select("event_id")


# ---- translation


@query("WITH " + v.TRANSLATIONS + """, f AS (SELECT p_partkey AS id, 'course_name' AS field, p_name AS text FROM part UNION ALL SELECT p_partkey, 'notes', CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_type END FROM part),
w AS (SELECT f.*, l.lang FROM f, (SELECT unnest(['en', 'de', 'fr']) AS lang) l WHERE trim(f.text, ' ') <> '')
SELECT id, field, text, string_agg(lang, ',' ORDER BY lang) AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM translation x WHERE x.course_id = w.id AND x.field = w.field AND x.lang = w.lang AND trim(x.text, ' ') <> '') GROUP BY 1, 2, 3""")
def translation_gaps(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("notes", F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_type")))
    return translation.gaps(translation.field_matrix(p, "p_partkey", {"p_name": "course_name", "notes": "notes"}), v.translations(spark, sf_dir), ["en", "de", "fr"])


@query("WITH " + v.TRANSLATIONS + " SELECT p_partkey AS course_id, 'course_name' AS field, 'en' AS lang, trim(p_type, ' ') AS text FROM part WHERE p_partkey NOT IN (SELECT course_id FROM translation WHERE field = 'course_name' AND lang = 'en') ORDER BY p_partkey LIMIT 100")
def english_reuse(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("english_name"))
    return translation.reuse_english(p, v.translations(spark, sf_dir), 100)


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, f.field AS field, CASE WHEN f.field = 'name' THEN n_name ELSE CAST(n_regionkey AS VARCHAR) END AS text FROM nation, (SELECT unnest(['name', 'region']) AS field) f")
def field_matrix(spark, sf_dir):
    return translation.field_matrix(read(spark, sf_dir, "nation"), "n_nationkey", {"n_name": "name", "n_regionkey": "region"})


@query("SELECT doc_id, nullif(regexp_replace(text, '^[ \t\n]+|[ \t\n]+$', '', 'g'), '') AS text FROM documents")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", translation.cleaned("text").alias("text"))


@query()
def normalised_names(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.normalised("text").alias("search_name"))
