"""The driver's tables seen as catalog listings, review threads and visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..operators.catalog import Card

CARD = Card(
    texts={"display_course_name": "course_name", "department": "department", "major": "major", "notes": "notes"},
    values=("credits", "first_period"),
    counted_texts=("department", "major", "notes"),
    counted_values=("credits",),
)
SCORED = ["course_name", "department", "major", "notes", "credits", "first_period"]

#: Epoch seconds that the activity queries take as now: midnight UTC of 20 January 2024.
NOW = 1705708800


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as source rows, with blanks and NULLs put in by p_partkey."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(
        F.concat(F.lit("a"), k.cast("string")).alias("id"), k.alias("local_id"), F.lit("a").alias("level"),
        F.col("p_brand").alias("course_code"), F.col("p_name").alias("class_no"), F.col("p_name").alias("course_name"), F.col("p_name").alias("display_course_name"),
        F.when(k % 11 == 0, " \t").otherwise(F.col("p_brand")).alias("teacher"), F.col("p_type").alias("course_type"),
        F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit("size"), F.expr("p_size div 10").cast("string"))).alias("category"),
        F.when(k % 2 == 0, F.col("p_type")).when(k % 3 == 0, None).otherwise(" ").alias("department"),
        F.when(k % 3 == 0, F.concat("p_brand", F.lit("-"), "p_type")).alias("major"),
        F.when(k % 5 == 0, F.concat("p_name", F.lit(" note"))).otherwise("").alias("notes"),
        F.when(k % 5 != 1, F.col("p_retailprice")).alias("credits"), F.when(k % 4 != 2, F.col("p_size").cast("long")).alias("first_period"),
    )
    return catalog.with_group_key(rows.withColumn("completeness", catalog.completeness(SCORED)))


LISTINGS = """
listing AS (SELECT *, (CASE WHEN trim(coalesce(course_name, ''), ' ') <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(department, ''), ' ') <> '' THEN 1 ELSE 0 END
    + CASE WHEN trim(coalesce(major, ''), ' ') <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(notes, ''), ' ') <> '' THEN 1 ELSE 0 END
    + CASE WHEN credits IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN first_period IS NOT NULL THEN 1 ELSE 0 END) AS completeness,
    level || chr(31) || course_code || chr(31) || class_no || chr(31) || CASE WHEN trim(coalesce(teacher, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' THEN id ELSE teacher END AS group_key
  FROM (SELECT 'a' || CAST(p_partkey AS VARCHAR) AS id, p_partkey AS local_id, 'a' AS level, p_brand AS course_code, p_name AS class_no, p_name AS course_name, p_name AS display_course_name,
    CASE WHEN p_partkey % 11 = 0 THEN ' ' || chr(9) ELSE p_brand END AS teacher, p_type AS course_type,
    CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE 'size' || CAST(p_size // 10 AS VARCHAR) END AS category,
    CASE WHEN p_partkey % 2 = 0 THEN p_type WHEN p_partkey % 3 = 0 THEN NULL ELSE ' ' END AS department,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand || '-' || p_type END AS major, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' note' ELSE '' END AS notes,
    CASE WHEN p_partkey % 5 <> 1 THEN p_retailprice END AS credits, CASE WHEN p_partkey % 4 <> 2 THEN CAST(p_size AS BIGINT) END AS first_period
    FROM part))"""


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations of part names: English for even keys, blank for multiples of six, German for multiples of five."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("course_id"), "p_name", "p_type")
    en = p.where("course_id % 2 = 0").select("course_id", F.lit("course_name").alias("field"), F.lit("en").alias("lang"), F.when(F.col("course_id") % 6 == 0, "  ").otherwise(F.concat(F.lit("  en "), "p_name", F.lit(" "))).alias("text"))
    de = p.where("course_id % 5 = 0").select("course_id", F.lit("course_name").alias("field"), F.lit("de").alias("lang"), F.concat(F.lit("de "), "p_name").alias("text"))
    notes = p.where("course_id % 3 = 0").select("course_id", F.lit("notes").alias("field"), F.lit("en").alias("lang"), F.concat(F.lit(" "), "p_type").alias("text"))
    return en.union(de).union(notes)


TRANSLATIONS = """
translation AS (SELECT p_partkey AS course_id, 'course_name' AS field, 'en' AS lang, CASE WHEN p_partkey % 6 = 0 THEN '  ' ELSE '  en ' || p_name || ' ' END AS text FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, 'course_name', 'de', 'de ' || p_name FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, 'notes', 'en', ' ' || p_type FROM part WHERE p_partkey % 3 = 0)"""


def threads(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """conversations as threads (the first turn is the post), entries, replies, courses and highlights."""
    c = read(spark, sf_dir, "conversations")
    size = c.groupBy("conv_id").agg((F.count("*") - 1).alias("relevant_reply_count"))
    pid, at = (F.col("conv_id") + 1).alias("pid"), F.lit(1766000000) + F.col("conv_id") * 43200
    post = c.where("turn = 0").join(size, "conv_id").select(
        pid, at.alias("posted_at"), F.date_format(F.timestamp_seconds(at), "yyyy-MM").alias("source_month"), F.col("text").alias("content"),
        F.concat(F.lit("https://reviews.example/"), F.col("conv_id") + 1).alias("source_url"), F.when(F.col("conv_id") % 2 == 0, "review").otherwise("request").alias("post_kind"), "relevant_reply_count",
    )
    key = F.when(F.col("turn") == 0, F.concat(F.lit("p"), F.col("conv_id") + 1)).otherwise(F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn"))
    entries = c.select(
        key.alias("entry_key"), pid, F.when(F.col("turn") == 0, "post").otherwise("reply").alias("kind"), F.col("turn").alias("cid"), F.col("turn").alias("floor"),
        (at + F.col("turn") * 60).alias("posted_at"), F.col("text").alias("content"),
    )
    named = c.select(pid, key.alias("entry_key"), F.concat("role", F.lit("-"), F.col("conv_id") % 5).alias("course_name"))
    marks = entries.withColumn("s", F.instr("content", "on") - 1).where("s >= 0").select("entry_key", F.col("s").cast("int").alias("start_offset"), (F.col("s") + 2).cast("int").alias("end_offset"), F.when(F.col("kind") == "post", "course").otherwise("teacher").alias("entity_type"), F.when(F.col("cid") % 2 == 0, "full").otherwise("alias").alias("match_kind"))
    return {
        "threads": post, "entries": entries, "replies": entries.where("kind = 'reply'").withColumn("ordinal", F.col("cid")),
        "thread_courses": named.select("pid", "course_name").distinct().withColumn("search_name", F.regexp_replace(F.lower("course_name"), "-", "")),
        "entry_courses": named.select("entry_key", "course_name"), "mentions": named, "highlights": marks,
    }


THREADS = """
thread AS (SELECT conv_id + 1 AS pid, 1766000000 + conv_id * 43200 AS posted_at, text AS content, CASE WHEN conv_id % 2 = 0 THEN 'review' ELSE 'request' END AS post_kind,
    (SELECT count(*) - 1 FROM conversations x WHERE x.conv_id = c.conv_id) AS relevant_reply_count FROM conversations c WHERE turn = 0),
entry AS (SELECT CASE WHEN turn = 0 THEN 'p' || (conv_id + 1) ELSE 'c' || conv_id || '_' || turn END AS entry_key, conv_id + 1 AS pid, CASE WHEN turn = 0 THEN 'post' ELSE 'reply' END AS kind,
    turn AS cid, turn AS floor, 1766000000 + conv_id * 43200 + turn * 60 AS posted_at, text AS content, role || '-' || (conv_id % 5) AS course_name FROM conversations)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as page visits; error events come from bots."""
    return read(spark, sf_dir, "events").select(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.sha2(F.col("user_id").cast("string"), 256).alias("ip_hash"), F.when(F.col("event_type") == "error", "curl/8").otherwise("Mozilla/5.0").alias("agent")
    )


DAYS = """
day AS (SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, sha256(CAST(user_id AS VARCHAR)) AS ip_hash, count(*) AS views, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last_at
    FROM events WHERE event_type <> 'error' GROUP BY 1, 2)"""
