"""Review retrieval: threads with entries (a post and its kept replies), courses and highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.params import Page, review_query
from ..functions.storage import table

#: Weights of the quality score: a review post, a reply, and length up to a bound (fixed values).
REVIEW, REPLY, LONGEST, PER = 120, 40, 900, 6
FEATURED = 10
#: The year whose threads are featured, in epoch seconds, and the counters of the metadata (fixed values).
YEAR = (1767196800, 1798732800)
COUNTERS = (
    "source_shards", "source_posts", "source_replies", "matched_threads", "matched_entries", "matched_replies", "snapshot_replies", "catalog_courses", "uncached_reply_difference", "highlighted_entries",
    "course_highlights", "teacher_highlights", "course_aliases", "teacher_aliases", "course_alias_highlights", "teacher_alias_highlights",
)
TEXTS, COVERAGE = ("snapshot_date", "classifier_version", "highlight_version"), "cached_reply_coverage_percent"


def quality(content: str = "content", kind: str = "post_kind", replies: str = "relevant_reply_count") -> Column:
    """Integer score; NULL if content or the number of replies is."""
    size = F.when(F.col(content).isNotNull(), F.least(F.length(content), F.lit(LONGEST)))
    return F.when(F.col(kind) == "review", REVIEW).otherwise(0) + F.col(replies) * REPLY + F.floor(size / PER)


def search_threads(threads: DataFrame, entries: DataFrame, thread_courses: DataFrame, query: str) -> DataFrame:
    """Threads whose content, or one of whose entries, holds the query, or one of whose courses'
    normalised names holds the normalised query. The three sets of keys are joined once."""
    query = review_query(query)
    if not query:
        return threads
    keys = threads.where(t.contains("content", query)).select("pid").union(entries.where(t.contains("content", query)).select("pid"))
    if name := t.normalise(query):
        keys = keys.union(thread_courses.where(t.contains("search_name", name)).select("pid"))
    return threads.join(keys.distinct(), "pid", "left_semi")


def newest_first() -> list[Column]:
    return [F.desc("posted_at"), F.desc("pid")]


def featured(threads: DataFrame, span: tuple[int, int] = YEAR, n: int = FEATURED) -> DataFrame:
    """pid and quality of the n best threads of a half-open span of time."""
    rows = threads.where((F.col("posted_at") >= span[0]) & (F.col("posted_at") < span[1]))
    return rows.select("pid", quality().alias("quality")).orderBy(F.desc("quality"), F.desc("pid")).limit(n)


def default_order(threads: DataFrame, span: tuple[int, int] = YEAR, n: int = FEATURED) -> tuple[DataFrame, list[Column]]:
    """threads with the featured ones marked, and the order: those first, then the newest. The
    featured side has at most n rows, so it is broadcast."""
    best = featured(threads, span, n).select("pid", F.col("quality").alias("featured_quality"))
    marked = threads.join(F.broadcast(best), "pid", "left")
    first = F.when(F.col("featured_quality").isNull(), 1).otherwise(0).asc()
    return marked, [first, F.desc("featured_quality"), F.when(F.col("featured_quality").isNotNull(), F.col("pid")).desc(), *newest_first()]


def nested(threads: DataFrame, entries: DataFrame, thread_courses: DataFrame, entry_courses: DataFrame, highlights: DataFrame) -> DataFrame:
    """threads with courses (sorted), entries (post first, then by floor and cid; each with its sorted
    courses and highlights in order) and the post's highlights. Courses and highlights of other
    threads' entries are left out before anything is grouped."""
    rows = entries.join(threads.select("pid"), "pid", "left_semi")
    entry_courses, highlights = (x.join(rows.select("entry_key"), "entry_key", "left_semi") for x in (entry_courses, highlights))
    own = entry_courses.groupBy("entry_key").agg(F.array_sort(F.collect_list("course_name")).alias("courses"))
    marks = highlights.groupBy("entry_key").agg(F.array_sort(F.collect_list(F.struct("start_offset", "end_offset", "entity_type", "match_kind"))).alias("highlights"))
    rows = rows.join(own, "entry_key", "left").join(marks, "entry_key", "left")
    none = F.array().cast("array<struct<start_offset:int,end_offset:int,entity_type:string,match_kind:string>>")
    item = F.struct(
        F.when(F.col("kind") == "post", 0).otherwise(1).alias("rank"), "floor", "cid", "kind", "posted_at", "content",
        F.coalesce("courses", F.array().cast("array<string>")).alias("courses"), F.coalesce("highlights", none).alias("highlights"),
    )
    listed = rows.groupBy("pid").agg(F.array_sort(F.collect_list(item)).alias("entries"))
    courses = thread_courses.join(threads.select("pid"), "pid", "left_semi").groupBy("pid").agg(F.array_sort(F.collect_list("course_name")).alias("courses"))
    out = threads.join(courses, "pid", "left").join(listed, "pid", "left")
    return out.withColumn("courses", F.coalesce("courses", F.array().cast("array<string>"))).withColumn("highlights", F.element_at(F.filter("entries", lambda e: e["kind"] == "post"), 1)["highlights"])


def list_reviews(threads: DataFrame, entries: DataFrame, thread_courses: DataFrame, entry_courses: DataFrame, highlights: DataFrame, q: str = "", page: Page | None = None) -> tuple[DataFrame, DataFrame]:
    """(total, the page's nested threads in order): best of the year first unless something is searched."""
    page = page or Page(1, 20, 100)
    found = search_threads(threads, entries, thread_courses, q)
    rows, by = (found, newest_first()) if review_query(q) else default_order(found)
    # at most page.size threads, used several times below: sorted once
    shown = table(rows.orderBy(*by).offset(page.offset).limit(page.size), "page")
    return found.agg(F.count("*").alias("total")), nested(shown, entries, thread_courses, entry_courses, highlights).orderBy(*by)


def thread_detail(threads: DataFrame, replies: DataFrame, pid: int) -> DataFrame:
    """One thread with all replies by ordinal and their number."""
    own = replies.where(F.col("pid") == pid).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("ordinal", "cid", "floor", "posted_at", "content"))).alias("replies"))
    out = threads.where(F.col("pid") == pid).join(own, "pid", "left")
    return out.withColumn("reply_count", F.coalesce(F.size("replies"), F.lit(0)).cast("long"))


def suggestions(catalog: DataFrame, query: str, n: int = 12) -> DataFrame:
    """The n most reviewed courses whose name holds the query, raw or normalised."""
    query = review_query(query)
    if query:
        where = t.any_contains(["course_name"], query)
        if name := t.normalise(query):
            where = where | t.any_contains(["search_name"], name)
        catalog = catalog.where(where)
    shown = catalog.orderBy(F.desc("thread_count"), F.desc("entry_count"), F.asc("course_name")).limit(n)
    return shown.select("course_name", t.split_list("course_codes").alias("course_codes"), "thread_count", "entry_count")


def course_catalog(mentions: DataFrame) -> DataFrame:
    """Threads and entries for each course, from (course_name, pid, entry_key)."""
    return mentions.groupBy("course_name").agg(F.count_distinct("pid").alias("thread_count"), F.count_distinct("entry_key").alias("entry_count"))


def date_range(entries: DataFrame, at: str = "posted_at") -> DataFrame:
    return entries.agg(t.beijing_day(F.min(at)).alias("start_date"), t.beijing_day(F.max(at)).alias("end_date"))


def metadata_map(metadata: DataFrame) -> DataFrame:
    """Key-value rows as one map (metadata is a bounded table of settings)."""
    return metadata.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def metadata_payload(metadata: DataFrame, dates: DataFrame) -> DataFrame:
    """One row for what is served, from (key, value) rows and date_range's row: keys in snake case,
    texts empty and counters 0 where missing; a counter that is no number fails."""
    keyed = metadata.select(t.snake_case("key").alias("key"), "value")
    value = lambda name: F.max(F.when(F.col("key") == name, F.col("value")))
    texts = [F.coalesce(value(x), F.lit("")).alias(x) for x in TEXTS]
    counts = [F.coalesce(value(x).cast("long"), F.lit(0)).alias(x) for x in COUNTERS]
    share = F.coalesce(value(COVERAGE).cast("double"), F.lit(0.0)).alias(COVERAGE)
    days = dates.select(*(F.coalesce(x, F.lit("")).alias(x) for x in ("start_date", "end_date")))
    return keyed.agg(*texts, *counts, share).crossJoin(days)  # one row each
