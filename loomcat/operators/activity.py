"""Visits and messages: daily upserts, statistics and a rate limiter over past messages."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.storage import ranked, table

#: Parts of user agents that are no visitors (fixed values).
BOTS = ("bot", "spider", "crawl", "slurp", "curl", "wget", "python-")
#: Seconds and the messages that one sender may post within them.
LIMITS = ((3600, 5), (86400, 20))
TREND_DAYS = 7


def is_bot(agent: str | Column) -> Column:
    """An empty user agent is one as well."""
    low = F.lower(F.coalesce(t.col(agent), F.lit("")))
    return (low == "") | low.rlike("|".join(BOTS))


def sender(ip: str | Column) -> Column:
    return F.sha2(F.coalesce(F.nullif(F.trim(t.col(ip)), F.lit("")), F.lit("unknown")), 256)


def visit_days(visits: DataFrame) -> DataFrame:
    """day, ip_hash, views, last_at of visits (at epoch seconds, ip_hash, agent); bots don't count."""
    people = visits.where(~is_bot("agent")) if "agent" in visits.columns else visits
    return people.groupBy(t.beijing_day("at").alias("day"), "ip_hash").agg(F.count("*").alias("views"), F.max("at").alias("last_at"))


def merge_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: views add up, last_at is the later one."""
    return old.unionByName(new).groupBy("day", "ip_hash").agg(F.sum("views").alias("views"), F.max("last_at").alias("last_at"))


def visit_stats(days: DataFrame, now: int) -> DataFrame:
    """One row: views and visitors today, in TREND_DAYS days and in all; later days count in both
    of the latter."""
    today, start = (F.date_format(F.timestamp_seconds(F.lit(now + 8 * 3600 - 86400 * k)), "yyyy-MM-dd") for k in (0, TREND_DAYS - 1))
    here, week = F.col("day") == today, F.col("day") >= start
    total = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).cast("long")
    return days.agg(
        total(here, "views").alias("today_views"), F.count_if(here).alias("today_visitors"),
        total(week, "views").alias("week_views"), F.count_distinct(F.when(week, F.col("ip_hash"))).alias("week_visitors"),
        total(F.lit(True), "views").alias("total_views"), F.count_distinct("ip_hash").alias("total_visitors"),
    )


def trend(days: DataFrame, now: int, n: int = TREND_DAYS) -> DataFrame:
    """Views of each of the last n days, 0 where there are none."""
    spark = days.sparkSession
    calendar = spark.range(n).select(F.date_format(F.timestamp_seconds(F.lit(now + 8 * 3600) - F.col("id") * 86400), "yyyy-MM-dd").alias("day"))
    return calendar.join(days.groupBy("day").agg(F.sum("views").alias("views")), "day", "left").select("day", F.coalesce("views", F.lit(0)).cast("long").alias("views"))


def admit(times: list[int], limits: tuple[tuple[int, int], ...], past: deque[int] | None = None) -> tuple[list[bool], deque[int]]:
    """Which of one sender's attempts, in order of time, are accepted. Only accepted ones count."""
    past = past if past is not None else deque()
    longest, out = max(w for w, _ in limits), []
    for now in times:
        while past and past[0] <= now - longest:
            past.popleft()
        ok = all(sum(x > now - w for x in past) < n for w, n in limits)
        if ok:
            past.append(now)
        out.append(ok)
    return out, past


def pieces(attempts: DataFrame, longest: int) -> DataFrame:
    """attempts (sender, at, ...) with piece: a sender's attempts are cut where nothing happens for
    the longest window, since nothing before such a gap counts behind it. A gap always lies between
    spans of that many seconds, so the first and last attempt of each span tell, a row a span."""
    span = F.floor(F.col("at") / longest).alias("_span")
    ends = attempts.groupBy("sender", span).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    by = Window.partitionBy("sender").orderBy("_span")
    cut = ends.withColumn("_cut", F.coalesce(F.col("first") - F.lag("last").over(by) >= longest, F.lit(True)).cast("int"))
    cut = table(cut.select(F.col("sender").alias("_sender"), F.col("_span").alias("_of"), F.sum("_cut").over(by).alias("piece")), "pieces")
    rows = attempts.withColumn("_span", span)
    return rows.join(cut, F.col("sender").eqNullSafe(F.col("_sender")) & (F.col("_span") == F.col("_of"))).drop("_sender", "_span", "_of")


def accepted(attempts: DataFrame, limits: tuple[tuple[int, int], ...] = LIMITS) -> DataFrame:
    """attempts (sender, at, id) with ok.

    A sender's attempts depend on those before, but on few of them: in one second no more than the
    smallest limit are accepted, those with the least ids, so the others are refused without being
    looked at; and a gap of the longest window cuts a sender into pieces that are decided apart. What
    is left streams through the tasks sorted by sender, piece and time; only accepted attempts come
    out, and are joined back by sender, time and id. However many attempts a sender makes, a task
    gets a bounded number of them for each second.

    Rows that are equal in sender, time and id are one attempt and are decided alike; rows without a
    time or id are not decided (ok is null); a null sender is a sender like others.
    """
    rows = attempts.select("sender", "at", "id")
    kind, most, longest = dict(rows.dtypes)["sender"], min(n for _, n in limits), max(w for w, _ in limits)

    def run(frames):
        who, past, started = None, deque(), False
        for pdf in frames:
            ok = []
            for s, piece, at in zip(pdf["sender"], pdf["piece"], pdf["at"], strict=True):
                key = None if s is None or s != s else s, piece  # noqa: PLR0124  NaN is null
                if not started or key != who:
                    who, past, started = key, deque(), True
                one, past = admit([at], limits, past)
                ok += one
            yield pdf.loc[ok, ["sender", "at", "id"]]

    known = rows.where("at IS NOT NULL AND id IS NOT NULL")
    place = F.dense_rank().over(Window.partitionBy("sender", "at").orderBy("id"))
    first = table(known.withColumn("_place", place).where(F.col("_place") <= most).select("sender", "at", "id").distinct(), "first-attempts")
    cut = pieces(first, longest).select("sender", "at", "id", "piece")
    fine = cut.repartition("sender", "piece").sortWithinPartitions("sender", "piece", "at", "id").mapInPandas(run, f"sender {kind}, at long, id long")
    fine = table(fine, "accepted").select(F.col("sender").alias("_sender"), F.col("at").alias("_at"), F.col("id").alias("_id"))
    met = rows.join(fine, F.col("sender").eqNullSafe(F.col("_sender")) & (F.col("at") == F.col("_at")) & (F.col("id") == F.col("_id")), "left")
    return met.select("sender", "at", "id", F.when(F.col("at").isNotNull() & F.col("id").isNotNull(), F.col("_id").isNotNull()).alias("ok"))


def post_messages(messages: DataFrame, attempts: DataFrame, limits: tuple[tuple[int, int], ...] = LIMITS) -> DataFrame:
    """The messages (id, posted_at, content, ip_hash) that come to those that are there: of attempts
    (attempt, posted_at, content, ip_hash) those within the limits, numbered on in order of time. What
    is there counts towards the limits; refused attempts don't, nor those without a number, which go."""
    attempts = attempts.where("attempt IS NOT NULL")
    old = messages.select(F.col("ip_hash").alias("sender"), F.col("posted_at").alias("at"), (F.col("id") - (1 << 62)).alias("id"))
    new = attempts.select(F.col("ip_hash").alias("sender"), F.col("posted_at").alias("at"), F.col("attempt").alias("id"))
    fine = accepted(old.unionByName(new), limits).where("ok AND id > -1").select(F.col("id").alias("attempt"))
    last = messages.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    kept = ranked(attempts.join(fine, "attempt", "left_semi"), [F.asc("posted_at"), F.asc("attempt")], "posted_at", "content", "ip_hash")
    return kept.select((F.col("rank") + last).cast("long").alias("id"), "posted_at", "content", "ip_hash")


def message_page(messages: DataFrame, offset: int, size: int) -> DataFrame:
    """Newest first, without the sender."""
    return messages.select("id", "posted_at", "content").orderBy(F.desc("id")).offset(offset).limit(size)


def in_window(rows: DataFrame, at: str, now: int, seconds: int) -> DataFrame:
    """Rows after now - seconds: the bound itself is outside."""
    return rows.where(F.col(at) > now - seconds)


