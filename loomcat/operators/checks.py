"""Data quality: constraints of tables and of scraped payloads, as grouped counts and anti joins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that make a listing unique, by kind of source.
UNIQUE = {
    "summer": ("course_type", "course_code", "class_no"),
    "undergraduate_fall": ("course_type", "course_code", "class_no", "teacher"),
    "graduate": ("course_code", "class_no", "teacher", "department"),
}


#: Lists of an envelope's validation that must be empty.
EMPTY_LISTS = ("duplicateKeys", "missingCourseCodes", "missingDetailLinks", "suspiciousPages")


class CheckFailed(ValueError):
    pass


def count_profile(rows: DataFrame, key: str) -> DataFrame:
    """n, distinct and whether every row has a key of its own."""
    return rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct_keys")).withColumn("is_unique", F.col("n") == F.col("distinct_keys"))


def missing_keys(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(F.col(a_key).alias("key")).distinct().join(b.select(F.col(b_key).alias("key")), "key", "left_anti")


def key_difference(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """Keys that only one side has: equal sets give no row."""
    return missing_keys(a, a_key, b, b_key).select("key", F.lit("left").alias("side")).unionByName(missing_keys(b, b_key, a, a_key).select("key", F.lit("right").alias("side")))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def profile_duplicates(rows: DataFrame, profile: str) -> DataFrame:
    """Keys of a kind of source (see UNIQUE) that several rows share."""
    return duplicate_keys(rows, list(UNIQUE[profile]))


def envelope_faults(envelopes: DataFrame, rows: DataFrame, term: str, kinds: list[str], profile: str) -> DataFrame:
    """fault and detail of what is wrong with the envelope of one term's payload: rows are its rows as
    columns (seq, course_type, course_code, link and what the profile's key needs). Its statements are
    compared with what the rows say."""
    e = envelopes.select("*", F.map_keys("stats").alias("_kinds"))
    say = lambda found, fault, detail: found.select(F.lit(fault).alias("fault"), detail.cast("string").alias("detail"))
    again = rows.groupBy("seq").count().where("count > 1").select("seq", F.lit(True).alias("_real"))
    listed = e.select(F.explode("validation.duplicateSeqs").alias("seq")).distinct().withColumn("_said", F.lit(True))
    seqs = again.join(listed, "seq", "full").where("_real IS NULL OR _said IS NULL")
    counted = rows.groupBy(F.col("course_type").alias("kind")).agg(F.count("*").alias("n"))  # a row for each kind
    stated = e.select(F.explode("stats").alias("kind", "stated"))
    differ = counted.join(stated, "kind", "full").where(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("stated", F.lit(0))))
    parts = [
        say(e.where(~F.col("term").eqNullSafe(F.lit(term))), "term", F.col("term")),
        say(e.where(~F.coalesce(F.size("errors") == 0, F.lit(False))), "errors", F.size("errors")),
        say(e.where(~F.array_sort("_kinds").eqNullSafe(F.array(*map(F.lit, sorted(kinds))))), "kinds", F.concat_ws(",", F.array_sort("_kinds"))),
        say(differ, "stats", F.col("kind")),
        say(e.join(F.broadcast(rows.agg(F.count("*").alias("_n")))).where(~F.col("validation.totalRows").eqNullSafe(F.col("_n"))), "total", F.col("validation.totalRows")),
        say(seqs, "duplicateSeqs", F.col("seq")),
        say(profile_duplicates(rows, profile), "duplicate key", F.concat_ws("|", *UNIQUE[profile])),
        say(rows.where(F.trim(F.coalesce("course_code", F.lit(""))) == ""), "no code", F.col("seq")),
        say(rows.where(F.trim(F.coalesce("link", F.lit(""))) == ""), "no link", F.col("seq")),
        *(say(e.where(~F.coalesce(F.size(f"validation.{x}") == 0, F.lit(False))), "stated", F.lit(x)) for x in EMPTY_LISTS),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def store_faults(spark: SparkSession, root: str, tables: dict[str, str]) -> list[str]:
    """Tables (name: schema in DDL) below root that are missing, can't be read or have other columns."""
    out = []
    for name, ddl in tables.items():
        try:
            have = {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{root}/{name}").schema}
        except AnalysisException as e:
            out.append(f"{name}: {'missing' if 'PATH_NOT_FOUND' in str(e) else 'cannot be read'}")
            continue
        want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ddl)}
        if have != want:
            out.append(f"{name}: columns {', '.join(sorted(x for x in {*have, *want} if have.get(x) != want.get(x)))}")
    return out


def collapse(rows: DataFrame, keys: list[str], values: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows without exact copies, keys whose rows differ with the number of variants). A cheap hash of
    every row finds the keys that may differ; only their rows are compared and counted. A key with a
    NULL in it never conflicts."""
    values = values or [x for x in rows.columns if x not in keys]
    hashed = rows.withColumn("_h", F.xxhash64(*values, *(F.col(x).isNull() for x in values)))
    suspects = hashed.groupBy(*keys).agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).where("lo < hi").select(*keys)
    exact = rows.select(*keys, F.struct(*values).alias("_v")).join(suspects, keys, "left_semi")
    conflicts = exact.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("_v").alias("variants"))
    return rows.select(*keys, *values).distinct(), conflicts


def bad_spans(highlights: DataFrame, entries: DataFrame) -> DataFrame:
    """Highlights that overlap the one before, are empty, or leave their entry's text (code points)."""
    before = F.lag("end_offset", 1, 0).over(Window.partitionBy("entry_key").orderBy("start_offset", "end_offset"))
    rows = highlights.withColumn("before", before).join(entries.select("entry_key", F.length("content").alias("size")), "entry_key")
    return rows.where((F.col("start_offset") < F.col("before")) | (F.col("start_offset") < 0) | (F.col("end_offset") <= F.col("start_offset")) | (F.col("end_offset") > F.col("size"))).drop("before", "size")


def catalog_health(basic: DataFrame, details: DataFrame, translations: DataFrame) -> DataFrame:
    """One row of counts; healthy if details and listings pair off and no translation is an orphan."""
    b = count_profile(basic, "id").select(F.col("n").alias("basic"), F.col("is_unique").alias("basic_unique"))
    d = count_profile(details, "course_id").select(F.col("n").alias("detail"), F.col("is_unique").alias("detail_unique"))
    diff = key_difference(basic, "id", details, "course_id").agg(F.count("*").alias("unpaired"))
    orphan = missing_keys(translations, "course_id", basic, "id").agg(F.count("*").alias("orphans"))
    out = b.crossJoin(d).crossJoin(diff).crossJoin(orphan)  # four tables of one row
    return out.withColumn("healthy", (F.col("basic") == F.col("detail")) & F.col("basic_unique") & F.col("detail_unique") & (F.col("unpaired") == 0) & (F.col("orphans") == 0))


def review_counts(threads: DataFrame, entries: DataFrame, replies: DataFrame, highlights: DataFrame, aliases: DataFrame) -> DataFrame:
    """Counters recomputed from the tables, as key and value."""
    counted = [
        threads.agg(F.count("*").alias("value")).select(F.lit("matched_threads").alias("key"), "value"),
        entries.agg(F.count("*").alias("value")).select(F.lit("matched_entries").alias("key"), "value"),
        entries.where("kind = 'post'").agg(F.count("*").alias("value")).select(F.lit("posts").alias("key"), "value"),
        replies.agg(F.count("*").alias("value")).select(F.lit("snapshot_replies").alias("key"), "value"),
        highlights.groupBy("entity_type").agg(F.count("*").alias("value")).select(F.concat("entity_type", F.lit("_highlights")).alias("key"), "value"),
        highlights.where("match_kind = 'alias'").groupBy("entity_type").agg(F.count("*").alias("value")).select(F.concat("entity_type", F.lit("_alias_highlights")).alias("key"), "value"),
        aliases.groupBy("entity_type").agg(F.count_distinct("normalized_alias").alias("value")).select(F.concat("entity_type", F.lit("_aliases")).alias("key"), "value"),
    ]
    out = counted[0]
    for x in counted[1:]:
        out = out.unionByName(x)
    return out


#: Counters that a review store's metadata must state as they are.
STATED = ("matched_threads", "matched_entries", "snapshot_replies", "course_aliases", "teacher_aliases")
_SPANS = "invalid highlight spans"


def review_health_checks(threads: DataFrame, entries: DataFrame, replies: DataFrame, highlights: DataFrame, aliases: DataFrame, metadata: DataFrame) -> DataFrame:
    """check, expected, found and fine, a row for each thing that must hold of a review store."""
    marks = [f"{x}{y}" for x in ("course", "teacher") for y in ("_highlights", "_alias_highlights")]
    pick = lambda rows, names, to: rows.agg(*(F.max(F.when(F.col("key") == x, F.col("value"))).alias(f"{to}_{x}") for x in names))
    now = pick(review_counts(threads, entries, replies, highlights, aliases), [*STATED, *marks, "posts"], "now")
    said = pick(metadata.select("key", F.col("value").cast("string").alias("value")), [*STATED, *marks, "highlight_version"], "said")
    one = now.crossJoin(said).crossJoin(bad_spans(highlights, entries).agg(F.count("*").alias("bad")))  # three tables of one row
    found, state = (lambda x: F.coalesce(f"now_{x}", F.lit(0))), (lambda x: F.col(f"said_{x}"))
    number = lambda x: F.coalesce(state(x).try_cast("long"), F.lit(-1))
    both = lambda of: of("course_highlights") + of("teacher_highlights")
    checks = [(x, state(x), found(x), state(x).eqNullSafe(found(x).cast("string"))) for x in STATED]
    checks += [("highlights", both(number), both(found), both(number) == both(found))]
    checks += [(f"{x}_alias_highlights", state(f"{x}_highlights"), state(f"{x}_alias_highlights"), number(f"{x}_alias_highlights") <= number(f"{x}_highlights")) for x in ("course", "teacher")]
    checks += [("highlight_version", F.lit("3"), state("highlight_version"), state("highlight_version").eqNullSafe(F.lit("3")))]
    checks += [("posts", found("matched_threads"), found("posts"), found("posts") == found("matched_threads")), ("entries", found("matched_threads"), found("matched_entries"), found("matched_entries") >= found("matched_threads"))]
    checks += [(_SPANS, F.lit(0), F.col("bad"), F.col("bad") == 0)]
    rows = [F.struct(F.lit(c).alias("check"), e.cast("string").alias("expected"), f.cast("string").alias("found"), fine.alias("fine")) for c, e, f, fine in checks]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def review_health(threads: DataFrame, entries: DataFrame, replies: DataFrame, highlights: DataFrame, aliases: DataFrame, metadata: DataFrame) -> list[str]:
    """What is wrong with a review store; nothing for a healthy one."""
    rows = review_health_checks(threads, entries, replies, highlights, aliases, metadata).where("NOT fine").collect()
    return [_SPANS if r["check"] == _SPANS else f"{r['check']}: expected {r['expected']}, found {r['found']}" for r in rows]


def payload_faults(rows: DataFrame, seq: str, link: str, code: str, kind: str, keys: list[str]) -> DataFrame:
    """fault and key of everything that a scraped payload's own validation should have listed."""
    parts = [
        rows.groupBy(seq).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_seq").alias("fault"), F.col(seq).cast("string").alias("key")),
        duplicate_keys(rows, keys).select(F.lit("duplicate_key").alias("fault"), F.concat_ws("|", *keys).alias("key")),
        rows.where(F.trim(F.coalesce(F.col(code).cast("string"), F.lit(""))) == "").select(F.lit("missing_code").alias("fault"), F.col(seq).cast("string").alias("key")),
        rows.where(F.trim(F.coalesce(F.col(link), F.lit(""))) == "").select(F.lit("missing_link").alias("fault"), F.col(seq).cast("string").alias("key")),
        rows.where(F.trim(F.coalesce(F.col(kind), F.lit(""))) == "").select(F.lit("missing_kind").alias("fault"), F.col(seq).cast("string").alias("key")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def stats_mismatch(rows: DataFrame, kind: str, stated: DataFrame) -> DataFrame:
    """Kinds whose stated number (kind, n) differs from the counted one; either may be missing."""
    real = rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("counted"))
    return real.join(stated.select("kind", F.col("n").alias("stated")), "kind", "full").where(~F.col("counted").eqNullSafe(F.col("stated")))


def short_pages(pages: DataFrame, kind: str, page: str, n: str) -> DataFrame:
    """Pages with fewer rows than the fullest of their kind that are not the last."""
    most = pages.groupBy(F.col(kind).alias("_kind")).agg(F.max(n).alias("_most"), F.max(page).alias("_last"))
    marked = pages.join(most, pages[kind].eqNullSafe(most["_kind"]))
    return marked.where((F.col(n) < F.col("_most")) & (F.col(page) < F.col("_last"))).drop("_kind", "_most", "_last")


def link_fault(url: Column, host: str, path: str, seq: Column | None = None, param: str = "course_seq_no") -> Column:
    """Why a link breaks the contract (https, this host, this path, its row's number, no user, no
    trailing &), else NULL."""
    out = F.when(url.isNull() | (F.trim(url) == ""), "missing")
    out = out.when(F.regexp_extract(url, r"^([A-Za-z]+)://", 1) != "https", "scheme")
    out = out.when(F.regexp_extract(url, r"^https://([^/?#]*)", 1).contains("@"), "user")
    out = out.when(F.regexp_extract(url, r"^https://([^/?#]*)", 1) != host, "host")
    out = out.when(F.regexp_extract(url, r"^https://[^/?#]*([^?#]*)", 1) != path, "path")
    out = out.when(url.endswith("&"), "trailing")
    if seq is not None:
        out = out.when(F.regexp_extract(url, rf"[?&]{param}=([^&#]*)", 1) != seq, "number")
    return out


def builder_faults(rows: DataFrame) -> DataFrame:
    """row_index and fault of listings that can't be built."""
    bad = F.when(~F.coalesce(F.trim("course_code") != "", F.lit(False)), "blank code").when(F.trim(F.coalesce("credits", F.lit(""))).try_cast("double").isNull(), "credits are no number").when(~F.coalesce(F.trim("course_type") != "", F.lit(False)), "blank type")
    return rows.withColumn("fault", bad).where("fault IS NOT NULL").select("row_index", "fault")


def require_none(faults: DataFrame, what: str, show: int = 5) -> None:
    """Raise if there are faults, with a few of them."""
    if rows := faults.limit(show).collect():
        raise CheckFailed(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))
