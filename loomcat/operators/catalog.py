"""Catalog search: listings of several levels, merged into cards.

A source row is one listing. Listings of one group (level, code, class, teacher) make a card: the
most complete one represents it, another one may fill its blanks as a whole, and all types and
categories of the group become badges. A search picks groups by their listings and then shows whole
cards, so a filter never changes a card.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.params import Page, Search

#: Columns of a source row besides id, level, local_id and completeness (fixed values, as are the lists
#: of columns below).
BASIC = ("course_type", "course_code", "class_no", "course_name", "category", "credits", "teacher", "department", "major", "grade", "schedule", "classroom", "weekdays", "first_period", "enrollment", "pnp", "notes")
DETAIL = {
    "undergraduate": ("english_name", "prerequisites", "intro_cn", "intro_en", "grading", "ge_series", "language", "textbook", "reference_book", "syllabus", "evaluation"),
    "graduate_spring": ("english_name", "weekly_hours", "total_hours", "term", "audience", "reference_book", "intro", "extra_notes"),
    "graduate_fall": ("english_name", "weekly_hours", "total_hours", "term", "audience", "reference_book", "intro", "extra_notes", "syllabus"),
}
LEVELS = {"u": "undergraduate", "s": "undergraduate", "a": "undergraduate", "g": "graduate_spring", "r": "graduate_fall"}
GRADUATE_TYPE = "研究生课"
#: Shown columns that count towards completeness; a graduate listing has no pnp.
SHOWN = ("course_name", "credits", "department", "major", "grade", "schedule", "classroom", "enrollment", "pnp", "notes")
SEARCHED = ("course_name", "display_course_name", "english_name", "teacher", "classroom", "display_classroom", "course_code")
#: Fields that a translation may replace in the detail view, and those whose key is always there.
TRANSLATED = ("course_name", "notes", "pnp", "classroom", "major", "prerequisites", "ge_series", "audience", "term", "syllabus", "evaluation", "intro_cn", "extra_notes", "textbook", "reference_book")
ALWAYS = ("english_name", "prerequisites", "intro_cn", "intro_en", "grading", "ge_series", "language", "textbook", "reference_book", "syllabus", "evaluation", "weekly_hours", "total_hours", "term", "audience", "extra_notes")
#: Added to the number of a listing of a level in the seeded order (fixed values).
LEVEL_OFFSETS = {"g": 333331, "s": 666661, "a": 111113, "r": 444449}
PRIME = 999983


@dataclass(frozen=True)
class Card:
    """Which columns make a card."""

    badges: tuple[str, ...] = ("course_type", "category")
    #: source column: card column, filled if blank; and values, filled if NULL
    texts: dict[str, str] = field(default_factory=lambda: {"display_course_name": "course_name", "course_name": "original_course_name", "department": "department", "major": "major", "grade": "grade", "schedule": "schedule", "display_classroom": "classroom", "weekdays": "weekdays", "enrollment": "enrollment", "pnp": "pnp", "display_notes": "notes", "english_name": "english_name", "grading": "grading", "language": "language", "audience": "audience"})
    values: tuple[str, ...] = ("credits", "first_period")
    #: what a fallback is ranked by: fewer columns than it fills
    counted_texts: tuple[str, ...] = ("display_course_name", "department", "major", "grade", "schedule", "display_classroom", "enrollment", "pnp", "display_notes", "english_name", "language", "audience")
    counted_values: tuple[str, ...] = ("credits",)
    #: taken from the representative as they are
    plain: tuple[str, ...] = ("course_code", "class_no", "teacher")


COURSE = Card()


def completeness(columns: list[str]) -> Column:
    """How many of the columns are neither NULL nor blank."""
    return sum((F.when(t.filled(x), 1).otherwise(0) for x in columns), F.lit(0)).cast("long")


def group_key(level: str, code: str, class_no: str, teacher: str, row_id: str) -> Column:
    """NULL if code or class is; a blank teacher groups with nobody."""
    blank = F.trim(F.coalesce(teacher, F.lit("")), F.lit(t.KEY_SPACE)) == ""
    return F.concat(F.col(level), F.lit(t.UNIT), F.col(code), F.lit(t.UNIT), F.col(class_no), F.lit(t.UNIT), F.when(blank, F.col(row_id)).otherwise(F.col(teacher)))


def listings(basic: DataFrame, detail: DataFrame, level: str) -> DataFrame:
    """Source rows of one level: basic with its detail, if any."""
    shape = LEVELS[level]
    names = DETAIL[shape]
    d = detail.select("course_id", *(F.col(x).alias(f"_{x}") for x in names))
    rows = basic.join(d, basic.id == d.course_id, "left")
    shown = [x for x in SHOWN if x != "pnp" or shape == "undergraduate"]
    constant = {} if shape == "undergraduate" else {"course_type": F.lit(GRADUATE_TYPE), "pnp": F.lit("")}
    extra = {"english_name": F.col("_english_name")}
    for x in ("grading", "language"):
        extra[x] = F.col(f"_{x}") if shape == "undergraduate" else F.lit("")
    extra["audience"] = F.lit("") if shape == "undergraduate" else F.col("_audience")
    return rows.select(
        F.concat(F.lit(level), F.col("id").cast("string")).alias("id"),
        *(constant.get(x, F.col(x) if x in basic.columns else F.lit(None)).alias(x) for x in BASIC),
        *(v.alias(k) for k, v in extra.items()),
        F.lit(level).alias("level"),
        F.col("id").cast("long").alias("local_id"),
        completeness([*shown, *(f"_{x}" for x in names)]).alias("completeness"),
    )


def union_levels(*levels: DataFrame) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def wide_translations(translations: DataFrame, lang: str, fields: tuple[str, ...]) -> DataFrame:
    """course_id with one column for each field, from (course_id, field, lang, text)."""
    rows = translations.where(F.col("lang") == lang).where(F.col("field").isin(*fields))
    return rows.groupBy("course_id").pivot("field", list(fields)).agg(F.first("text"))


def with_display(source: DataFrame, translations: DataFrame | None, lang: str, fields: tuple[str, ...] = ("course_name", "classroom", "notes")) -> DataFrame:
    """Display columns: the trimmed translation if it has one, else the source. `zh` is the source's
    own language and joins nothing."""
    if lang == "zh" or translations is None:
        return source.withColumns({f"display_{x}": F.col(x) for x in fields})
    wide = wide_translations(translations, lang, fields).select(F.col("course_id").alias("local_id"), *(F.col(x).alias(f"_tr_{x}") for x in fields))
    shown = {f"display_{x}": F.coalesce(F.nullif(F.trim(f"_tr_{x}"), F.lit("")), F.col(x)) for x in fields}
    return source.join(wide, "local_id", "left").withColumns(shown).drop(*(f"_tr_{x}" for x in fields))


def matches(s: Search) -> Column:
    """The predicate on source rows."""
    out = F.lit(True)
    if s.q:
        out = out & t.any_contains(list(SEARCHED), s.q)
    if s.classroom:
        out = out & t.any_contains(["classroom", "display_classroom"], s.classroom)
    for name, column in (("type", "course_type"), ("category", "category"), ("department", "department"), ("grading", "grading")):
        if value := getattr(s, name):
            out = out & (F.col(column) == value)
    if s.credit_value is not None:
        out = out & (F.col("credits").cast("double") == s.credit_value)
    if s.weekday:
        out = out & F.col("weekdays").contains(s.weekday)
    return out


def matching_groups(source: DataFrame, where: Column) -> DataFrame:
    return source.where(where).select("group_key").distinct()


def count_cards(source: DataFrame, where: Column) -> DataFrame:
    """Number of groups with a matching row: no ranking, no badges."""
    return matching_groups(source, where).agg(F.count("*").alias("total"))


def badges(source: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """group_key with the distinct filled values of each column, sorted by bytes and joined."""
    joined = [F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(t.filled(x), F.col(x)))), ","), F.lit("")).alias(x) for x in names]
    return source.groupBy("group_key").agg(*joined)


def cards(source: DataFrame, where: Column, card: Card = COURSE) -> DataFrame:
    """One row for each group with a matching source row.

    The representative is a grouped minimum that is joined back, and the fallback another one: all
    over one partitioning by group_key, with partial aggregates and a join that a hot group can't
    overload.
    """
    rows = source.join(matching_groups(source, where), "group_key", "left_semi")
    used = list(dict.fromkeys(["id", "local_id", "completeness", *card.texts, *card.values, *card.plain]))
    best = F.struct(-F.col("completeness"), F.col("local_id"), F.col("id"))
    ranked = rows.join(rows.groupBy("group_key").agg(F.min_by(F.struct(*used), best).alias("rep")), "group_key")
    gains = [F.when(~t.filled(f"rep.{x}") & t.filled(x), 1).otherwise(0) for x in card.counted_texts]
    gains += [F.when(F.col(f"rep.{x}").isNull() & F.col(x).isNotNull(), 1).otherwise(0) for x in card.counted_values]
    ranked = ranked.withColumn("fill", F.when(F.col("id") != F.col("rep.id"), sum(gains, F.lit(0))).otherwise(0))
    order = F.struct(-F.col("fill"), -F.col("completeness"), F.col("local_id"), F.col("id"))
    listed = [F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(t.filled(x), F.col(x)))), ","), F.lit("")).alias(f"_{x}") for x in card.badges]
    merged = ranked.groupBy("group_key").agg(
        F.first("rep").alias("rep"), F.min_by(F.when(F.col("fill") > 0, F.struct(*used)), F.when(F.col("fill") > 0, order)).alias("other"), *listed
    )
    return merged.select(
        "group_key",
        F.col("rep.id").alias("id"),
        F.col("other.id").alias("fallback_id"),
        *(F.col(f"_{x}").alias(x) for x in card.badges),
        *(F.col(f"rep.{x}").alias(x) for x in card.plain),
        *(F.when(t.filled(f"rep.{x}"), F.col(f"rep.{x}")).otherwise(F.col(f"other.{x}")).alias(y) for x, y in card.texts.items()),
        *(F.coalesce(f"rep.{x}", f"other.{x}").alias(x) for x in card.values),
    )


def name_order(descending: bool = False, name: str = "course_name") -> list[Column]:
    """Blank names last either way, A-Z taken as a-z, then id."""
    blank = F.when(F.col(name).isNull() | (F.col(name) == ""), 1).otherwise(0)
    folded = t.fold(name)
    return [blank.asc(), folded.desc_nulls_last() if descending else folded.asc_nulls_first(), F.col("id").asc()]


def seeded(seed: int, row_id: str = "id", offsets: dict[str, int] = LEVEL_OFFSETS) -> Column:
    """A number below PRIME for each id: the same seed gives the same order on every page."""
    mul, add = (seed * 1664525) % PRIME or 7, (seed * 1013904223) % PRIME
    extra = F.lit(0)
    for level, n in offsets.items():
        extra = F.when(F.substring(row_id, 1, 1) == level, n).otherwise(extra)
    return (F.expr(f"cast(substr({row_id}, 2) as bigint)") * mul + extra + add) % PRIME


def order(s: Search, boost: Column | None = None) -> list[Column]:
    """Sort columns; boost marks rows that go first in the default order."""
    last = lambda x: F.when(F.col(x).isNull(), 1).otherwise(0).asc()
    if s.sort == "random":
        return [seeded(s.random_seed).asc(), F.col("id").asc()]
    if s.sort in ("name_desc", "pinyin_desc"):
        return name_order(True)
    if s.sort == "credits_asc":
        return [last("credits"), F.asc("credits"), *name_order()]
    if s.sort == "credits_desc":
        return [last("credits"), F.desc("credits"), *name_order()]
    if s.sort == "time_asc":
        return [last("first_period"), F.asc("first_period"), *name_order()]
    return [F.when(boost, 0).otherwise(1).asc(), *name_order()] if s.sort == "" and boost is not None else name_order()


def page(rows: DataFrame, by: list[Column], p: Page) -> DataFrame:
    return rows.orderBy(*by).offset(p.offset).limit(p.size)


def summer_boost() -> Column:
    """The summer term's default order puts sociology first."""
    return F.coalesce(F.col("department").isin("社会学系", "中国社会科学调查中心"), F.lit(False)) | F.coalesce(F.col("original_course_name").contains("社会学"), F.lit(False))


def search(source: DataFrame, s: Search, card: Card = COURSE) -> tuple[DataFrame, DataFrame]:
    """(total, the page's cards in order, badges as arrays)."""
    where = matches(s)
    boost = summer_boost() if s.term == "summer" else None
    shown = page(cards(source, where, card), order(s, boost), s.page)
    return count_cards(source, where), shown.withColumns({x: F.coalesce(t.split_list(x), F.array().cast("array<string>")) for x in card.badges})


def with_group_key(source: DataFrame) -> DataFrame:
    return source.withColumn("group_key", group_key("level", "course_code", "class_no", "teacher", "id"))


def facets(source: DataFrame, texts: list[str], values: list[str], extra: dict[str, list[str]] | None = None) -> DataFrame:
    """facet, value (as text): distinct filled texts, distinct values with NULL, and fixed extra ones;
    one scan for all of them."""
    each = [F.struct(F.lit(x).alias("facet"), F.col(x).alias("value"), (F.col(x) != "").alias("keep")) for x in texts]
    each += [F.struct(F.lit(x).alias("facet"), F.col(x).cast("string").alias("value"), F.lit(True).alias("keep")) for x in values]
    rows = source.select(F.explode(F.array(*each)).alias("f")).where("f.keep").select("f.facet", "f.value")
    more = [(x, v) for x, vs in (extra or {}).items() for v in vs]
    if more:
        rows = union_levels(rows, source.sparkSession.createDataFrame(more, "facet string, value string"))
    return rows.distinct()


def detail(basic: DataFrame, details: DataFrame, level: str, local_id: int, translations: DataFrame | None = None, lang: str = "zh") -> DataFrame:
    """The one listing with its details. A translation that is not blank replaces a field as it
    stands, untrimmed. Columns that the level lacks are '', NULLs stay NULL."""
    shape = LEVELS[level]
    names = [*DETAIL[shape]]
    b = basic.where(F.col("id") == local_id)
    rows = b.join(details.where(F.col("course_id") == local_id).select("course_id", *(F.col(x).alias(f"_{x}") for x in names)), b.id == F.col("course_id"), "left")
    out = {x: F.col(x) if x in basic.columns else F.lit("") for x in BASIC if x not in ("weekdays", "first_period")}
    out |= {x: F.col(f"_{x}") for x in names}
    if shape != "undergraduate":
        out |= {"course_type": F.lit(GRADUATE_TYPE), "pnp": F.lit(""), "textbook": F.lit(""), "intro_cn": F.col("_intro")}
        out.pop("intro")
    out = {"id": F.concat(F.lit(level), F.col("id").cast("string")), **out} | {x: F.lit("") for x in ALWAYS if x not in out}
    shown = rows.select(*(v.alias(k) for k, v in out.items()), F.lit(local_id).cast("long").alias("_local"))
    if lang != "zh" and translations is not None:
        shown = overlay(shown, translations.where(F.col("course_id") == local_id), lang, "_local")
    return shown.drop("_local")


def overlay(rows: DataFrame, translations: DataFrame, lang: str, key: str, fields: tuple[str, ...] = TRANSLATED) -> DataFrame:
    """rows with each field replaced by its translation where that is not blank (by Unicode white space)."""
    fields = tuple(x for x in fields if x in rows.columns)
    wide = wide_translations(translations, lang, fields).select(F.col("course_id").alias(key), *(F.col(x).alias(f"_tr_{x}") for x in fields))
    new = {x: F.coalesce(F.when(t.stripped(f"_tr_{x}") != "", F.col(f"_tr_{x}")), F.col(x)) for x in fields}
    return rows.join(wide, key, "left").withColumns(new).drop(*(f"_tr_{x}" for x in fields))
