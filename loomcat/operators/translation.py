"""What is still to be translated, and what needs no translator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def field_matrix(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """id, field, text: wide source columns as rows, by source column: stored field."""
    pairs = F.array(*(F.struct(F.lit(stored).alias("field"), F.col(source).cast("string").alias("text")) for source, stored in fields.items()))
    return rows.select(F.col(key).cast("long").alias("id"), F.explode(pairs).alias("f")).select("id", "f.field", "f.text")


def gaps(texts: DataFrame, translations: DataFrame, langs: list[str]) -> DataFrame:
    """id, field, text and the sorted missing langs (joined) of each filled text."""
    wanted = texts.where(t.filled("text")).withColumn("lang", F.explode(F.array(*map(F.lit, langs))))
    have = translations.where(t.filled("text")).select(F.col("course_id").alias("id"), "field", "lang")
    left = wanted.join(have, ["id", "field", "lang"], "left_anti")
    return left.groupBy("id", "field", "text").agg(F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("missing"))


def reuse_english(rows: DataFrame, translations: DataFrame, limit: int = 0) -> DataFrame:
    """Trimmed English names, by id, as course_name translations where none is there; limit 0 is none."""
    have = translations.where("field = 'course_name' AND lang = 'en'").select(F.col("course_id").alias("id"))
    new = rows.where(t.filled("english_name")).join(have, "id", "left_anti").select(F.col("id").alias("course_id"), F.lit("course_name").alias("field"), F.lit("en").alias("lang"), F.trim("english_name").alias("text"))
    return new.orderBy("course_id").limit(limit) if limit else new


def cleaned(text: str):
    """Text without white space around, NULL if nothing is left."""
    return F.nullif(t.stripped(text), F.lit(""))
