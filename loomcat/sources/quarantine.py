"""JSON rows of which some are damaged: good ones go on, each bad one is kept with what is wrong.

A strict read fails as a whole for one bad row. Here every row is parsed as a variant, and fields are
taken out by path and kind. A row with any fault goes to the other side, a fault a row: (file, row,
path, reason, value). Both sides together have every row of the input.

Reasons: `empty` (null or blank), `no JSON` (also trailing text, and constants such as NaN, which
JSON doesn't have), `no object`, `missing` (a required field that is not there or null), `kind` (a
field whose value can't be taken as its kind).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import table


@dataclass(frozen=True)
class Field:
    """A value at a path (`$.a.b`, `$.a[0]`) that is taken as a kind (of SQL)."""

    name: str
    path: str
    kind: str
    required: bool = True


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, row (from 0, within its file) and value of text files, whatever blocks they are read in."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    lines = table(lines, "lines")
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = blocks.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).select("file", "block", "first", "before")
    return lines.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("row"), "value")


def _fault(path: Column, reason: str) -> Column:
    return F.struct(path.alias("path"), F.lit(reason).alias("reason"))


def faults(value: Column, json: Column, fields: list[Field]) -> Column:
    """Array of (path, reason)."""
    root, none = F.lit("$"), F.array().cast("array<struct<path:string,reason:string>>")
    found = []
    for f in fields:
        there, got = F.try_variant_get(json, f.path, "variant"), F.try_variant_get(json, f.path, f.kind)
        gone = there.isNull() | F.is_variant_null(there)
        if not f.kind.lower().startswith(("array", "struct", "map", "variant")):  # nested values are no text either
            got = F.when(~F.schema_of_variant(there).rlike("^(ARRAY|OBJECT)"), got)
        if f.required:
            found.append(F.when(gone, _fault(F.lit(f.path), "missing")))
        found.append(F.when(~gone & got.isNull(), _fault(F.lit(f.path), "kind")))
    each = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else none
    return (
        F.when(F.trim(F.coalesce(value, F.lit(""))) == "", F.array(_fault(root, "empty")))
        .when(json.isNull(), F.array(_fault(root, "no JSON")))
        .when(~F.schema_of_variant(json).startswith("OBJECT"), F.array(_fault(root, "no object")))
        .otherwise(each)
    )


def parsed(value: Column) -> Column:
    """A variant, NULL for what is not one JSON value and white space. The parser stops behind the
    first value, so each is parsed within a list and within an object: no rest fits into both."""
    listed = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), value, F.lit("}"))).isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(whole, F.try_variant_get(listed, "$[0]", "variant"))


def split(lines: DataFrame, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """lines (file, row, value) as good rows (file, row, and the fields) and faults (file, row, path,
    reason, value; a row for each fault)."""
    marked = lines.select("file", "row", "value", parsed(F.col("value")).alias("_json")).select("*", faults(F.col("value"), F.col("_json"), fields).alias("_faults"))
    good = marked.where(F.size("_faults") == 0).select("file", "row", *(F.try_variant_get("_json", f.path, f.kind).alias(f.name) for f in fields))
    bad = marked.select("file", "row", "value", F.explode("_faults").alias("f")).select("file", "row", "f.path", "f.reason", "value")
    return good, bad
