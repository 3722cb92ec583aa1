"""Scraped JSON: catalog listings, their envelopes, and monthly review shards. Reading fails on
anything that does not fit the schemas. Fields of listings are read as maps, so that none is lost
without a word: `field_faults` says which are missing or not known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field names of the sources, and the columns they become (fixed values).
BASIC_FIELDS = {
    "课程号": "course_code", "课程名": "course_name", "课程类别": "category", "学分": "credits", "教师": "teacher", "班号": "class_no", "开课单位": "department", "专业": "major", "年级": "grade",
    "上课时间及教室": "schedule", "限数已选": "enrollment", "自选PNP": "pnp", "备注": "notes",
}
OPTIONAL_FIELDS = ("英语等级",)
DETAIL_FIELDS = {
    "undergraduate": {
        "英文名称": "english_name", "先修课程": "prerequisites", "中文简介": "intro_cn", "英文简介": "intro_en", "成绩记载方式": "grading", "通识课所属系列": "ge_series", "授课语言": "language",
        "教材": "textbook", "参考书": "reference_book", "教学大纲": "syllabus", "教学评估": "evaluation",
    },
    "graduate": {"英文名称": "english_name", "周学时": "weekly_hours", "总学时": "total_hours", "开课学期": "term", "修读对象": "audience", "参考书": "reference_book", "课程简介": "intro", "详情备注": "extra_notes", "大纲": "syllabus"},
}
_LISTING = (("课程类型", "string"), ("数据学期", "string"), ("详情链接", "string"), ("课程序号", "string"), ("基本信息", "map<string,string>"), ("详细信息", "map<string,string>"))
LISTING = ", ".join(f"`{n}` {k}" for n, k in _LISTING)
ENVELOPE = (
    "term string, stats map<string,bigint>, rows array<struct<" + ",".join(f"`{n}`:{k}" for n, k in _LISTING) + ">>, errors array<string>, "
    "validation struct<totalRows:bigint,duplicateSeqs:array<string>,duplicateKeys:array<string>,missingCourseCodes:array<string>,missingDetailLinks:array<string>,suspiciousPages:array<string>>"
)
COMMENT = "struct<cid:bigint,floor:int,text:string,timestamp:bigint,replyTo:string,authorTag:string,authorLabel:string>"
SHARD = f"version int, `key` string, posts map<string,struct<pid:bigint,text:string,timestamp:bigint,url:string,authorTag:string,comments:array<{COMMENT}>>>"
_STRICT = {"mode": "FAILFAST", "multiLine": "true", "allowNonNumericNumbers": "false"}


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Rows as scraped: one JSON list a file."""
    return spark.read.schema(LISTING).options(**_STRICT).json(path)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """term, stats, rows, errors and validation: one JSON object a file."""
    return spark.read.schema(ENVELOPE).options(**_STRICT).json(path)


def envelope_rows(envelopes: DataFrame) -> DataFrame:
    """The rows of envelopes, with their term."""
    return envelopes.select("term", F.explode("rows").alias("r")).select("term", "r.*")


def listing_columns(rows: DataFrame, shape: str = "undergraduate") -> DataFrame:
    """Scraped rows of one shape (undergraduate or graduate) as columns; a missing detail is an empty
    string."""
    basic = [F.col("基本信息")[k].alias(v) for k, v in BASIC_FIELDS.items()]
    detail = [F.coalesce(F.col("详细信息")[k], F.lit("")).alias(v) for k, v in DETAIL_FIELDS[shape].items()]
    return rows.select(F.col("课程序号").alias("seq"), F.col("课程类型").alias("course_type"), F.col("详情链接").alias("link"), *basic, *detail)


def field_faults(rows: DataFrame, shape: str = "undergraduate") -> DataFrame:
    """seq and fault of rows whose fields are not exactly those of the shape. Optional fields may be
    missing; a graduate listing has no PNP."""
    basic = [x for x in BASIC_FIELDS if shape == "undergraduate" or x != "自选PNP"]

    def named(what: str, fields: Column, want: list[str], may: tuple[str, ...] = ()) -> Column:
        have, all_ = F.coalesce(F.map_keys(fields), F.array().cast("array<string>")), F.array(*map(F.lit, want))
        text = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{kind} {what}: "), x))
        known = F.array(*map(F.lit, [*want, *may]))
        return F.concat(text("missing", F.array_except(all_, have)), text("unknown", F.array_except(have, known)))

    found = F.concat(named("basic field", F.col("基本信息"), basic, OPTIONAL_FIELDS), named("detail field", F.col("详细信息"), list(DETAIL_FIELDS[shape])))
    return rows.select(F.col("课程序号").alias("seq"), F.explode(found).alias("fault"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).options(**_STRICT).json(path)


def shard_posts(shards: DataFrame) -> DataFrame:
    """pid, source_month, posted_at, content, source_url and comments; who wrote it is left out."""
    return shards.select(F.col("key").alias("source_month"), F.explode(F.map_values("posts")).alias("p")).select(
        F.col("p.pid").alias("pid"), "source_month", F.col("p.timestamp").alias("posted_at"), F.col("p.text").alias("content"), F.col("p.url").alias("source_url"),
        F.transform(F.coalesce("p.comments", F.array().cast(f"array<{COMMENT}>")), lambda c: F.struct(c["cid"].alias("cid"), c["floor"].alias("floor"), c["timestamp"].alias("posted_at"), c["text"].alias("content"))).alias("comments"),
    )


def post_replies(posts: DataFrame) -> DataFrame:
    """pid, ordinal, cid, floor, posted_at, content of every reply that has text."""
    rows = posts.select("pid", F.posexplode("comments").alias("ordinal", "c")).select("pid", "ordinal", "c.*")
    return rows.where(F.trim(F.coalesce("content", F.lit(""))) != "")


def schedule_parts(schedule: str = "schedule") -> dict:
    """weekdays (joined), first_period and classroom of text such as 1~2周 每周周一1~2节 一教101."""
    days = F.array_join(F.array_distinct(F.regexp_extract_all(schedule, F.lit(r"(周[一二三四五六日])"), 1)), "")
    first = F.array_min(F.transform(F.regexp_extract_all(schedule, F.lit(r"周[一二三四五六日](\d+)~\d+节"), 1), lambda x: x.cast("int")))
    return {"weekdays": days, "first_period": first, "classroom": F.regexp_extract(schedule, r"节\s+(\S+)", 1)}
