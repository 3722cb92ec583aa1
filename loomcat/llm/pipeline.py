"""Corpus cleaning as a chain of stages.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and
returns the columns of documents; the last adds its own. ORACLE_SQL is None: a Kneser-Ney model,
connected components and a tokenizer can't be put in SQL, so tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, near_dup, quality, sentencepiece_codec, substring_dedup


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays."""
    return near_dup.keep_one(docs)


def no_recurring_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out of later ones."""
    return substring_dedup.drop_passages(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a test item or more go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text they decode to."""
    return sentencepiece_codec.encode(docs)


STAGES = [("quality", good_text), ("near_dup", one_of_each_group), ("substring_dedup", no_recurring_passages), ("decontamination", no_benchmark), ("sentencepiece", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
