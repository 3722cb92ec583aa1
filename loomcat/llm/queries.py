"""The registered queries of the training-data operators and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, collocations, decontaminate, fill_in_middle, language_id, near_dup, quality, sentencepiece_codec, simhash, substring_dedup, suffix_dedup, warc, webp


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_read(spark, sf_dir, "documents"))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(_read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(_read(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(_read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digest(_read(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(_read(spark, sf_dir, "conversations"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.digest(_read(spark, sf_dir, "documents"))


def op12_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(_read(spark, sf_dir, "documents"))


OPERATORS = (op1_substring_dedup, op2_language_id, op3_minhash_near_dup, op4_suffix_dedup, op5_quality, op6_webp, op7_chat_format, op8_decontamination, op9_warc, op10_sentencepiece, op11_collocations, op12_simhash_near_dup, op13_fill_in_middle)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.SQL, "op3_minhash_near_dup": near_dup.SQL, "op4_suffix_dedup": suffix_dedup.SQL, "op9_warc": warc.SQL, "op11_collocations": collocations.SQL, "op12_simhash_near_dup": simhash.SQL, "op13_fill_in_middle": fill_in_middle.SQL,
}
