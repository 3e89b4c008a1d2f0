"""The registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat_format, decontaminate, html_extract, kneser_ney, language_id, near_dedup, quality_net, quality_rules, suffix_dedup

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(chat_format.PROBE, "conv_id long, turn long, role string, text string")
    return chat_format.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe))


ORACLES["op2_chat_format"] = chat_format.SQL


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


@query
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.scores(table(spark, sf_dir, "documents"))


@query
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op6_quality_rules"] = quality_rules.SQL


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents"))


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its class."""
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents")).drop("digest")


@query
def op10_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op1_decontaminate"] = decontaminate.SQL
ORACLES["op7_suffix_dedup"] = suffix_dedup.SQL
ORACLES["op9_near_dedup"] = near_dedup.SQL
