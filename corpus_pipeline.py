"""The corpus pipeline: five stages from raw documents to tokens.

Every stage but the last returns the columns of its documents, whatever their names, and takes nulls in any of them. An empty table stays
empty, an empty benchmark removes nothing. Rows without a doc_id are documents like others. What a stage does with empty and very long texts, ties and
repeated rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddsmill.llm import bpe, decontaminate, near_dedup, quality_rules, suffix_dedup
from oddsmill.llm._store import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go.

    Null and empty texts have no words and go. Texts are judged whole, however long. Rows are judged one by one, so repeated rows stay or go together.
    """
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays: the one with the least doc_id, of rows with one doc_id and text one of them.

    Texts without a word (null and empty ones have been removed before, and would stay) are copies only of equal texts. Rows without a doc_id
    stay only where their class has no other. Of rows that are equal in doc_id and text, the one of the least hash of its other columns stays.
    """
    return near_dedup.drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes that stand elsewhere too are cut out, each occurrence, with what is left of a character that was cut in half.

    A null text, and one under 400 bytes, stays as it is. Rows with equal texts of 400 bytes or more are repeats of each other and become empty; no row goes.
    """
    return suffix_dedup.stripped_documents(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out: the words of each hit, and what stands between them.

    A null or empty text stays as it is. Texts are searched whole, one row at a time; no row goes.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, and digests of the token ids of what is left and of their decoding, one row a document.

    A null text is empty and has no ids. Texts are encoded whole, one row at a time.
    """
    return bpe.token_digests(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontaminate", benchmark_leaks),
    ("byte_bpe", tokens),
]

#: Weighted sampling, suffix sorting and byte pair encoding have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
