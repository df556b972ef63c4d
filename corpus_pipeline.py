"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns the rows for the next one; ``docs`` are what
the stage before has kept, read from Parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from murmura.llm import common, decontaminate, near_dedup, passages, pieces, quality


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, near_dedup.Near(words=5, percent=80))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over 50 words, and byte strings of 400 or more, that stand in more than one place; documents left empty go."""
    return passages.drop_repeats(docs, words=51)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item or a near copy of one."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes them again: doc_id, n_tokens, ids, round_trip."""
    return pieces.tokenize(docs, pieces.MODEL)


STAGES = [
    ("quality rules", good_quality),
    ("near-duplicates", one_of_each_group),
    ("repeated passages", without_repeats),
    ("benchmark leaks", without_leaks),
    ("tokens", tokens),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
