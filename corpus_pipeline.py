"""Corpus pipeline: language, near-duplicates, benchmark passages, mixing, token files.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landloom.llm import decontamination, language, mixing, simhash, token_files
from landloom.llm.shared import materialise, small_batches, small_broadcasts

#: Encoded pieces that a Python worker keeps, and bytes of texts it takes at once; the workers have served the other stages by then.
TOKEN_PIECES, TOKEN_BYTES = 100_000, 2 << 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose words fit no language well, go."""
    small_batches(spark)
    small_broadcasts(spark)
    return language.keep_languages(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8 or more) the one with the smallest id stays."""
    small_batches(spark)
    small_broadcasts(spark)
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    small_broadcasts(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    small_broadcasts(spark)
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; one row per document with its place in them."""
    small_batches(spark)
    small_broadcasts(spark)
    return token_files.encode_and_index(docs, kept=TOKEN_PIECES, batch_bytes=TOKEN_BYTES, across_tasks=False)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("token_ids", token_ids),
]
#: No stage but mixing and decontamination can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
