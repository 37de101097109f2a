"""Exact dedup by skew-safe combining.

Copies are merged where they are read, then by digest and salt, then the salts' winners by digest; full texts are
compared at all three stages, so a digest that two texts share would still give two groups.

Defined cases: a null text counts as empty; a null id never wins over an id, and a group of null ids alone keeps them;
rows that repeat the kept id are all marked kept; an empty table gives an empty table; columns other than id and text
are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, spread_join

SALTS = 32
_TEXTS = "id bigint, digest binary, norm string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        norm = pc.ascii_lower(b.column(1))
        digest = pa.array([hashlib.sha256(x.as_buffer()).digest() for x in norm], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), digest, norm], names=["id", "digest", "norm"])


def _only_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _digests(batches):
        yield b.select(["id", "digest"])


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary SHA-256 of the lower-cased text)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = rows.mapInArrow(_digests, _TEXTS).withColumn("salt", F.spark_partition_id() % salts)
    salted = texts.groupBy("digest", "salt", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    counted = whole.select("digest", "keep_id", "group_size", F.count(F.lit(1)).over(Window.partitionBy("digest")).alias("variants"))
    groups = materialise(counted, "dedup-groups")
    ids = rows.mapInArrow(_only_digests, "id bigint, digest binary")
    out = spread_join(ids, groups.where("variants = 1").drop("variants"), "digest", "group_size", "id")
    shared = groups.where("variants > 1").select("digest").distinct()
    if not shared.isEmpty():  # two texts of one digest: their rows are matched by the text itself
        full = rows.mapInArrow(_digests, _TEXTS).join(shared, "digest", "left_semi")
        groups2 = full.groupBy("digest", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(full.join(groups2, ["digest", "norm"]).drop("norm"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns kept."""
    kept = duplicate_groups(docs, id_col, text_col).where("kept").select(F.col("id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("_kept_id")), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every row of documents with its group."""
    g = duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
