"""Document metadata from explicit fields and text candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Origins, strongest first; a document has its weakest field's.
ORIGINS = ("explicit", "deterministic", "unknown", "machine")


def origin_rank(origin: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORIGINS)), origin)


def weakest_origin(rows: DataFrame, key: str, origin: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(origin, origin_rank(F.col(origin))).alias("origin"))


def build_metadata(known: DataFrame, candidates: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Explicit values win over candidates; every field keeps its origin; a document with candidates needs review first."""
    wide = candidates.groupBy(doc).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"c_{n}") for n in ("decision_number", "signed_date")], F.count(F.lit(1)).alias("n_candidates"))
    j = known.join(wide, doc, "left")
    number = F.coalesce("document_number", "c_decision_number")
    signed = F.coalesce("signed_date", "c_signed_date")
    origin = lambda own, other: F.when(F.col(own).isNotNull(), "explicit").when(F.col(other).isNotNull(), "machine")
    n_origin, s_origin = origin("document_number", "c_decision_number"), origin("signed_date", "c_signed_date")
    worst = F.greatest(F.coalesce(origin_rank(n_origin), F.lit(0)), F.coalesce(origin_rank(s_origin), F.lit(0)))
    weakest = F.lit("unknown")
    for i, name in enumerate(ORIGINS):
        weakest = F.when(worst == i + 1, name).otherwise(weakest)
    has = F.coalesce(F.col("n_candidates"), F.lit(0)) > 0
    return j.select(doc, number.alias("document_number"), n_origin.alias("number_origin"), F.to_date(signed).alias("signed_date"), weakest.alias("origin"), F.when(has, 60).otherwise(55).alias("task_priority"))


def fill_only_empty(docs: DataFrame, found: DataFrame, key: str, field: str) -> DataFrame:
    """docs with the field filled from found where it has none, and whether it was filled."""
    j = docs.join(found.withColumnRenamed(field, "_found"), key, "left")
    return j.select(key, F.coalesce(field, "_found").alias(field), (F.col(field).isNull() & F.col("_found").isNotNull()).alias("filled"))


def ensure_tasks(wanted: DataFrame, pending: DataFrame) -> DataFrame:
    """Targets that have no pending task yet."""
    return wanted.distinct().join(pending.distinct(), ["target_type", "target_id"], "left_anti")
