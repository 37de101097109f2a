"""Coverage of administrative units: counts, state, freshness, details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_units(units: DataFrame, sources: DataFrame) -> DataFrame:
    """unit_id, source_id by the direct link or by the unit's name, each pair once; two equi-joins, no OR."""
    direct = units.join(sources.select("source_id", "unit_id"), "unit_id").select("unit_id", "source_id")
    named = units.join(sources.select("source_id", F.col("jurisdiction").alias("unit_name")), "unit_name").select("unit_id", "source_id")
    return direct.union(named).distinct()


def summary(units: DataFrame, sources: DataFrame, records: DataFrame, versions: DataFrame, documents: DataFrame, datasets: DataFrame) -> DataFrame:
    """unit_id, source, document, dataset and reviewed counts and the state; units without anything too."""
    v = versions.join(records.select("record_id", "unit_id"), "record_id").select("version_id", "unit_id")
    n = lambda df, name: df.groupBy("unit_id").agg(F.count(F.lit(1)).alias(name))
    d = datasets.join(v, "version_id").groupBy("unit_id").agg(F.count(F.lit(1)).alias("dataset_count"), F.count_if(F.col("review_status") == "approved").alias("reviewed_count"), F.bool_or(F.col("dataset_type") == "vector").alias("gis"), F.bool_or(F.col("dataset_type") == "raster").alias("raster"))
    out = units.select("unit_id").join(n(source_units(units, sources), "source_count"), "unit_id", "left").join(n(documents.join(v, "version_id"), "document_count"), "unit_id", "left").join(d, "unit_id", "left")
    out = out.fillna(0, ["source_count", "document_count", "dataset_count", "reviewed_count"]).fillna(False, ["gis", "raster"])
    state = F.when(F.col("reviewed_count") > 0, "reviewed").when(F.col("gis"), "gis_available").when(F.col("raster"), "raster_available").when(F.col("document_count") > 0, "documents_indexed").when(F.col("source_count") > 0, "source_discovered").otherwise("no_source_discovered")
    return out.select("unit_id", "source_count", "document_count", "dataset_count", "reviewed_count", state.alias("state"))


def freshness(units: DataFrame, sources: DataFrame, states: DataFrame) -> DataFrame:
    """unit_id, last_success, healths, any_due of the directly linked sources."""
    j = sources.select("source_id", "unit_id").join(states, "source_id", "left")
    g = j.groupBy("unit_id").agg(F.max("last_success").alias("last_success"), F.sort_array(F.collect_set("health")).alias("healths"), F.bool_or("due").alias("any_due"))
    return units.select("unit_id").join(g, "unit_id", "left")


def detail(units: DataFrame, sources: DataFrame, records: DataFrame, versions: DataFrame, datasets: DataFrame, tasks: DataFrame) -> DataFrame:
    """unit_id, sources, records, versions, earliest, latest, vector, raster, official, derived, pending tasks."""
    v = versions.join(records.select("record_id", "unit_id"), "record_id")
    d = datasets.join(v.select("version_id", "unit_id"), "version_id")
    gv = v.groupBy("unit_id").agg(F.count(F.lit(1)).alias("versions"), F.min("effective_from").alias("earliest"), F.max("effective_from").alias("latest"))
    gd = d.groupBy("unit_id").agg(F.count_if(F.col("dataset_type") == "vector").alias("vector"), F.count_if(F.col("dataset_type") == "raster").alias("raster"), F.count_if(F.col("derivation_level").startswith("official")).alias("official"), F.count_if(~F.col("derivation_level").startswith("official")).alias("derived"))
    gr = records.groupBy("unit_id").agg(F.count(F.lit(1)).alias("records"))
    gs = source_units(units, sources).groupBy("unit_id").agg(F.count(F.lit(1)).alias("sources"))
    targets = d.select(F.lit("dataset").alias("target_type"), F.col("dataset_id").alias("target_id"), "unit_id")
    gt = tasks.where("status = 'pending'").join(targets, ["target_type", "target_id"]).groupBy("unit_id").agg(F.count(F.lit(1)).alias("pending_tasks"))
    out = units.select("unit_id")
    for g in (gs, gr, gv, gd, gt):
        out = out.join(g, "unit_id", "left")
    return out.fillna(0, ["sources", "records", "versions", "vector", "raster", "official", "derived", "pending_tasks"])


def data_class(record_sources: DataFrame, records: DataFrame) -> DataFrame:
    """record_id, data_class of the keys of its sources: unknown, synthetic, mixed or official."""
    demo = F.col("source_key").startswith("demo/")
    g = record_sources.groupBy("record_id").agg(F.bool_and(demo).alias("all_demo"), F.bool_or(demo).alias("any_demo"))
    kind = F.when(F.col("all_demo").isNull(), "unknown").when(F.col("all_demo"), "synthetic").when(F.col("any_demo"), "mixed").otherwise("official")
    return records.select("record_id").distinct().join(g, "record_id", "left").select("record_id", kind.alias("data_class"))
