"""Keyed version diff and changeset summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

IGNORED = ("_transform_error",)


def keyed(features: DataFrame) -> DataFrame:
    """features(key, class, geom, properties, ord): rows without a key go, the last of equal keys stays."""
    w = Window.partitionBy("key").orderBy(F.desc("ord"))
    return features.where("key IS NOT NULL AND key <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "ord")


def property_changes(old, new):
    """map of each differing key to struct<old, new>, both maps' keys looked at."""
    names = F.filter(F.array_union(F.map_keys(old), F.map_keys(new)), lambda k: ~k.isin(*IGNORED) & ~old[k].eqNullSafe(new[k]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.struct(old[k].alias("old"), new[k].alias("new"))))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, changes (array: added, removed, geometry_changed, classification_changed, properties_changed or unchanged),
    properties, and both geometries."""
    a = keyed(old).select("key", *[F.col(c).alias(f"o_{c}") for c in ("class", "geom", "properties")], F.lit(True).alias("_o"))
    b = keyed(new).select("key", *[F.col(c).alias(f"n_{c}") for c in ("class", "geom", "properties")], F.lit(True).alias("_n"))
    j = a.join(b, "key", "full_outer")
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    changed = property_changes(F.col("o_properties"), F.col("n_properties"))
    j = j.withColumn("properties", F.when(both, changed)).withColumn("_same", G.equal_exact(F.col("o_geom"), F.col("n_geom")))
    named = F.array_compact(F.array(
        F.when(F.col("_o").isNull(), "added"), F.when(F.col("_n").isNull(), "removed"), F.when(both & ~F.col("_same"), "geometry_changed"),
        F.when(both & ~F.nullif("o_class", F.lit("")).eqNullSafe(F.nullif("n_class", F.lit(""))), "classification_changed"), F.when(both & (F.size("properties") > 0), "properties_changed"),
    ))
    return j.select("key", F.when(F.size(named) == 0, F.array(F.lit("unchanged"))).otherwise(named).alias("changes"), "properties", "o_geom", "n_geom")


def changeset_summary(entries: DataFrame) -> DataFrame:
    """One row: the six counts and added, removed and modified square metres, rounded to 0.1. Overlay runs only for
    features whose geometry changed."""
    from ..functions.overlay import symdiff_m2

    has = lambda c: F.array_contains("changes", c)
    counts = ("added", "removed", "geometry_changed", "classification_changed", "properties_changed", "unchanged")
    parts = F.when(has("geometry_changed") & F.col("o_geom").isNotNull() & F.col("n_geom").isNotNull(), F.struct(F.col("o_geom.parts").alias("a"), F.col("n_geom.parts").alias("b")))
    e = entries.withColumn("_p", parts).withColumn("m2", symdiff_m2("_p.a", "_p.b"))
    area = lambda c, g: F.round(F.coalesce(F.sum(F.when(has(c), G.area_m2(F.col(g)))), F.lit(0.0)), 1)
    return e.agg(*[F.count_if(has(c)).alias(c) for c in counts], area("added", "n_geom").alias("added_m2"), area("removed", "o_geom").alias("removed_m2"), F.round(F.coalesce(F.sum(F.when(has("geometry_changed"), F.col("m2"))), F.lit(0.0)), 1).alias("modified_m2"))


def uncomputed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Layer pairs without a changeset yet."""
    return pairs.join(known, ["from_layer", "to_layer"], "left_anti")


def layer_pairs(layers: DataFrame, group: str = "land_use") -> DataFrame:
    """layers(version_id, dataset_id, layer_id, grp) -> the first layer of the group in each version."""
    return layers.where(F.col("grp") == group).groupBy("version_id").agg(F.min("layer_id").alias("layer_id"))
