"""Registry operators: layer configuration, descriptors, units, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_layer_config(layers: DataFrame, configs: DataFrame, aliases: DataFrame) -> DataFrame:
    """layers(layer, stem, ...), configs(name, config), aliases(raw, alias): a layer takes the configuration of its name,
    its name's alias, its file stem or its stem's alias, in that order."""
    rows = layers.withColumn("_row", F.struct(*layers.columns))
    named = rows.select("_row", F.posexplode(F.array("layer", "stem")).alias("place", "raw"))
    candidates = named.select("_row", (F.col("place") * 2).alias("p"), F.col("raw").alias("name")).union(named.join(aliases, "raw").select("_row", F.col("place") * 2 + 1, "alias"))
    best = candidates.join(configs, "name").groupBy("_row").agg(F.min_by("config", "p").alias("config"))
    return rows.join(best, "_row", "left").drop("_row")


def validate_descriptors(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """descriptors(source_key, source_type, base_url, file_tail) + issues (array of codes)."""
    key = F.col("source_key")
    many = F.count(F.lit(1)).over(Window.partitionBy("source_key"))
    tests = {"missing_key": key.isNull(), "bad_key": ~key.rlike(r"^[a-z0-9][a-z0-9/_-]*$"), "bad_type": ~F.coalesce(F.col("source_type").isin(*kinds), F.lit(False)), "missing_url": F.coalesce(F.col("base_url"), F.lit("")) == "", "file_name": F.substring_index("source_key", "/", -1) != F.col("file_tail"), "duplicate_key": key.isNotNull() & (many > 1)}
    return rows.withColumn("issues", F.array_compact(F.array(*[F.when(t, c) for c, t in tests.items()])))


def upsert(current: DataFrame, incoming: DataFrame, key: str, digest: str = "digest") -> DataFrame:
    """key, action: created, updated, unchanged or disabled (no longer there)."""
    a, b = current.select(key, F.col(digest).alias("_old")), incoming.select(key, F.col(digest).alias("_new"))
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "disabled").when(F.col("_old") != F.col("_new"), "updated").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def match_units(rows: DataFrame, units: DataFrame, row_id: str) -> DataFrame:
    """rows(row_id, commune, district, province, name), units(unit_id, code, norm_name, valid_to): the most local code
    that is known wins, of equal codes the one still valid or valid longest; else the name."""
    codes = rows.select(row_id, F.posexplode(F.array("commune", "district", "province")).alias("p", "code")).where("code IS NOT NULL")
    by_code = codes.join(units, "code").select(row_id, "p", "unit_id", "valid_to")
    by_name = rows.join(units, rows["name"] == units["norm_name"]).select(row_id, F.lit(3).alias("p"), "unit_id", "valid_to")
    w = Window.partitionBy(row_id).orderBy("p", F.col("valid_to").desc_nulls_first(), "unit_id")
    return by_code.union(by_name).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(row_id, "unit_id")

