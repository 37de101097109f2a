"""Vector normalisation: layer configuration, keys, coordinate systems, promoted columns, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import properties as P
from ..functions.text import vn_normalize
from ..storage import materialise
from . import provenance, quality

#: Rules for a dataset that has just been read; those on versions, papers and provenance come with these.
IMPORT_RULES = ("CRS-BOUNDS", "CRS-MISSING", "GEOM-COLLECTION", "GEOM-DUPLICATE", "GEOM-EMPTY", "GEOM-INVALID", "GEOM-TYPE-MISMATCH", "ATTR-REQUIRED", "TOPO-LINE-CROSS", "TOPO-POLY-GAP", "TOPO-POLY-OVERLAP")
DEFAULT_LEVEL = "derived_machine_unreviewed"


def normalise(features: DataFrame, layers: DataFrame, field_map: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """features(layer, fid, epsg, geom, properties), layers(layer, grp) -> (kept, withheld).

    Kept rows have a key, a class, a name and its folded form, the group and a geometry in degrees; rows without one are
    withheld from storage but stay for validation."""
    f = features.withColumn("properties", P.rename_properties(F.col("properties"), field_map or {})).join(layers, "layer", "left")
    turn = lambda p: G.to_degrees(F.col("epsg"), p["x"], p["y"])
    parts = F.transform(F.col("geom.parts"), lambda part: F.transform(part, lambda ring: F.transform(ring, turn)))
    geom = F.when(G.identified(F.col("epsg")) & F.col("geom").isNotNull(), G.make(F.col("geom.gtype"), parts))
    name = P.first_truthy(F.col("properties"), ("name", "ten", "TEN", "title"))
    out = f.select("layer", "fid", P.stable_key(F.col("properties"), F.col("layer"), F.col("fid")).alias("fkey"), P.classification(F.col("properties")).alias("class"), name.alias("name"), vn_normalize(name).alias("norm_name"), P.group_name(F.col("grp")).alias("grp"), geom.alias("geom"), "properties", F.col("geom").alias("source_geom"), *keep)
    return out.where("geom IS NOT NULL"), out.where("geom IS NULL")


def ingest(features: DataFrame, config: DataFrame, field_map: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """features(artifact_id, sha256, layer, fid, epsg, geom, properties), config(layer, dataset_group, canonical_name,
    thematic_group, expected_type, required, no_overlap, no_gaps, no_line_cross, derivation_level; nulls allowed) ->
    datasets, layers, features, findings, events.

    All layers of all artifacts in one go: a layer of an artifact is a dataset. Features are normalised once, into a table
    that all five results read; those without a place in degrees are validated, by their own coordinates, but not kept. A
    layer without configuration takes its group from its name. Datasets with an error or worse among their findings have
    errors, all others are unchecked."""
    id_ = F.concat_ws("/", F.col("artifact_id").cast("string"), F.replace("layer", F.lit("|"), F.lit("_")))
    named = features.withColumn("dataset_id", id_)
    groups = config.select("layer", F.col("thematic_group").alias("grp"))
    kept, withheld = normalise(named, groups, field_map, keep=("dataset_id", "epsg"))
    rows = materialise(kept.unionByName(withheld), "normalised")
    own = named.groupBy("dataset_id", "artifact_id", "layer").agg(F.first("sha256").alias("sha256"), F.max("epsg").alias("epsg"), F.max("geom.gtype").alias("geometry_type"))
    own = own.join(config, "layer", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("no_overlap", "no_gaps", "no_line_cross")})
    own = materialise(own.withColumn("grp", F.coalesce("dataset_group", P.group_name(F.coalesce("thematic_group", "layer")))), "datasets")
    ctx = quality.Context(
        rows.select(F.col("dataset_id").alias("layer_id"), F.col("fid").alias("ord"), F.concat_ws("|", "dataset_id", "fkey").alias("key"), F.coalesce("geom", "source_geom").alias("geom"), "properties"),
        own.select(F.col("dataset_id").alias("layer_id"), F.col("layer").alias("layer_name"), "dataset_id", "geometry_type", "expected_type", F.coalesce("required", F.array().cast("array<string>")).alias("required"), F.col("no_overlap").alias("overlap"), F.col("no_gaps").alias("gap"), F.col("no_line_cross").alias("cross")),
        own.select("dataset_id", "epsg"),
    )
    findings = quality.run(ctx, features.sparkSession, only=tuple(quality.PREFIX + r for r in IMPORT_RULES)).withColumn("dataset_id", F.substring_index("target_ref", "|", 1))
    bad = findings.where(F.col("severity").isin("error", "critical")).select("dataset_id").distinct().withColumn("bad", F.lit(True))
    counts = rows.where("geom IS NOT NULL").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    datasets = own.join(bad, "dataset_id", "left").select(
        "dataset_id", "artifact_id", F.col("layer").alias("name"), F.col("grp").alias("dataset_group"), F.lit("vector").alias("dataset_type"), F.col("epsg").alias("original_epsg"), F.lit(4326).alias("canonical_crs"),
        F.coalesce("derivation_level", F.lit(DEFAULT_LEVEL)).alias("derivation_level"), F.lit("pending").alias("review_status"), F.when(F.col("bad"), "errors").otherwise("unchecked").alias("quality_state"),
    )
    canonical = F.coalesce("canonical_name", F.replace(F.lower("layer"), F.lit(" "), F.lit("_")))
    layers = own.join(counts, "dataset_id", "left").select("dataset_id", canonical.alias("canonical_name"), F.col("layer").alias("source_name"), "thematic_group", "geometry_type", F.coalesce("n", F.lit(0)).alias("feature_count"))
    source = F.array(F.struct(F.lit("artifact").alias("entity_type"), F.col("artifact_id").cast("string").alias("entity_id"), F.col("sha256").alias("sha256")))
    events = provenance.events(own, F.lit("dataset"), F.col("dataset_id"), "imported", source, F.col("sha256"))
    return {"datasets": datasets, "layers": layers, "features": rows.where("geom IS NOT NULL").drop("source_geom", "epsg"), "findings": findings, "events": events}
