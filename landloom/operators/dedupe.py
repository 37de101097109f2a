"""Content digests and semantic dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import geometry_text
from ..functions.properties import canonical_json, content_digest


def digests(rows: DataFrame, keys: list[str], row_hash: str, buckets: int = 64) -> DataFrame:
    """keys, digest: the same for any order and partitioning of a key's rows. No list is longer than a bucket."""
    bucket, inner, outer = content_digest(row_hash, buckets)
    parts = rows.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(inner.alias("digest"))
    return parts.groupBy(*keys).agg(outer.alias("digest"))


def feature_hash(layer: Column, external_id: Column, classification: Column, properties: Column, geom: Column) -> Column:
    """Digest of what a feature says: its five parts, joined by NUL; a null part is empty."""
    return F.sha2(F.array_join(F.transform(F.array(layer, external_id, classification, canonical_json(properties), geometry_text(geom)), lambda x: F.coalesce(x, F.lit(""))), "\x00"), 256)


def dataset_digests(features: DataFrame, key: str = "dataset_id") -> DataFrame:
    """features(key, layer_name, external_id, class, properties, geom) -> key, digest: equal for two deliveries of the same
    features in any order and any bytes."""
    h = features.select(key, feature_hash(F.col("layer_name"), F.col("external_id"), F.col("class"), F.col("properties"), F.col("geom")).alias("h"))
    return digests(h, [key], "h")


def semantic_duplicates(datasets: DataFrame, record: str = "record_id", name: str = "name", at: str = "created_at", digest: str = "digest", tie: str = "dataset_id") -> DataFrame:
    """Adds duplicate: the digest equals that of the latest earlier dataset of the same name in the record."""
    before = Window.partitionBy(record, name).orderBy(at, tie)
    return datasets.withColumn("duplicate", F.coalesce(F.col(digest) == F.lag(digest).over(before), F.lit(False)))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in encounter order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drop_copies(datasets: DataFrame, versions: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(kept datasets, versions left empty by the copies that went): a version that had none to begin with stays."""
    marked = semantic_duplicates(datasets, **columns)
    kept = marked.where("NOT duplicate").drop("duplicate")
    emptied = marked.groupBy("version_id").agg(F.bool_and("duplicate").alias("gone")).where("gone").select("version_id")
    return kept, versions.join(emptied, "version_id", "left_semi")
