"""Publication: gate, manifest, tiles, pages, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import overlay
from ..functions.properties import level_rank, official
from ..storage import StateTable, dealt, materialise
from . import spatial

MAX_ZOOM = 14
#: Features of a row of a tile; a tile with more has several.
CHUNK = 10_000


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of rows in a unique order, with the total of all; the count is an aggregate, not a window."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(min(limit, 500)).crossJoin(F.broadcast(total))  # one row


def gate(datasets: DataFrame, allow_unreviewed: bool = False) -> DataFrame:
    """version_id, ok, blocked (array), dataset_count: official or approved datasets may be published."""
    fine = official(F.col("derivation_level")) | (F.col("review_status") == "approved") | F.lit(allow_unreviewed)
    blocked = F.sort_array(F.array_compact(F.collect_list(F.when(~fine, F.struct("dataset_id", "dataset_name", "derivation_level", "review_status")))))
    return datasets.groupBy("version_id").agg(blocked.alias("blocked"), F.count(F.lit(1)).alias("dataset_count")).withColumn("ok", F.size("blocked") == 0)


def worst_level(datasets: DataFrame, key: str) -> DataFrame:
    return datasets.groupBy(key).agg(F.coalesce(F.max_by("derivation_level", level_rank(F.col("derivation_level"))), F.lit("reference_approximate")).alias("worst_level"))


def manifest(datasets: DataFrame, layers: DataFrame, features: DataFrame, findings: DataFrame) -> DataFrame:
    """version_id, datasets (layer and feature counts), open finding counts by severity, rule codes, bbox."""
    counts = features.groupBy("layer_id").agg(F.count(F.lit(1)).alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    by_dataset = layers.join(counts, "layer_id", "left").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("layers"), F.coalesce(F.sum("n"), F.lit(0)).alias("features"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    quality = findings.groupBy("version_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.sort_array(F.collect_set("rule_code")).alias("rule_codes"))
    d = datasets.join(by_dataset, "dataset_id", "left")
    m = d.groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("dataset_id", "dataset_name", "layers", "features"))).alias("datasets"), F.array(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).alias("bbox"))
    return m.join(quality, "version_id", "left")


def tiles(features: DataFrame, min_zoom: int, max_zoom: int, geometry: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Tile rows version_id, z, x, y, tile_id, chunk, n, ids, shapes: the features in a tile in id order inside each chunk,
    with their parts clipped and quantised (geometry) or without.

    No row grows with a version: ids are dealt over so many parts that the parts of the fullest tile hold a quarter of a
    chunk each, and parts are filled into chunks by running counts of the parts."""
    parts = -(-features.count() * 4 // chunk) or 1
    t = spatial.tile_cover(dealt(features), min_zoom, max_zoom)
    shape = overlay.tile_geometry(F.col("geom.parts"), G.tile_bounds(F.col("z"), F.col("x"), F.col("y"))) if geometry else F.lit(None).cast("array<array<array<struct<x:bigint,y:bigint>>>>")
    t = t.select("version_id", "z", "x", "y", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.struct("id", shape.alias("shape")).alias("one"))
    tile = ["version_id", "z", "x", "y"]
    by = t.groupBy(*tile, "part").agg(F.collect_list("one").alias("own"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*tile).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = by.withColumn("chunk", F.floor(before / chunk).cast("int")).groupBy(*tile, "chunk").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("own"))
    return rows.select(*tile, G.hilbert_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"), "chunk", F.size("own").alias("n"), F.col("own.id").alias("ids"), F.col("own.shape").alias("shapes"))


def checksum(tile_rows: DataFrame) -> DataFrame:
    """version_id, tile_count, feature_count (over all tiles), min_zoom, max_zoom, checksum over tile rows, in two levels."""
    h = F.sha2(F.concat_ws("|", "z", "x", "y", "chunk", F.concat_ws(",", F.col("ids").cast("array<string>")), F.to_json(F.struct("shapes"))), 256)
    by = tile_rows.groupBy("version_id", "z", F.floor(F.col("tile_id") / 65536).alias("part")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list(h))), 256).alias("h"), F.count_if(F.col("chunk") == 0).alias("tiles"), F.sum("n").alias("n"))
    whole = F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("z", "part", "h"))), lambda s: s["h"])), 256)
    return by.groupBy("version_id").agg(F.sum("tiles").alias("tile_count"), F.sum("n").alias("feature_count"), F.min("z").cast("int").alias("min_zoom"), F.max("z").cast("int").alias("max_zoom"), whole.alias("checksum"))


EVENT = "struct<operation:string,input_ref:bigint,output_hash:string,tiles:bigint,max_zoom:int,at:timestamp>"
PUBLICATION = f"version_id bigint, status string, data_path string, manifest string, checksum string, tile_count bigint, feature_count bigint, min_zoom int, max_zoom int, bbox array<double>, dataset_ids array<bigint>, published_at timestamp, events array<{EVENT}>"


def publications(spark: SparkSession, target: str) -> StateTable:
    """The current publication of each version."""
    return StateTable(spark, f"{target}/publications", PUBLICATION, "version_id", buckets=16)


def publish(datasets: DataFrame, layers: DataFrame, features: DataFrame, target: str, findings: DataFrame | None = None, max_zoom: int = MAX_ZOOM, allow_unreviewed: bool = False, geometry: bool = True) -> DataFrame:
    """Publishes the versions that pass the gate; returns a row for each version: status (published or blocked), blocked,
    and its publication.

    Tile rows go to a new folder, partitioned by version and zoom and laid out by tile number, and are read back for their
    checksum. Then one commit names folder, manifest, checksum, published datasets and the event of each version: readers
    see the publication before it or after it, and one that fails leaves what was published as it was."""
    spark = datasets.sparkSession
    judged = gate(datasets, allow_unreviewed)
    ok = judged.where("ok").select("version_id")
    own = datasets.join(ok, "version_id", "left_semi")
    f = features.join(layers, "layer_id").join(own.select("dataset_id", "version_id"), "dataset_id")
    path = f"{target}/tiles/{uuid.uuid4().hex}"
    rows = tiles(f, 0, max_zoom, geometry)
    rows.repartitionByRange("version_id", "z", "tile_id", "chunk").sortWithinPartitions("version_id", "z", "tile_id", "chunk").write.partitionBy("version_id", "z").option("compression", "uncompressed").parquet(path)
    schema = f"tile_id bigint, x bigint, y bigint, chunk int, n int, ids array<{dict(features.dtypes)['id']}>, shapes array<array<array<array<struct<x:bigint,y:bigint>>>>>, version_id bigint, z int"
    sums = checksum(spark.read.schema(schema).parquet(path))
    none = spark.createDataFrame([], "version_id bigint, severity string, rule_code string")
    boxed = f.select("layer_id", *[F.col(f"geom.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    made = manifest(own, layers, boxed, none if findings is None else findings).join(sums, "version_id")
    facts = ["version_id", "datasets", "bbox", "errors", "warnings", "rule_codes", "tile_count", "min_zoom", "max_zoom", "checksum"]
    event = F.struct(F.lit("published").alias("operation"), F.col("version_id").cast("bigint").alias("input_ref"), F.col("checksum").alias("output_hash"), F.col("tile_count").alias("tiles"), F.lit(max_zoom).alias("max_zoom"), F.current_timestamp().alias("at"))
    new = made.select(
        F.col("version_id").cast("bigint").alias("version_id"), F.lit("published").alias("status"), F.lit(path).alias("data_path"), F.to_json(F.struct(*facts)).alias("manifest"), "checksum", "tile_count", "feature_count", "min_zoom", "max_zoom", "bbox",
        F.col("datasets.dataset_id").cast("array<bigint>").alias("dataset_ids"), F.current_timestamp().alias("published_at"), F.array(event).cast(f"array<{EVENT}>").alias("events"),
    )
    table = publications(spark, target)

    def merged(old: DataFrame, news: DataFrame) -> DataFrame:
        kept = old.join(news.select("version_id"), "version_id", "left_anti")
        earlier = old.select("version_id", F.col("events").alias("earlier"))
        whole = news.join(earlier, "version_id", "left").withColumn("events", F.concat(F.coalesce("earlier", F.expr(f"CAST(array() AS array<{EVENT}>)")), "events")).drop("earlier")
        return kept.unionByName(whole)

    table.merge(materialise(new, "publications"), table.next_epoch(), merged)
    now = table.read().withColumnRenamed("status", "_status")
    return judged.select(F.col("version_id").cast("bigint").alias("version_id"), "ok", F.col("blocked.dataset_id").alias("blocked")).join(now, "version_id", "left").withColumn("status", F.when(F.col("ok"), F.col("_status")).otherwise("blocked")).drop("ok", "_status")


def published_datasets(spark: SparkSession, target: str) -> DataFrame:
    """version_id, dataset_id of what is published now."""
    return publications(spark, target).read().select("version_id", F.explode("dataset_ids").alias("dataset_id")).distinct()


def read_tile(spark: SparkSession, target: str, version_id, z: int, x: int, y: int) -> DataFrame:
    """One tile's rows (chunks) in the version's current publication; version and zoom prune partitions."""
    found = publications(spark, target).read().where(F.col("version_id") == version_id).select("data_path").head()
    if found is None:
        raise LookupError(f"version {version_id} is not published")
    return spark.read.parquet(found.data_path).where((F.col("version_id") == version_id) & (F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y))


def snapshot(versions: DataFrame, datasets: DataFrame, publications: DataFrame) -> DataFrame:
    """version_id, datasets, n_publications, manifests available, state, limitations."""
    d = datasets.groupBy("version_id").agg(F.sort_array(F.collect_list("dataset_name")).alias("datasets"))
    p = publications.groupBy("version_id").agg(F.count(F.lit(1)).alias("n_publications"), F.count_if(F.col("manifest").isNotNull()).alias("manifests"))
    j = versions.join(d, "version_id", "left").join(p, "version_id", "left").fillna({"n_publications": 0, "manifests": 0})
    state = F.when(F.col("n_publications") == 0, "unpublished").when(F.col("manifests") == F.col("n_publications"), "available").when(F.col("manifests") > 0, "partial").otherwise("unavailable")
    limits = F.array_compact(F.array(F.when(F.col("datasets").isNull(), "no_datasets"), F.when(F.col("n_publications") == 0, "not_published"), F.when(F.col("manifests") < F.col("n_publications"), "manifest_missing")))
    return j.select("version_id", F.size(F.coalesce("datasets", F.array().cast("array<string>"))).alias("n_datasets"), "n_publications", state.alias("state"), limits.alias("limitations"))


def contract_violations(rows: DataFrame, required: list[str], id_col: str, distance: str | None = None) -> DataFrame:
    """id, violation: required text that is missing, a distance that isn't finite or is negative, an id met twice."""
    rows = rows.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(id_col)) > 1)
    tests = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", f"missing:{c}") for c in required] + [F.when(F.col("_many"), "duplicate_id")]
    if distance:
        d = F.col(distance)
        tests.append(F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")) | (d < 0), "bad_distance"))
    return rows.withColumn("violation", F.explode(F.array_compact(F.array(*tests)))).select(id_col, "violation")
