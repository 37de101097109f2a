"""Files: scans, content addresses, format sniffing, GeoJSON and JavaScript-wrapped GeoJSON, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.urls import sanitize_filename


def scan_files(spark: SparkSession, root: str, globs: tuple[str, ...] = ("*",)) -> DataFrame:
    """path, modificationTime, length, content of the files under root that match any pattern, at any depth."""
    out = None
    for g in globs:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", g).load(root)
        out = df if out is None else out.union(df)
    return out.dropDuplicates(["path"]) if len(globs) > 1 else out


def stream_files(spark: SparkSession, root: str, glob: str = "*"):
    """New files as they come (run with the availableNow trigger to pick up what is there)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)


def pick_up(spark: SparkSession, root: str, target: str, checkpoint: str, glob: str = "*") -> None:
    """Files under root that no earlier call with this checkpoint has taken: path, sha256, size and pass of each are added to
    target. Progress is stored after each batch, so a call that broke off goes on where it was, and no file is listed twice. Files without a byte
    are not listed: Spark's file stream passes them over."""

    def listed(batch: DataFrame, epoch: int) -> None:
        found = batch.select("path", F.sha2("content", 256).alias("sha256"), "length")
        found.write.mode("overwrite").parquet(f"{target}/pass={epoch}")  # a batch that comes again is written over

    stream_files(spark, root, glob).writeStream.foreachBatch(listed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def content_address(content: Column, name: Column) -> Column:
    """struct(sha256, size, storage_key)."""
    sha = F.sha2(content, 256)
    return F.struct(sha.alias("sha256"), F.octet_length(content).cast("bigint").alias("size"), F.concat_ws("/", F.lit("sha256"), F.substring(sha, 1, 2), sha, sanitize_filename(name)).alias("storage_key"))


#: First bytes (hex) and the format they mean.
MAGIC = (("25504446", "pdf"), ("504B0304", "zip"), ("53514C69746520666F726D6174203300", "sqlite"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("4143313", "dwg"), ("1F8B", "gzip"))
_JS = r"(?s)^\s*(?:var|let|const)\s+[A-Za-z_$][\w$]*\s*=\s*(\{.*\})\s*;?\s*$"


def sniff_format(content: Column, name: Column) -> Column:
    """By first bytes, then by extension; SQLite is a GeoPackage when named so, JSON GeoJSON when it says so."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.substring(content.cast("string"), 1, 2000)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(head.startswith("53514C697465") & (ext == "gpkg"), "gpkg")
    for magic, kind in MAGIC:
        out = out.when(head.startswith(magic), kind)
    out = out.when(text.rlike(r'^\s*\{') & text.rlike(r'"type"\s*:\s*"Feature'), "geojson").when(text.rlike(r"^\s*(var|let|const)\s+\w+\s*=\s*\{"), "js_geojson").when(text.rlike(r"^\s*[\{\[]"), "json")
    return out.when(text.rlike(r"(?i)^\s*<(!doctype html|html)"), "html").when(text.rlike(r"^\s*<\?xml|^\s*<\w+"), "xml").when(ext != "", ext).otherwise("unknown")


def unwrap_js(text: Column) -> Column:
    """The FeatureCollection that a script assigns to a variable; null when it is none or its features are no list."""
    body = F.nullif(F.regexp_extract(text, _JS, 1), F.lit(""))
    kind = F.get_json_object(body, "$.type")
    listed = F.trim(F.get_json_object(body, "$.features")).startswith("[")
    return F.when((kind == "FeatureCollection") & listed, body)


def read_geojson(rows: DataFrame, text: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, fid, geom, properties (map of JSON text values) of a FeatureCollection; features without geometry stay."""
    f = rows.select(*keep, F.posexplode(F.from_json(text, "features array<string>")["features"]).alias("fid", "f"))
    return f.select(*keep, "fid", G.from_geojson(F.get_json_object("f", "$.geometry")).alias("geom"), F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"))


#: What happens to a staged format. rejected formats get a review task of that priority.
HANDLERS = {"pdf": "document", "geojson": "vector", "js_geojson": "vector", "gpkg": "vector", "tiff": "raster", "zip": "archive"}
REJECTED = {"dwg": 80}


def dispatch(staged: DataFrame, fmt: str = "format") -> DataFrame:
    """Adds handler (document, vector, raster, archive, skipped or rejected) and the review task's priority if any."""
    handler = F.when(F.col(fmt).isin(*REJECTED), "rejected")
    for kind, name in HANDLERS.items():
        handler = handler.when(F.col(fmt) == kind, name)
    task = F.create_map(*[F.lit(x) for p in REJECTED.items() for x in p])[F.col(fmt)]
    return staged.withColumn("handler", handler.otherwise("skipped")).withColumn("task_priority", task)


def register_rasters(rasters: DataFrame) -> DataFrame:
    """rasters(artifact_id, georeferenced, grp) -> level, task_priority, grp: a plain scan awaits georeferencing."""
    geo = F.col("georeferenced")
    return rasters.select("artifact_id", F.when(geo, "official_raster").otherwise("reference_approximate").alias("derivation_level"), F.when(~geo, 50).alias("task_priority"), F.coalesce("grp", F.lit("other")).alias("grp"))
