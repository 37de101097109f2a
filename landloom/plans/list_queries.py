"""Queries on lists, lookups, published tiles and stream upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import dedupe, georef, listing, publish
from ..storage import new_path
from .base import query, relation, table
from .geo_queries import _COVER, _JOBS, _gcps
from .registry_queries import _tasks


@query("document_list", "SELECT doc_id, lang FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 50 OFFSET 10")
def document_list(spark, sf):
    d = listing.filtered(table(spark, sf, "documents"), equal={"lang": "fr", "source": None})
    return listing.paged(d, ["doc_id"], 10).select("doc_id", "lang")


@query("unit_list", "SELECT n_nationkey AS unit_id, n_name AS name FROM nation WHERE n_regionkey = 2 AND contains(lower(n_name), 'a') ORDER BY n_name, n_nationkey LIMIT 50")
def unit_list(spark, sf):
    return listing.paged(listing.filtered(table(spark, sf, "nation"), {"n_regionkey": 2}, {"n_name": "A"}), ["n_name", "n_nationkey"]).select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("name"))


@query("source_list", "SELECT source_id, priority FROM sources WHERE enabled AND jurisdiction = 'BUILDING' ORDER BY priority, source_key LIMIT 50")
def source_list(spark, sf):
    return listing.paged(listing.filtered(relation(spark, sf, "sources"), {"enabled": True, "jurisdiction": "BUILDING"}), ["priority", "source_key"]).select("source_id", "priority")


@query("change_list", "SELECT event_id, source_id FROM observations WHERE outcome = 'error' AND source_id % 3 = 0 ORDER BY ts DESC, event_id DESC LIMIT 100")
def change_list(spark, sf):
    o = listing.filtered(relation(spark, sf, "observations"), {"outcome": "error"}).where("source_id % 3 = 0")
    return listing.paged(o, [F.desc("ts"), F.desc("event_id")], limit=100).select("event_id", "source_id")


@query("task_list", "SELECT conv_id * 100 + turn AS task_id FROM conversations WHERE role <> 'user' AND turn % 3 = 1 ORDER BY 1 LIMIT 20 OFFSET 5")
def task_list(spark, sf):
    return listing.paged(listing.filtered(_tasks(spark, sf), {"status": "done", "priority": 1}), ["task_id"], 5, 20).select("task_id")


@query("dataset_detail", "SELECT c_nationkey AS dataset_id, least(count(*), 20) AS n_shown, min(c_custkey) AS first_id FROM customer GROUP BY c_nationkey")
def dataset_detail(spark, sf):
    d = table(spark, sf, "nation").select(F.col("n_nationkey").alias("dataset_id"))
    r = listing.nested(d, "dataset_id", table(spark, sf, "customer"), "c_nationkey", ["c_name"], ["c_custkey"], "observations", most=20).where("observations IS NOT NULL")
    return r.select("dataset_id", F.size("observations").cast("bigint").alias("n_shown"), F.col("observations")[0]["c_custkey"].alias("first_id"))


@query("unit_detail", "SELECT n_nationkey AS unit_id, count(c_custkey) AS features, round(min(102 + (c_custkey * 7919 % 10000) / 1000.0::DOUBLE - (c_custkey % 7 + 1) / 1000.0::DOUBLE), 6) AS minx FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def unit_detail(spark, sf):
    f = relation(spark, sf, "features").groupBy("layer_id").agg(F.count(F.lit(1)).alias("features"), F.round(F.min("minx"), 6).alias("minx"))
    return table(spark, sf, "nation").join(f, F.col("n_nationkey") == F.col("layer_id"), "left").select(F.col("n_nationkey").alias("unit_id"), F.coalesce("features", F.lit(0)).alias("features"), "minx")


@query("run_detail", "SELECT user_id AS run_id, count(*) AS n, least(count(*), 50) AS shown FROM events GROUP BY user_id")
def run_detail(spark, sf):
    e = table(spark, sf, "events")
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
    return listing.nested(runs, "run_id", e, "user_id", ["event_type"], ["ts", "event_id"], "events", most=50).select("run_id", "n", F.size("events").cast("bigint").alias("shown"))


@query("tile_read", f"SELECT count(*) AS n, min(id) AS first_id FROM ({_COVER}) WHERE z = 6 AND x = 50 AND y = 29")
def tile_read(spark, sf):
    """The tile table written, then one tile read from its partition."""
    f = relation(spark, sf, "features").withColumn("geom", G.box(*map(F.col, ("minx", "miny", "maxx", "maxy")))).select("id", "layer_id", "geom")
    d = relation(spark, sf, "datasets").withColumn("version_id", F.lit(1))
    path = new_path(spark, "appended")
    publish.publish(d, relation(spark, sf, "layers"), f, path, allow_unreviewed=True)
    t = publish.read_tile(spark, path, 1, 6, 50, 29)
    return t.select(F.explode("ids").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("georef_apply_other", "SELECT job_id, point_id, true AS near FROM (SELECT c_custkey // 12 AS job_id, CAST(c_custkey % 12 + 1 AS INTEGER) AS point_id, count(*) OVER (PARTITION BY c_custkey // 12) AS n FROM customer) WHERE n >= 6")
def georef_apply_other(spark, sf):
    g = _gcps(spark, sf, False)
    p = georef.apply_other(g, g.select("job_id", F.col("gcp_id").alias("point_id"), "px", "py"), "poly2")
    j = p.join(g.withColumnRenamed("gcp_id", "point_id"), ["job_id", "point_id"]).where("x IS NOT NULL")
    return j.select("job_id", "point_id", ((F.abs(F.col("x") - F.col("mx")) < 1e-6) & (F.abs(F.col("y") - F.col("my")) < 1e-6)).alias("near"))


@query("georef_status", f"SELECT job_id, CASE WHEN job_id % 4 = 0 THEN 'approved' WHEN n >= 3 THEN 'computed' ELSE 'draft' END AS status, job_id % 4 = 0 AS locked FROM {_JOBS}")
def georef_status(spark, sf):
    g = _gcps(spark, sf, False)
    jobs = g.select("job_id").distinct().withColumn("status", F.when(F.col("job_id") % 4 == 0, "approved").otherwise("draft"))
    return georef.job_status(jobs, georef.fit_affine(g))


@query("drop_copies", """WITH d AS (SELECT doc_id, v, sha256(text || CASE WHEN v = 3 AND doc_id % 3 = 0 THEN ' changed' ELSE '' END) AS digest FROM documents, (VALUES (1), (2), (3)) AS t(v)),
  e AS (SELECT doc_id * 10 + v AS version_id, coalesce(digest = lag(digest) OVER (PARTITION BY doc_id ORDER BY v), false) AS dup FROM d)
SELECT version_id FROM e GROUP BY version_id HAVING bool_and(dup)""")
def drop_copies(spark, sf):
    """Three versions of every document by the digest of its whole text."""
    changed = F.when((F.col("v") == 3) & (F.col("doc_id") % 3 == 0), " changed").otherwise("")
    d = table(spark, sf, "documents").withColumn("v", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("doc_id", "source", "v", (F.col("doc_id") * 10 + F.col("v")).alias("version_id"), F.sha2(F.concat("text", changed), 256).alias("digest"))
    return dedupe.drop_copies(d, d.select("version_id").distinct(), record="doc_id", name="source", at="v", digest="digest", tie="version_id")[1]


@query("crawl_state_stream", "SELECT user_id AS source_id, max(ts) AS last_checked, count(*) FILTER (WHERE event_type = 'purchase') AS errors FROM events GROUP BY user_id")
def crawl_state_stream(spark, sf):
    """The event log through micro-batches, each one's source states appended and merged on reading."""
    from ..streaming.observe import crawl_state_stream as run

    path = new_path(spark, "upkeep")
    e = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    o = e.select(F.col("user_id").alias("source_id"), "ts", F.when(F.col("event_type") == "purchase", "error").otherwise("ok").alias("outcome"))
    q = run(o, lambda g, epoch: g.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    s = spark.read.parquet(f"{path}/out")
    return s.groupBy("source_id").agg(F.max("last_checked").alias("last_checked"), F.sum("errors").alias("errors"))


@query("sql_functions", "SELECT id, true AS same FROM features")
def sql_functions(spark, sf):
    """The overlay functions called from SQL text."""
    from ..functions.sql import register

    register(spark)
    f = relation(spark, sf, "features").withColumn("geom", G.box(*map(F.col, ("minx", "miny", "maxx", "maxy"))))
    return spark.sql("SELECT id, ll_symdiff_m2(geom.parts, geom.parts) < 1e-3 AND NOT ll_crosses_itself(geom.parts) AS same FROM {f}", f=f)
