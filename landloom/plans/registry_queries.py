"""Queries on sources, runs, observations, versions, coverage and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, properties
from ..functions import geometry as G
from ..operators import coverage, dedupe, diff, observe, publish, registry, versions
from ..storage import new_path
from .base import query, relation, table

_STATES = """SELECT user_id AS source_id, max(ts) AS last_checked, max(CASE WHEN event_type <> 'purchase' THEN ts END) AS last_success, count(*) AS checks FROM events GROUP BY user_id"""


def _states(spark, sf):
    ok = F.when(F.col("event_type") != "purchase", F.col("ts"))
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.max("ts").alias("last_checked"), F.max(ok).alias("last_success"), F.count(F.lit(1)).alias("checks"))


@query("source_status", f"SELECT source_id, source_key, enabled, coalesce(checks, 0) AS checks, CASE WHEN last_checked IS NULL THEN 'never_checked' WHEN last_success IS NULL THEN 'never_succeeded' ELSE 'fresh' END AS state FROM sources LEFT JOIN ({_STATES}) USING (source_id)")
def source_status(spark, sf):
    j = relation(spark, sf, "sources").join(_states(spark, sf), "source_id", "left")
    f = dates.freshness(F.col("last_checked"), F.col("last_success"), F.lit("2100-01-01").cast("timestamp"), F.lit("2024-03-01").cast("timestamp"))
    return j.select("source_id", "source_key", "enabled", F.coalesce("checks", F.lit(0)).alias("checks"), f["state"].alias("state"))


@query("freshness", f"SELECT source_id, CASE WHEN last_success IS NULL THEN 'never_succeeded' WHEN checks % 2 = 0 THEN 'overdue' ELSE 'fresh' END AS state, checks % 2 = 0 AS due FROM ({_STATES})")
def freshness(spark, sf):
    now = F.lit("2024-03-01").cast("timestamp")
    nxt = F.when(F.col("checks") % 2 == 0, F.lit("2024-01-01").cast("timestamp")).otherwise(F.lit("2100-01-01").cast("timestamp"))
    return _states(spark, sf).withColumn("f", dates.freshness(F.col("last_checked"), F.col("last_success"), nxt, now)).select("source_id", "f.state", "f.due")


@query("next_check", f"""SELECT source_id, epoch_us(last_checked)::DOUBLE / 1e6 + CASE WHEN checks % 3 = 0 THEN least(3600 * power(2, least(checks % 10, 6)), 21600) ELSE 3600 END
  + CAST('0x' || substr(md5(CAST(source_id AS VARCHAR)), 1, 8) AS BIGINT) % 301 AS at FROM ({_STATES})""")
def next_check(spark, sf):
    s = _states(spark, sf)
    at = dates.next_check_at(F.col("last_checked"), F.lit(3600), F.col("checks") % 3 == 0, F.col("checks") % 10, F.col("source_id"))
    return s.select("source_id", (F.unix_micros(at) / 1e6).alias("at"))


_FAIL = """SELECT source_id, count(*) FILTER (WHERE outcome = 'error' AND (last IS NULL OR (ts, event_id) > last)) AS failures, count(*) AS runs FROM (
  SELECT *, max(CASE WHEN outcome = 'ok' THEN (ts, event_id) END) OVER (PARTITION BY source_id) AS last FROM observations) GROUP BY source_id"""


def _failures(spark, sf):
    return observe.consecutive_failures(relation(spark, sf, "observations").withColumn("ok", F.col("outcome") == "ok"))


@query("consecutive_failures", _FAIL)
def consecutive_failures(spark, sf):
    return _failures(spark, sf).select("source_id", "failures", "runs")


@query("health", f"SELECT source_id, CASE WHEN source_id % 11 = 0 THEN 'disabled' WHEN source_id % 13 = 0 THEN 'blocked' WHEN failures >= 3 THEN 'failing' WHEN failures > 0 THEN 'degraded' WHEN runs % 5 = 0 THEN 'needs_review' WHEN runs % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS health FROM ({_FAIL})")
def health(spark, sf):
    k = F.col("source_id")
    h = dates.health(k % 11 != 0, k % 13 == 0, F.when(F.col("failures") > 0, "failed").otherwise("succeeded"), F.col("failures"), F.lit(False), F.col("runs") % 5 == 0, F.col("runs") % 2 == 0)
    return _failures(spark, sf).select("source_id", h.alias("health"))


@query("run_status", """WITH r AS (SELECT source_id, event_type, CASE source_id % 7 WHEN 3 THEN 'blocked: robots' WHEN 5 THEN 'timeout' END AS fatal, count(*) FILTER (WHERE sha = 0) AS errors,
  count(*) FILTER (WHERE sha > 1) AS discovered, count(*) FILTER (WHERE sha > 2) AS downloaded FROM observations GROUP BY source_id, event_type)
SELECT source_id, event_type, errors, discovered, downloaded, CASE WHEN fatal IS NOT NULL AND fatal NOT LIKE 'blocked:%' THEN 'failed' WHEN errors > 0 AND downloaded = 0 AND discovered = 0 THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM r""")
def run_status(spark, sf):
    g = relation(spark, sf, "observations").groupBy("source_id", "event_type").agg(F.count_if(F.col("sha") == 0).alias("errors"), F.count_if(F.col("sha") > 1).alias("discovered"), F.count_if(F.col("sha") > 2).alias("downloaded"))
    fatal = F.when(F.col("source_id") % 7 == 3, "blocked: robots").when(F.col("source_id") % 7 == 5, "timeout")
    return g.withColumn("status", observe.run_status(F.col("errors"), F.col("discovered"), F.col("downloaded"), fatal))


@query("active_resources", "SELECT source_id, count(DISTINCT resource_key) FILTER (WHERE last_ok) AS active FROM (SELECT source_id, resource_key, arg_max(outcome = 'ok', (ts, event_id)) AS last_ok FROM observations GROUP BY 1, 2) GROUP BY source_id")
def active_resources(spark, sf):
    r = relation(spark, sf, "observations").groupBy("source_id", "resource_key").agg(F.max_by(F.col("outcome") == "ok", F.struct("ts", "event_id")).alias("ok"))
    return r.groupBy("source_id").agg(F.count_if("ok").alias("active"))


_DUE = "SELECT source_id, host, priority FROM sources WHERE enabled AND source_id % 3 <> 0 AND source_id % 5 <> 0"


def _due(spark, sf):
    s = relation(spark, sf, "sources")
    now = F.lit("2024-03-01").cast("timestamp")
    later = F.lit("2100-01-01").cast("timestamp")
    states = s.select("source_id", F.when(F.col("source_id") % 3 == 0, later).alias("next_check_at"), F.when(F.col("source_id") % 5 == 0, later).alias("locked_until"))
    return observe.due_sources(s, states, now), s, states, now


@query("due_sources", _DUE)
def due_sources(spark, sf):
    return _due(spark, sf)[0].select("source_id", "host", "priority")


@query("host_load", "SELECT host, count(*) AS load FROM sources WHERE source_id % 5 = 0 GROUP BY host")
def host_load(spark, sf):
    _, s, states, now = _due(spark, sf)
    return observe.host_load(states.join(s.select("source_id", "host"), "source_id"), now)


@query("scheduler_tick", f"""WITH d AS ({_DUE}), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority, source_id) <= 2 AS fits FROM d),
h AS (SELECT * FROM n WHERE fits ORDER BY priority, source_id LIMIT 20), e AS (SELECT count(*) AS chosen, max((priority, source_id)) AS last FROM h)
SELECT source_id, CASE WHEN fits AND (chosen < 20 OR (priority, source_id) <= last) THEN 'enqueued' WHEN chosen < 20 OR (priority, source_id) <= last THEN 'skipped_host_limit' ELSE 'later' END AS outcome FROM n, e""")
def scheduler_tick(spark, sf):
    due = _due(spark, sf)[0].select("source_id", "host", "priority")
    return observe.tick(due, due.limit(0).groupBy("host").agg(F.count(F.lit(1)).alias("load")))


@query("classify_observations", "SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'seen_new' WHEN lag(sha) OVER w = sha THEN 'unchanged' ELSE 'changed' END AS state FROM observations WINDOW w AS (PARTITION BY source_id, resource_key ORDER BY ts, event_id)")
def classify_observations(spark, sf):
    return observe.classify(relation(spark, sf, "observations"), ["source_id", "resource_key"]).select("event_id", "state")


_HALVES = """o AS (SELECT source_id, resource_key, arg_max(sha, event_id) AS sha, max(event_id) % 4 AS url FROM observations WHERE event_id % 2 = 0 GROUP BY 1, 2),
n AS (SELECT source_id, resource_key, arg_max(sha, event_id) AS sha, max(event_id) % 4 // 2 * 2 AS url, arg_max(outcome, event_id) AS outcome FROM observations WHERE event_id % 2 = 1 GROUP BY 1, 2)"""


def _halves(spark, sf):
    o = relation(spark, sf, "observations")
    old = o.where("event_id % 2 = 0").groupBy("source_id", "resource_key").agg(F.max_by("sha", "event_id").alias("sha"), (F.max("event_id") % 4).alias("url")).withColumn("meta", F.lit("m")).withColumn("status", F.when(F.col("source_id") % 4 == 0, "disappeared").otherwise("active"))
    new = o.where("event_id % 2 = 1").groupBy("source_id", "resource_key").agg(F.max_by("sha", "event_id").alias("sha"), (F.floor(F.max("event_id") % 4 / 2) * 2).alias("url"), F.max_by("outcome", "event_id").alias("outcome")).withColumn("meta", F.lit("m"))
    return old, new


@query("observation_cycle", f"""WITH {_HALVES} SELECT source_id, resource_key, CASE WHEN n.outcome = 'ok' THEN n.sha ELSE o.sha END AS sha, CASE WHEN n.outcome IS NOT NULL THEN 'active' ELSE 'disappeared' END AS status,
  CASE WHEN o.url IS NULL THEN 1 ELSE 0 END + CASE WHEN o.url IS NOT NULL AND n.outcome IS NOT NULL AND source_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN o.url <> n.url THEN 1 ELSE 0 END
  + CASE WHEN n.outcome = 'ok' AND o.sha <> n.sha THEN 1 ELSE 0 END + CASE WHEN n.outcome IS NULL AND source_id % 4 <> 0 THEN 1 ELSE 0 END AS n_events FROM o FULL JOIN n USING (source_id, resource_key)""")
def observation_cycle(spark, sf):
    return observe.observation_cycle(*_halves(spark, sf), complete=True).select("source_id", "resource_key", "sha", "status", F.size("events").alias("n_events"))


@query("change_events", f"""WITH {_HALVES}, j AS (SELECT source_id, o.url AS ou, n.url AS nu, o.sha AS os, n.sha AS ns, n.outcome FROM o FULL JOIN n USING (source_id, resource_key))
SELECT change_type, count(*) AS n FROM (SELECT 'added' AS change_type FROM j WHERE ou IS NULL UNION ALL SELECT 'reappeared' FROM j WHERE ou IS NOT NULL AND outcome IS NOT NULL AND source_id % 4 = 0 UNION ALL SELECT 'url_changed' FROM j WHERE ou <> nu
  UNION ALL SELECT 'checksum_changed' FROM j WHERE outcome = 'ok' AND os <> ns UNION ALL SELECT 'disappeared' FROM j WHERE outcome IS NULL AND source_id % 4 <> 0) GROUP BY change_type""")
def change_events(spark, sf):
    return observe.change_events(observe.observation_cycle(*_halves(spark, sf), complete=True)).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query("disappeared", f"WITH {_HALVES} SELECT o.source_id, o.resource_key FROM o ANTI JOIN n USING (source_id, resource_key) WHERE o.source_id % 4 <> 0 AND o.source_id % 3 <> 0")
def disappeared(spark, sf):
    old, new = _halves(spark, sf)
    runs = old.select("source_id").distinct().withColumn("complete", F.col("source_id") % 3 != 0)
    return observe.disappeared(old, new, runs).select("source_id", "resource_key")


@query("recent_per_source", "SELECT source_id, event_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM observations QUALIFY rank <= 10")
def recent_per_source(spark, sf):
    return observe.recent(relation(spark, sf, "observations"), "source_id", "ts", 10, "event_id").select("source_id", "event_id", "rank")


@query("recent_changes", "SELECT event_id, source_id FROM observations WHERE sha > 0 AND event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_changes(spark, sf):
    return relation(spark, sf, "observations").where("sha > 0 AND event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "source_id")


@query("failures_summary", "SELECT event_type, outcome, count(*) AS n, max(ts) AS last FROM observations WHERE outcome = 'error' OR sha = 0 GROUP BY event_type, outcome")
def failures_summary(spark, sf):
    return relation(spark, sf, "observations").where("outcome = 'error' OR sha = 0").groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


@query("stage_artifacts", """SELECT doc_id, sha256(text) AS sha, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0) THEN 'downloaded' ELSE 'unchanged' END AS event FROM documents""")
def stage_artifacts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return observe.stage(d, d.where("doc_id % 5 = 0"))


@query("needs_review", "SELECT source, count(*) AS pending FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 AND quality = 0 GROUP BY source")
def needs_review(spark, sf):
    return table(spark, sf, "labels").where("toxic = 0 AND quality = 0").join(table(spark, sf, "documents"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("pending"))


# coverage: nations are units, customers records, orders versions, line items documents, a tenth of orders datasets

_COV = """u AS (SELECT n_nationkey AS unit_id, n_name AS unit_name FROM nation), r AS (SELECT c_custkey AS record_id, c_nationkey AS unit_id FROM customer WHERE c_nationkey % 6 <> 5),
v AS (SELECT o_orderkey AS version_id, o_custkey AS record_id, CAST(o_orderdate AS DATE) AS effective_from FROM orders), d AS (SELECT l_orderkey AS version_id FROM lineitem WHERE l_linenumber = 1),
s AS (SELECT version_id AS dataset_id, version_id, CASE WHEN version_id % 3 = 0 THEN 'raster' ELSE 'vector' END AS dataset_type, CASE WHEN version_id % 50 = 0 THEN 'approved' ELSE 'pending' END AS review_status, CASE WHEN version_id % 4 = 0 THEN 'official_vector' ELSE 'derived_machine_unreviewed' END AS derivation_level FROM v WHERE version_id % 10 = 0),
src AS (SELECT c_custkey AS source_id, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS unit_id, CASE WHEN c_custkey % 3 = 1 THEN n_name END AS jurisdiction FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0),
su AS (SELECT u.unit_id, source_id FROM u JOIN src ON u.unit_id = src.unit_id OR u.unit_name = src.jurisdiction)"""


def _cov(spark, sf):
    u = table(spark, sf, "nation").select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("unit_name"))
    c = table(spark, sf, "customer")
    r = c.where("c_nationkey % 6 <> 5").select(F.col("c_custkey").alias("record_id"), F.col("c_nationkey").alias("unit_id"))
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("record_id"), F.to_date("o_orderdate").alias("effective_from"))
    d = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("version_id"))
    k = F.col("version_id")
    s = v.where(k % 10 == 0).select(k.alias("dataset_id"), "version_id", F.when(k % 3 == 0, "raster").otherwise("vector").alias("dataset_type"), F.when(k % 50 == 0, "approved").otherwise("pending").alias("review_status"), F.when(k % 4 == 0, "official_vector").otherwise("derived_machine_unreviewed").alias("derivation_level"))
    src = c.where("c_custkey % 2 = 0").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("unit_id"), F.when(F.col("c_custkey") % 3 == 1, F.col("n_name")).alias("jurisdiction"))
    return u, src, r, v, d, s


@query("coverage_summary", f"""WITH {_COV}, vu AS (SELECT version_id, unit_id FROM v JOIN r USING (record_id)),
c AS (SELECT u.unit_id, (SELECT count(*) FROM su WHERE su.unit_id = u.unit_id) AS source_count, (SELECT count(*) FROM d JOIN vu USING (version_id) WHERE vu.unit_id = u.unit_id) AS document_count,
 (SELECT count(*) FROM s JOIN vu USING (version_id) WHERE vu.unit_id = u.unit_id) AS dataset_count, (SELECT count(*) FROM s JOIN vu USING (version_id) WHERE vu.unit_id = u.unit_id AND review_status = 'approved') AS reviewed_count FROM u)
SELECT *, CASE WHEN reviewed_count > 0 THEN 'reviewed' WHEN dataset_count > 0 THEN 'gis_available' WHEN document_count > 0 THEN 'documents_indexed' WHEN source_count > 0 THEN 'source_discovered' ELSE 'no_source_discovered' END AS state FROM c""")
def coverage_summary(spark, sf):
    u, src, r, v, d, s = _cov(spark, sf)
    return coverage.summary(u, src, r, v, d, s)


@query("coverage_detail", f"""WITH {_COV}, vu AS (SELECT v.*, unit_id FROM v JOIN r USING (record_id)), ds AS (SELECT s.*, unit_id FROM s JOIN vu USING (version_id))
SELECT u.unit_id, (SELECT count(*) FROM su WHERE su.unit_id = u.unit_id) AS sources, (SELECT count(*) FROM r WHERE r.unit_id = u.unit_id) AS records, (SELECT count(*) FROM vu WHERE vu.unit_id = u.unit_id) AS versions,
 (SELECT min(effective_from) FROM vu WHERE vu.unit_id = u.unit_id) AS earliest, (SELECT max(effective_from) FROM vu WHERE vu.unit_id = u.unit_id) AS latest,
 (SELECT count(*) FROM ds WHERE ds.unit_id = u.unit_id AND dataset_type = 'vector') AS vector, (SELECT count(*) FROM ds WHERE ds.unit_id = u.unit_id AND dataset_type = 'raster') AS raster,
 (SELECT count(*) FROM ds WHERE ds.unit_id = u.unit_id AND derivation_level LIKE 'official%') AS official, (SELECT count(*) FROM ds WHERE ds.unit_id = u.unit_id AND derivation_level NOT LIKE 'official%') AS derived,
 (SELECT count(*) FROM ds WHERE ds.unit_id = u.unit_id AND dataset_id % 20 = 0) AS pending_tasks FROM u""")
def coverage_detail(spark, sf):
    u, src, r, v, _, s = _cov(spark, sf)
    tasks = s.where("dataset_id % 20 = 0").select(F.lit("dataset").alias("target_type"), F.col("dataset_id").alias("target_id"), F.lit("pending").alias("status"))
    return coverage.detail(u, src, r, v, s, tasks)


@query("coverage_freshness", f"SELECT n_nationkey AS unit_id, max(last_success) AS last_success, bool_or(checks % 2 = 0) AS any_due FROM nation LEFT JOIN sources ON unit_id = n_nationkey LEFT JOIN ({_STATES}) USING (source_id) GROUP BY n_nationkey")
def coverage_freshness(spark, sf):
    u = table(spark, sf, "nation").select(F.col("n_nationkey").alias("unit_id"))
    states = _states(spark, sf).withColumn("due", F.col("checks") % 2 == 0).withColumn("health", F.lit("ok"))
    return coverage.freshness(u, relation(spark, sf, "sources"), states).select("unit_id", "last_success", "any_due")


@query("data_class", "SELECT o_custkey % 700 AS record_id, CASE WHEN bool_and(c_custkey % 9 = 0) THEN 'synthetic' WHEN bool_or(c_custkey % 9 = 0) THEN 'mixed' ELSE 'official' END AS data_class FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def data_class(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 700).alias("record_id"), F.col("o_custkey").alias("source_id"))
    j = o.join(relation(spark, sf, "sources").select("source_id", "source_key"), "source_id")
    return coverage.data_class(j.where("source_id % 2 = 0").unionByName(j.where("source_id % 2 = 1")), j)


@query("worst_level", "SELECT layer_id % 3 AS grp, CASE max(CASE derivation_level WHEN 'official_vector' THEN 1 WHEN 'official_raster' THEN 2 WHEN 'official_document' THEN 3 WHEN 'derived_human_reviewed' THEN 4 WHEN 'derived_machine_reviewed' THEN 5 WHEN 'derived_machine_unreviewed' THEN 6 ELSE 7 END) WHEN 1 THEN 'official_vector' WHEN 2 THEN 'official_raster' WHEN 3 THEN 'official_document' WHEN 4 THEN 'derived_human_reviewed' WHEN 5 THEN 'derived_machine_reviewed' WHEN 6 THEN 'derived_machine_unreviewed' ELSE 'reference_approximate' END AS worst_level FROM layers JOIN datasets USING (dataset_id) GROUP BY 1")
def worst_level(spark, sf):
    j = relation(spark, sf, "layers").join(relation(spark, sf, "datasets"), "dataset_id").withColumn("grp", F.col("layer_id") % 3)
    return publish.worst_level(j, "grp")


@query("manifest", "SELECT dataset_id % 2 AS version_id, count(DISTINCT dataset_id) AS n_datasets, count(DISTINCT layer_id) AS n_layers, count(*) AS n_features, round(min(minx), 9) AS minx, round(max(maxy), 9) AS maxy FROM features JOIN layers USING (layer_id) JOIN datasets USING (dataset_id) GROUP BY 1")
def manifest(spark, sf):
    d = relation(spark, sf, "datasets").withColumn("version_id", F.col("dataset_id") % 2)
    findings = d.select("version_id", F.lit("error").alias("severity"), F.lit("QH-X").alias("rule_code"))
    m = publish.manifest(d, relation(spark, sf, "layers"), relation(spark, sf, "features"), findings)
    total = lambda f: F.aggregate("datasets", F.lit(0).cast("bigint"), lambda n, x: n + x[f])
    return m.select("version_id", F.size("datasets").cast("bigint").alias("n_datasets"), total("layers").alias("n_layers"), total("features").alias("n_features"), F.round(F.col("bbox")[0], 9).alias("minx"), F.round(F.col("bbox")[3], 9).alias("maxy"))


@query("publish_gate", "SELECT dataset_id % 2 AS version_id, count(*) AS dataset_count, count(*) FILTER (WHERE NOT (derivation_level LIKE 'official%' OR review_status = 'approved')) AS n_blocked FROM datasets GROUP BY 1")
def publish_gate(spark, sf):
    g = publish.gate(relation(spark, sf, "datasets").withColumn("version_id", F.col("dataset_id") % 2))
    return g.select("version_id", "dataset_count", F.size("blocked").cast("bigint").alias("n_blocked"))


_TILES = """t AS (SELECT f.*, dataset_id % 2 AS version_id FROM features f JOIN layers USING (layer_id) JOIN datasets USING (dataset_id)), c AS (SELECT version_id, id, z, x, unnest(range(CAST(floor((1 - ln(tan(radians(maxy)) + 1 / cos(radians(maxy))) / pi()) / 2 * power(2, z)) AS BIGINT), CAST(floor((1 - ln(tan(radians(miny)) + 1 / cos(radians(miny))) / pi()) / 2 * power(2, z)) AS BIGINT) + 1)) AS y
  FROM (SELECT *, unnest(range(CAST(floor((minx + 180) / 360 * power(2, z)) AS BIGINT), CAST(floor((maxx + 180) / 360 * power(2, z)) AS BIGINT) + 1)) AS x FROM (SELECT *, unnest(range(0, 15)) AS z FROM t)))"""


@query("publish_version", f"""WITH {_TILES}, g AS (SELECT dataset_id % 2 AS version_id, bool_and(derivation_level LIKE 'official%' OR review_status = 'approved') AS ok, count(*) AS n, count(*) FILTER (WHERE NOT (derivation_level LIKE 'official%' OR review_status = 'approved')) AS n_blocked FROM datasets GROUP BY 1),
s AS (SELECT version_id, count(DISTINCT (z, x, y)) AS tile_count, count(*) AS feature_count FROM c GROUP BY 1), b AS (SELECT version_id, round(min(minx), 6) AS minx, round(max(maxy), 6) AS maxy, count(*) AS in_manifest FROM t GROUP BY 1)
SELECT version_id, CASE WHEN ok THEN 'published' ELSE 'blocked' END AS status, n_blocked, CASE WHEN ok THEN tile_count END AS tile_count, CASE WHEN ok THEN feature_count END AS feature_count, CASE WHEN ok THEN minx END AS minx, CASE WHEN ok THEN maxy END AS maxy,
  CASE WHEN ok THEN in_manifest END AS in_manifest, CASE WHEN ok THEN n END AS n_published, CASE WHEN ok THEN 2 END AS n_events, CASE WHEN ok THEN true END AS same_checksum, CASE WHEN ok THEN 14 END AS max_zoom FROM g JOIN s USING (version_id) JOIN b USING (version_id)""")
def publish_version(spark, sf):
    """All features to zoom 14, twice: the second publication takes the first one's place, with the same content."""
    f = relation(spark, sf, "features").withColumn("geom", G.box(*map(F.col, ("minx", "miny", "maxx", "maxy")))).select("id", "layer_id", "geom")
    d, path = relation(spark, sf, "datasets").withColumn("version_id", F.col("dataset_id") % 2), new_path(spark, "published")
    for _ in range(2):
        found = publish.publish(d, relation(spark, sf, "layers"), f, path)
    flags = publish.published_datasets(spark, path).groupBy("version_id").agg(F.count(F.lit(1)).alias("n_published"))
    told = F.from_json("manifest", "datasets array<struct<features:bigint>>, checksum string")
    whole = F.aggregate(told["datasets"], F.lit(0).cast("bigint"), lambda n, x: n + x["features"])
    same = (F.size(F.array_distinct("events.output_hash")) == 1) & (told["checksum"] == F.col("checksum"))
    return found.join(flags, "version_id", "left").select(
        "version_id", "status", F.size("blocked").cast("bigint").alias("n_blocked"), "tile_count", "feature_count", F.round(F.col("bbox")[0], 6).alias("minx"), F.round(F.col("bbox")[3], 6).alias("maxy"), F.when(told.isNotNull(), whole).alias("in_manifest"),
        "n_published", F.when(F.col("events").isNotNull(), F.size("events")).alias("n_events"), same.alias("same_checksum"), "max_zoom",
    )


@query("metadata_snapshot", "SELECT o_orderkey AS version_id, o_orderkey % 3 AS n_datasets, o_orderkey % 2 AS n_publications, CASE WHEN o_orderkey % 2 = 0 THEN 'unpublished' WHEN o_orderkey % 5 = 0 THEN 'unavailable' ELSE 'available' END AS state FROM orders")
def metadata_snapshot(spark, sf):
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("version_id"))
    d = v.where("version_id % 3 > 0").select("version_id", F.explode(F.sequence(F.lit(1), F.col("version_id") % 3)).alias("k")).select("version_id", F.col("k").cast("string").alias("dataset_name"))
    p = v.where("version_id % 2 = 1").withColumn("manifest", F.when(F.col("version_id") % 5 != 0, F.lit("{}")))
    s = publish.snapshot(v, d, p)
    return s.select("version_id", F.col("n_datasets").cast("bigint").alias("n_datasets"), "n_publications", "state")


@query("metadata_contract", "SELECT id, violation FROM (SELECT id, CASE WHEN name IS NULL OR trim(name) = '' THEN 'missing:name' END AS violation FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE c_name END AS name FROM customer)) WHERE violation IS NOT NULL UNION ALL SELECT c_custkey, 'bad_distance' FROM customer WHERE c_custkey % 7 = 0")
def metadata_contract(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(1.0).alias("d"))
    return publish.contract_violations(c, ["name"], "id", "d")


# diffs and dedupe


def _layer(spark, sf, name):
    p = relation(spark, sf, name)
    return p.select(F.col("fkey").alias("key"), "class", G.box(F.col("minx"), F.col("miny"), F.col("minx") + F.col("w"), F.col("miny") + F.col("w")).alias("geom"), F.create_map(F.lit("brand"), F.col("brand"), F.lit("size"), F.col("size").cast("string")).alias("properties"), F.col("id").alias("ord"))


def _diff(spark, sf):
    return diff.diff(_layer(spark, sf, "old_parts"), _layer(spark, sf, "new_parts"))


_DIFF = "SELECT coalesce(o.fkey, n.fkey) AS fkey, o.fkey IS NULL AS added, n.fkey IS NULL AS removed, o.w <> n.w AS geom, o.class <> n.class AS class, o.size <> n.size OR o.brand <> n.brand AS props FROM old_parts o FULL JOIN new_parts n ON o.fkey = n.fkey"


@query("layer_diff", f"SELECT fkey, concat_ws(',', CASE WHEN added THEN 'added' END, CASE WHEN removed THEN 'removed' END, CASE WHEN geom THEN 'geometry_changed' END, CASE WHEN class THEN 'classification_changed' END, CASE WHEN props THEN 'properties_changed' END, CASE WHEN NOT (added OR removed OR geom OR class OR props) THEN 'unchanged' END) AS changes FROM ({_DIFF})")
def layer_diff(spark, sf):
    return _diff(spark, sf).select(F.col("key").alias("fkey"), F.concat_ws(",", "changes").alias("changes"))


@query("property_diff", "SELECT o.fkey, CAST(o.size AS VARCHAR) AS old_size, CAST(n.size AS VARCHAR) AS new_size FROM old_parts o JOIN new_parts n ON o.fkey = n.fkey WHERE o.size <> n.size")
def property_diff(spark, sf):
    d = _diff(spark, sf).where(F.map_contains_key("properties", "size"))
    return d.select(F.col("key").alias("fkey"), F.col("properties")["size"]["old"].alias("old_size"), F.col("properties")["size"]["new"].alias("new_size"))


@query("changeset_summary", f"SELECT count(*) FILTER (WHERE added) AS added, count(*) FILTER (WHERE removed) AS removed, count(*) FILTER (WHERE geom) AS geometry_changed, count(*) FILTER (WHERE class) AS classification_changed, count(*) FILTER (WHERE props) AS properties_changed, count(*) FILTER (WHERE NOT (added OR removed OR geom OR class OR props)) AS unchanged FROM (SELECT fkey, added, removed, coalesce(geom, false) AS geom, coalesce(class, false) AS class, coalesce(props, false) AS props FROM ({_DIFF}))")
def changeset_summary(spark, sf):
    return diff.changeset_summary(_diff(spark, sf)).drop("added_m2", "removed_m2", "modified_m2")


@query("changeset_areas")
def changeset_areas(spark, sf):
    return diff.changeset_summary(_diff(spark, sf))


@query("changeset_cache", "SELECT n_nationkey AS from_layer, n_nationkey + 1 AS to_layer FROM nation WHERE n_nationkey % 3 <> 0")
def changeset_cache(spark, sf):
    pairs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("from_layer"), (F.col("n_nationkey") + 1).alias("to_layer"))
    return diff.uncomputed(pairs, pairs.where("from_layer % 3 = 0"))


@query("land_use_pair", "SELECT dataset_id AS version_id, min(layer_id) AS layer_id FROM layers WHERE layer_id % 2 = 0 GROUP BY dataset_id")
def land_use_pair(spark, sf):
    ls = relation(spark, sf, "layers").select(F.col("dataset_id").alias("version_id"), "dataset_id", "layer_id", F.when(F.col("layer_id") % 2 == 0, "land_use").otherwise("transport").alias("grp"))
    return diff.layer_pairs(ls)


@query("semantic_dedupe", """WITH d AS (SELECT doc_id, v, sha256(text || CASE WHEN v = 2 AND doc_id % 3 = 0 THEN ' changed' ELSE '' END) AS digest FROM documents, (VALUES (1), (2)) AS t(v))
SELECT doc_id, v, coalesce(digest = lag(digest) OVER (PARTITION BY doc_id ORDER BY v), false) AS duplicate FROM d""")
def semantic_dedupe(spark, sf):
    """Two versions of every document, the second changed for some; digests of whole texts."""
    changed = F.when((F.col("v") == 2) & (F.col("doc_id") % 3 == 0), " changed").otherwise("")
    d = table(spark, sf, "documents").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))).select("doc_id", "source", "v", F.sha2(F.concat("text", changed), 256).alias("digest"))
    return dedupe.semantic_duplicates(d, "doc_id", "source", "v", "digest", "v").select("doc_id", "v", "duplicate")


@query("first_wins", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_wins(spark, sf):
    return dedupe.first_wins(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id")


# versions, units, tasks, lists


@query("version_resolve", "SELECT o_orderkey AS item_id, CASE WHEN o_custkey % 3 = 0 THEN o_custkey WHEN o_custkey % 3 = 1 THEN c.c_custkey END AS record_id, CASE WHEN o_custkey % 3 = 0 THEN 'title' WHEN o_custkey % 3 = 1 THEN 'code' ELSE 'new' END AS how FROM orders LEFT JOIN customer c ON c_custkey = o_custkey")
def version_resolve(spark, sf):
    k = F.col("o_custkey")
    incoming = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(k % 3 == 0, F.concat(F.lit("t"), k.cast("string"))).otherwise("none").alias("norm_title"), F.when(k % 3 == 1, F.concat(F.lit("c"), k.cast("string"))).alias("code"))
    records = table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("norm_title"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("code"))
    return versions.resolve_records(incoming, records)


@query("supersedes", "WITH v AS (SELECT version_id, record_id, decision, CASE WHEN version_id % 2 = 0 THEN concat('D', (version_id + 1) % 500) END AS prev FROM versions), f AS (SELECT record_id, decision, min(version_id) AS old FROM v GROUP BY 1, 2) SELECT v.version_id, CASE WHEN f.old <> v.version_id THEN f.old END AS supersedes_version_id, CASE WHEN f.old <> v.version_id THEN 'replacement' ELSE 'original' END AS kind FROM v LEFT JOIN f ON f.record_id = v.record_id AND f.decision = v.prev")
def supersedes(spark, sf):
    v = relation(spark, sf, "versions").select("version_id", "record_id", "decision", F.when(F.col("version_id") % 2 == 0, F.concat(F.lit("D"), ((F.col("version_id") + 1) % 500).cast("string"))).alias("supersedes_decision"))
    return versions.supersessions(v)


@query("version_lineage", "SELECT version_id, record_id, CAST(row_number() OVER w AS INTEGER) AS place, lag(version_id) OVER w AS previous_id FROM versions WINDOW w AS (PARTITION BY record_id ORDER BY effective_from NULLS LAST, version_id)")
def version_lineage(spark, sf):
    return versions.lineage(relation(spark, sf, "versions")).select("version_id", "record_id", "place", "previous_id")


@query("version_list", "SELECT record_id, max(effective_from) AS latest, min(effective_from) AS earliest, count(*) AS n FROM versions GROUP BY record_id")
def version_list(spark, sf):
    return relation(spark, sf, "versions").groupBy("record_id").agg(F.max("effective_from").alias("latest"), F.min("effective_from").alias("earliest"), F.count(F.lit(1)).alias("n"))


@query("admin_unit_match", "SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN n_nationkey + 1000 ELSE n_nationkey END AS unit_id FROM customer JOIN nation ON n_nationkey = c_nationkey")
def admin_unit_match(spark, sf):
    n = table(spark, sf, "nation")
    units = n.select(F.col("n_nationkey").alias("unit_id"), F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("code"), F.lower("n_name").alias("norm_name"), F.lit(None).cast("date").alias("valid_to")).union(n.select(F.col("n_nationkey") + 1000, F.concat(F.lit("D"), F.col("n_nationkey").cast("string")), F.lit("x"), F.lit("2020-01-01").cast("date"))).union(n.select(F.col("n_nationkey") + 2000, F.concat(F.lit("D"), F.col("n_nationkey").cast("string")), F.lit("x"), F.lit("2010-01-01").cast("date")))
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(k.alias("row_id"), F.lit("nowhere").alias("commune"), F.when(k % 3 == 0, F.concat(F.lit("D"), F.col("n_nationkey").cast("string"))).alias("district"), F.when(k % 3 == 1, F.concat(F.lit("P"), F.col("n_nationkey").cast("string"))).alias("province"), F.lower("n_name").alias("name"))
    return registry.match_units(rows, units, "row_id")


@query("admin_unit_upsert", "SELECT CAST(c_custkey AS VARCHAR) AS code, CASE WHEN c_custkey % 4 = 3 THEN 'kept' WHEN c_custkey % 4 = 0 THEN 'created' WHEN c_custkey % 4 = 1 THEN 'updated' ELSE 'unchanged' END AS action FROM customer")
def admin_unit_upsert(spark, sf):
    k = F.col("c_custkey")
    base = table(spark, sf, "customer").select(k, k.cast("string").alias("code"), F.when(k % 2 == 0, F.lit("2020-01-01").cast("date")).alias("valid_to"), F.col("c_name").alias("name"))
    new = base.where("c_custkey % 4 <> 3").withColumn("name", F.when(k % 4 == 1, F.lit("renamed")).otherwise(F.col("name"))).drop("c_custkey")
    return versions.upsert_units(base.where("c_custkey % 4 <> 0").drop("c_custkey"), new).select("code", "action")


@query("admin_unit_parents", "SELECT c_custkey AS ord, CASE WHEN c_custkey % 10 <> 1 AND c_custkey >= 1 THEN CAST(c_custkey - (c_custkey + 9) % 10 AS VARCHAR) END AS parent FROM customer")
def admin_unit_parents(spark, sf):
    k = F.col("c_custkey")
    u = table(spark, sf, "customer").select(k.alias("ord"), k.cast("string").alias("code"), F.when(k % 10 == 1, "province").otherwise("district").alias("level"))
    return versions.unit_parents(u).select("ord", "parent")


@query("record_list", "SELECT c_custkey AS record_id, c_name AS name, count(*) OVER () AS total FROM customer WHERE lower(c_name) LIKE '%1%' AND c_nationkey < 20 QUALIFY row_number() OVER (ORDER BY c_custkey) BETWEEN 51 AND 100")
def record_list(spark, sf):
    rows = table(spark, sf, "customer").where(F.col("c_name").ilike("%1%") & (F.col("c_nationkey") < 20)).select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name"))
    return publish.page(rows, ["record_id"], 50, 50)


@query("record_detail", "SELECT c_custkey AS record_id, c_name AS name, count(o_orderkey) AS n_versions, max(CAST(o_orderdate AS DATE)) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def record_detail(spark, sf):
    v = relation(spark, sf, "versions").groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("effective_from", "version_id"))).alias("versions"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name")).join(v, "record_id", "left")
    return c.select("record_id", "name", F.coalesce(F.size("versions"), F.lit(0)).cast("bigint").alias("n_versions"), F.element_at("versions", -1)["effective_from"].alias("latest"))


_TASKS = "SELECT conv_id * 100 + turn AS task_id, CASE WHEN role = 'user' THEN 'pending' ELSE 'done' END AS status, turn % 3 AS priority FROM conversations"


def _tasks(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("task_id"), F.when(F.col("role") == "user", "pending").otherwise("done").alias("status"), (F.col("turn") % 3).alias("priority"))


@query("task_queue", f"SELECT task_id, priority FROM ({_TASKS}) WHERE status = 'pending' ORDER BY priority, task_id LIMIT 50")
def task_queue(spark, sf):
    return _tasks(spark, sf).where("status = 'pending'").orderBy("priority", "task_id").limit(50).select("task_id", "priority")


@query("task_resolve", f"SELECT task_id, CASE WHEN task_id % 2 = 0 AND status = 'pending' THEN 'dismissed' ELSE status END AS status, CASE WHEN task_id % 2 = 1 THEN 'untouched' WHEN status = 'pending' THEN 'resolved' ELSE 'conflict' END AS outcome FROM ({_TASKS})")
def task_resolve(spark, sf):
    t = _tasks(spark, sf)
    return versions.resolve_tasks(t, t.where("task_id % 2 = 0").select("task_id", F.lit("dismissed").alias("decision")).distinct())


@query("descriptor_validate", "SELECT source_id, CASE WHEN source_id % 10 = 0 THEN 'bad_key' WHEN source_id % 10 = 1 THEN 'bad_type' WHEN source_id % 10 = 2 THEN 'missing_url' WHEN source_id % 10 = 3 THEN 'file_name' ELSE '' END AS issues FROM sources")
def descriptor_validate(spark, sf):
    k = F.col("source_id")
    rows = relation(spark, sf, "sources").select("source_id", F.when(k % 10 == 0, F.concat(F.lit("Bad Key"), k.cast("string"))).otherwise(F.concat(F.lit("gov/s"), k.cast("string"))).alias("source_key"), F.when(k % 10 == 1, "ftp").otherwise("wfs").alias("source_type"), F.when(k % 10 == 2, "").otherwise("http://x").alias("base_url"), F.when(k % 10 == 0, F.concat(F.lit("Bad Key"), k.cast("string"))).when(k % 10 == 3, "other").otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("file_tail"))
    return registry.validate_descriptors(rows, ("wfs", "html")).select("source_id", F.concat_ws(",", "issues").alias("issues"))


@query("descriptor_upsert", "SELECT CASE WHEN source_id % 4 = 0 THEN 'created' WHEN source_id % 4 = 1 THEN 'disabled' WHEN source_id % 4 = 2 THEN 'updated' ELSE 'unchanged' END AS action, count(*) AS n FROM sources GROUP BY 1")
def descriptor_upsert(spark, sf):
    s = relation(spark, sf, "sources").select("source_id", "source_key", F.sha2("source_key", 256).alias("digest"))
    new = s.where("source_id % 4 <> 1").withColumn("digest", F.when(F.col("source_id") % 4 == 2, F.lit("other")).otherwise(F.col("digest")))
    return registry.upsert(s.where("source_id % 4 <> 0"), new, "source_key").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# digests of what datasets say

_JSON = """concat('{"class":', to_json(class), ',"name":', to_json(name || ' "' || id || '" \\ '), '}')"""


@query("canonical_json", f"SELECT id, {_JSON} AS json FROM features")
def canonical_json(spark, sf):
    return relation(spark, sf, "features").select("id", properties.canonical_json(_properties()).alias("json"))


def _properties():
    """Keys in another order than that of the digest."""
    return F.create_map(F.lit("name"), F.concat("name", F.lit(' "'), F.col("id").cast("string"), F.lit('" \\ ')), F.lit("class"), F.col("class"))


@query("dataset_digest", f"""WITH h AS (SELECT dataset_id, sha256(concat_ws(chr(0), layer_name, CASE WHEN id % 5 = 0 THEN '' ELSE fkey END, class, {_JSON}, concat('Polygon|', printf('%.9f %.9f,%.9f %.9f,%.9f %.9f,%.9f %.9f,%.9f %.9f', minx, miny, maxx, miny, maxx, maxy, minx, maxy, minx, miny)))) AS h FROM features JOIN layers USING (layer_id)),
b AS (SELECT dataset_id, CAST('0x' || substr(h, 1, 6) AS BIGINT) % 64 AS bucket, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM h GROUP BY ALL)
SELECT dataset_id, sha256(string_agg(digest, '' ORDER BY bucket)) AS digest FROM b GROUP BY dataset_id""")
def dataset_digest(spark, sf):
    """Layer, external id, class, properties and geometry of all features, by dataset."""
    f = relation(spark, sf, "features").withColumn("geom", G.box(*map(F.col, ("minx", "miny", "maxx", "maxy")))).withColumn("external_id", F.when(F.col("id") % 5 != 0, F.col("fkey")))
    return dedupe.dataset_digests(f.join(relation(spark, sf, "layers"), "layer_id").withColumn("properties", _properties()))
