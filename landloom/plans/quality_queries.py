"""One query for each quality rule, and for what is made of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import quality as Q
from ..storage import dealt, materialise
from .base import query, relation, table


def context(spark, sf) -> Q.Context:
    f = dealt(relation(spark, sf, "features"))
    k = F.col("id")
    shared = F.when(k % 50 == 7, 107.001).otherwise(F.col("minx"))
    geom = F.when(k % 40 == 0, None).when(k % 40 == 1, G.line(F.array(G.xy(F.col("minx"), F.col("miny")), G.xy(F.col("maxx"), F.col("maxy"))))).when(k % 50 == 7, G.box(shared, F.lit(20.0), shared + 0.001, F.lit(20.001))).otherwise(G.box(*map(F.col, ("minx", "miny", "maxx", "maxy"))))
    props = F.map_filter(F.create_map(F.lit("name"), F.when(k % 30 == 0, "").otherwise(F.col("name")), F.lit("class"), F.when(k % 45 != 0, F.col("class"))), lambda _, v: v.isNotNull())
    day = lambda n: F.when(k % n == 0, "2020-13-01").when(k % 2 == 0, "2020-05-01")
    feats = f.select("layer_id", k.alias("ord"), F.col("fkey").alias("key"), geom.alias("geom"), props.alias("properties"), day(60).alias("valid_from"), F.when(k % 34 == 0, "2019-01-01").alias("valid_to"))
    feats = materialise(feats, "features")  # rules name the geometry many times, and would work it out each time
    layers = relation(spark, sf, "layers").select("layer_id", "layer_name", "dataset_id", F.lit("POLYGON").alias("geometry_type"), F.lit(None).cast("string").alias("expected_type"), F.array(F.lit("class"), F.lit("name")).alias("required"), F.lit(True).alias("overlap"), F.lit(True).alias("gap"), F.lit(True).alias("cross"))
    o = F.col("o_orderkey")
    ds = table(spark, sf, "orders").select(o.alias("dataset_id"), F.when(o % 9 == 0, None).otherwise(4326).alias("epsg"), F.when(o % 3 == 0, "official_vector").when(o % 3 == 1, "derived_machine_unreviewed").otherwise("reference_approximate").alias("derivation_level"), F.when(o % 2 == 0, "A").alias("authority"), F.when(o % 8 == 0, "other").otherwise("quy_hoach").alias("grp"), F.lit("x").alias("recorded_sha"), F.when(o % 10 == 0, "y").otherwise("x").alias("actual_sha"),
        F.when(o % 14 == 0, "2030-01-01").otherwise("2000-01-01").alias("approval_date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_from"), F.when(o % 12 == 0, "1980-01-01").when(o % 12 == 1, "soon").alias("effective_to"), F.lit(None).cast("string").alias("signed_date"), F.when(o % 16 == 0, "D1").otherwise("R1").alias("record_code"), F.when(o % 5 == 0, "D2").otherwise("D1").alias("document_number"), F.lit("D1").alias("decision"))
    return Q.Context(feats, layers, ds, ds.where("dataset_id % 4 = 0").select("dataset_id"))


def _refs(rule):
    def run(spark, sf):
        return Q.RULES[Q.PREFIX + rule].run(context(spark, sf)).select("target_ref", "severity", "message")

    return run


def _rule(name: str, code: str, sql: str | None):
    query(name, sql)(_refs(code))


_F = "SELECT fkey AS target_ref, '{sev}' AS severity, {msg} AS message FROM features WHERE {where}"
_D = "SELECT CAST(o_orderkey AS VARCHAR) AS target_ref, '{sev}' AS severity, '{msg}' AS message FROM orders WHERE {where}"
_BOX = "id % 40 > 1 AND id % 50 <> 7"
_rule("q_geom_empty", "GEOM-EMPTY", _F.format(sev="error", msg="'geometry is null'", where="id % 40 = 0"))
_rule("q_geom_invalid", "GEOM-INVALID", None)
_rule("q_geom_collection", "GEOM-COLLECTION", _F.format(sev="warning", msg="'geometry collection'", where="false"))
_rule("q_geom_type", "GEOM-TYPE-MISMATCH", _F.format(sev="error", msg="'expected POLYGON, found LineString'", where="id % 40 = 1"))
_rule("q_geom_duplicate", "GEOM-DUPLICATE", """SELECT fkey AS target_ref, 'warning' AS severity, 'duplicate of ' || first_key AS message FROM (SELECT fkey, id, min(id) OVER w AS first_id, arg_min(fkey, id) OVER w AS first_key FROM (
  SELECT *, CASE WHEN id % 40 > 1 AND id % 50 = 7 THEN 'same' WHEN id % 40 = 1 THEN 'l' || minx || '|' || miny || '|' || maxx ELSE minx || '|' || miny || '|' || maxx END AS h FROM features WHERE id % 40 <> 0) WINDOW w AS (PARTITION BY layer_id, h)) WHERE id > first_id""")
_rule("q_crs_missing", "CRS-MISSING", _D.format(sev="critical", msg="coordinate system not identified", where="o_orderkey % 9 = 0"))
_rule("q_crs_bounds", "CRS-BOUNDS", None)
_rule("q_poly_overlap", "TOPO-POLY-OVERLAP", """SELECT a.fkey AS target_ref, 'warning' AS severity, 'overlaps ' || b.fkey AS message FROM (SELECT * FROM g) a JOIN g b ON a.layer_id = b.layer_id AND a.id < b.id
  AND least(a.maxx, b.maxx) > greatest(a.minx, b.minx) AND least(a.maxy, b.maxy) > greatest(a.miny, b.miny)""".replace("(SELECT * FROM g) a", "g a").replace("SELECT a.fkey", "WITH g AS (SELECT id, layer_id, fkey, CASE WHEN id % 50 = 7 THEN 107.001 ELSE minx END AS minx, CASE WHEN id % 50 = 7 THEN 20 ELSE miny END AS miny, CASE WHEN id % 50 = 7 THEN 107.002 ELSE maxx END AS maxx, CASE WHEN id % 50 = 7 THEN 20.001 ELSE maxy END AS maxy FROM features WHERE id % 40 > 1) SELECT a.fkey"))
_rule("q_poly_gap", "TOPO-POLY-GAP", None)
_rule("q_line_cross", "TOPO-LINE-CROSS", None)
_rule("q_attr_required", "ATTR-REQUIRED", "SELECT fkey AS target_ref, 'error' AS severity, 'missing: ' || concat_ws(', ', CASE WHEN id % 45 = 0 THEN 'class' END, CASE WHEN id % 30 = 0 THEN 'name' END) AS message FROM features WHERE id % 45 = 0 OR id % 30 = 0")
_rule("q_time_invalid", "TIME-INVALID", "SELECT fkey AS target_ref, 'error' AS severity, 'unreadable valid_from' AS message FROM features WHERE id % 60 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'error', 'unreadable effective_to' FROM orders WHERE o_orderkey % 12 = 1")
_rule("q_time_order", "TIME-ORDER", "SELECT fkey AS target_ref, 'error' AS severity, 'valid_to before valid_from' AS message FROM features WHERE id % 34 = 0 AND id % 60 <> 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'error', 'effective_to before effective_from' FROM orders WHERE o_orderkey % 12 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'warning', 'effective_from before approval_date' FROM orders WHERE CAST(o_orderdate AS DATE) < CASE WHEN o_orderkey % 14 = 0 THEN DATE '2030-01-01' ELSE DATE '2000-01-01' END")
_rule("q_hash_mismatch", "ARTIFACT-HASH-MISMATCH", _D.format(sev="critical", msg="content differs from its recorded digest", where="o_orderkey % 10 = 0"))
_rule("q_prov_orphan", "PROV-ORPHAN", _D.format(sev="error", msg="derived_machine_unreviewed without inputs", where="o_orderkey % 3 = 1 AND o_orderkey % 4 <> 0"))
_rule("q_auth_missing", "AUTH-MISSING", _D.format(sev="error", msg="no authority", where="o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0"))
_rule("q_code_mismatch", "META-CODE-MISMATCH", _D.format(sev="warning", msg="decision differs from document number", where="o_orderkey % 5 = 0") + " UNION ALL " + _D.format(sev="warning", msg="record code equals decision", where="o_orderkey % 16 = 0"))
_rule("q_group_unknown", "VN-GROUP-UNKNOWN", _D.format(sev="info", msg="group not known", where="o_orderkey % 8 = 0"))


_ONLY = ("QH-GEOM-EMPTY", "QH-CRS-MISSING", "QH-VN-GROUP-UNKNOWN")


@query("findings_summary", "SELECT rule_code, count(*) AS n FROM (SELECT 'QH-GEOM-EMPTY' AS rule_code FROM features WHERE id % 40 = 0 UNION ALL SELECT 'QH-CRS-MISSING' FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'QH-VN-GROUP-UNKNOWN' FROM orders WHERE o_orderkey % 8 = 0) GROUP BY rule_code")
def findings_summary(spark, sf):
    s = Q.summary(Q.run(context(spark, sf), spark, only=_ONLY))
    return s.select(F.explode("by_rule").alias("rule_code", "n"))


@query("findings_report", "SELECT CAST(o_orderkey AS VARCHAR) AS target_ref, '[INFO] QH-VN-GROUP-UNKNOWN dataset:' || o_orderkey || ' group not known' AS line FROM orders WHERE o_orderkey % 8 = 0")
def findings_report(spark, sf):
    return Q.report(Q.run(context(spark, sf), spark, only=("QH-VN-GROUP-UNKNOWN",))).select("target_ref", "line")


def _persisted(spark, sf):
    c = context(spark, sf)
    f = Q.run(c, spark, only=("QH-CRS-MISSING", "QH-VN-GROUP-UNKNOWN")).withColumn("dataset_id", F.col("target_ref").cast("bigint"))
    known = c.datasets.where("dataset_id % 2 = 0").select(F.lit("dataset").alias("target_type"), F.col("dataset_id").cast("string").alias("target_ref"))
    before = c.datasets.where("dataset_id % 6 = 0").select("dataset_id", F.when(F.col("dataset_id") % 12 == 0, "dataset").otherwise("feature").alias("target_type"))
    return Q.persist(f, known, F.col("dataset_id"), before)


@query("quality_state", "SELECT o_orderkey AS dataset_id, CASE WHEN o_orderkey % 9 = 0 THEN 'errors' ELSE 'warnings' END AS quality_state FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 8 = 0")
def quality_state(spark, sf):
    return _persisted(spark, sf)[2]


@query("persist_findings", "SELECT o_orderkey AS dataset_id, CASE WHEN o_orderkey % 12 = 0 AND (o_orderkey % 9 = 0 OR o_orderkey % 8 = 0) THEN 'superseded by new run' END AS resolution FROM orders WHERE o_orderkey % 6 = 0")
def persist_findings(spark, sf):
    return _persisted(spark, sf)[1].select("dataset_id", "resolution")


@query("findings_targets", "SELECT target_type, count(*) AS n FROM (SELECT 'dataset' AS target_type FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'dataset' FROM orders WHERE o_orderkey % 8 = 0) GROUP BY 1")
def findings_targets(spark, sf):
    return _persisted(spark, sf)[0].groupBy("target_type").agg(F.count(F.lit(1)).alias("n"))


@query("rule_findings_by_rule")
def rule_findings_by_rule(spark, sf):
    """All rules over all features and datasets."""
    return Q.run(context(spark, sf), spark).groupBy("rule_code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("rule_catalog", "SELECT rule_code, count(*) AS n FROM (SELECT 'QH-CRS-MISSING' AS rule_code FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'QH-AUTH-MISSING' FROM orders WHERE o_orderkey % 6 = 3) GROUP BY 1")
def rule_catalog(spark, sf):
    """Findings of two dataset rules, by their catalog rows."""
    f = Q.run(context(spark, sf), spark, only=("QH-CRS-MISSING", "QH-AUTH-MISSING"))
    return f.join(F.broadcast(Q.catalog(spark).where("applies_to = 'dataset'")), "rule_code").groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))


# rules on shapes that break them: parts as shapes, in groups of several


@query("rule_errors", "SELECT 'QH-CRS-MISSING' AS rule_code, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'QH-RULE-ERROR', CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM orders")
def rule_errors(spark, sf):
    """A rule that divides by zero on some dataset as it runs, beside one that is sound."""
    code = Q.PREFIX + "BROKEN"
    Q.RULES[code] = Q.Rule(code, "", "error", "dataset", lambda c: Q.found(c.datasets.where(1 / (F.col("dataset_id") % 2) > 0), "CRS-MISSING", F.lit("never"), F.col("dataset_id")))
    try:
        found = Q.run(context(spark, sf), spark, only=(code, "QH-CRS-MISSING"))
    finally:
        del Q.RULES[code]
    return found.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))


def _made(parts, shape, gap: bool = False, cross: bool = False) -> Q.Context:
    """parts(k, g) with shape as GeoJSON text (null: none), each group a layer."""
    told = materialise(dealt(parts).select("g", "k", shape.alias("shape")), "shapes")  # as text first: the parser reads it many times
    f = materialise(told.select(F.col("g").alias("layer_id"), F.col("k").alias("ord"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("key"), G.from_geojson(F.col("shape")).alias("geom")), "geometries")
    layers = parts.select(F.col("g").alias("layer_id"), F.concat(F.lit("L"), F.col("g").cast("string")).alias("layer_name"), F.lit(1).alias("dataset_id")).distinct().withColumns({"overlap": F.lit(False), "gap": F.lit(gap), "cross": F.lit(cross)})
    return Q.Context(f.where("geom IS NOT NULL"), layers, parts.sparkSession.createDataFrame([(1, 4326)], "dataset_id int, epsg int"))


def _parts(spark, sf, per: int):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("k"), F.floor(k / per).alias("g"), (k % per).alias("i"))


def _at(x, y):
    """A corner as GeoJSON text: x and y thousandths from the group's place, one of 100,000 in the expected extent; groups are
    layers of their own, so those of one place don't meet."""
    g = F.col("g")
    return F.concat(F.lit("["), (105 + g % 100 / 100 + x / 1000).cast("string"), F.lit(","), (15 + F.floor(g / 100) % 1000 / 100 + y / 1000).cast("string"), F.lit("]"))


def _ring(*corners):
    return F.concat(F.lit("["), F.concat_ws(",", *[_at(F.lit(x) if not isinstance(x, Column) else x, F.lit(y) if not isinstance(y, Column) else y) for x, y in (*corners, corners[0])]), F.lit("]"))


def _polygon(*rings):
    return F.concat(F.lit('{"type":"Polygon","coordinates":['), F.concat_ws(",", *rings), F.lit("]}"))


@query("faulty_shapes", """WITH k AS (SELECT p_partkey AS k, p_partkey % 6 AS i FROM part)
SELECT 'p' || k AS target_ref, CASE i WHEN 1 THEN 'QH-GEOM-COLLECTION' WHEN 2 THEN 'QH-CRS-BOUNDS' ELSE 'QH-GEOM-INVALID' END AS rule_code,
  CASE i WHEN 0 THEN 'self_intersection' WHEN 1 THEN 'geometry collection' WHEN 2 THEN 'outside the expected extent' WHEN 3 THEN 'hole_outside_shell' ELSE 'nested_holes' END AS message FROM k WHERE i < 5""")
def faulty_shapes(spark, sf):
    """Every part as a bow tie, a collection, a place far off, a hole outside, a hole in a hole, or a sound box."""
    parts, i = _parts(spark, sf, 6), F.col("i")
    box = lambda a, b: _ring((a, a), (b, a), (b, b), (a, b))
    shape = (
        F.when(i == 0, _polygon(_ring((0, 0), (1, 1), (1, 0), (0, 1)))).when(i == 1, F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":'), _at(F.lit(0), F.lit(0)), F.lit("}]}")))
        .when(i == 2, F.concat(F.lit('{"type":"Point","coordinates":[1.5,'), (F.col("g") % 50).cast("string"), F.lit("]}"))).when(i == 3, _polygon(box(0, 1), box(2, 3))).when(i == 4, _polygon(box(0, 9), box(1, 8), box(2, 7))).otherwise(_polygon(box(0, 1)))
    )
    c = _made(parts, shape)
    found = Q.geom_invalid(c).unionByName(Q.geom_collection(c)).unionByName(Q.crs_bounds(c))
    return found.select("target_ref", "rule_code", "message")


@query("coverage_gaps", """SELECT CAST(p_partkey // 9 AS BIGINT) AS layer_id, CASE WHEN p_partkey // 9 % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey // 9 % 4 = 1 THEN 1 ELSE 0 END AS holes
FROM part WHERE (SELECT count(*) FROM part q WHERE q.p_partkey // 9 = part.p_partkey // 9) = 9 GROUP BY 1, 2 HAVING holes > 0""")
def coverage_gaps(spark, sf):
    """Nine parts as a square of three by three: in every third group the middle one is missing; in every second one long
    box takes the left side's place, so its neighbours meet it in T-junctions; in every fifth all but the middle are wider
    and overlap; in every fourth the right lower one has a hole of its own."""
    parts = _parts(spark, sf, 9)
    whole = parts.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n = 9").select("g")
    parts, g, i = parts.join(whole, "g"), F.col("g"), F.col("i")
    x, y, more = i % 3, F.floor(i / 3), F.when((g % 5 == 1) & (i != 4), 0.1).otherwise(0.0)
    high = F.when((i == 0) & (g % 2 == 0), F.lit(3)).otherwise(y + 1)
    box = _ring((x - more, y - more), (x + 1 + more, y - more), (x + 1 + more, high + more), (x - more, high + more))
    hole = _ring((x + 0.3, y + 0.3), (x + 0.6, y + 0.3), (x + 0.6, y + 0.6), (x + 0.3, y + 0.6))
    shape = F.when((i == 4) & (g % 3 == 0) | i.isin(3, 6) & (g % 2 == 0), None).when((i == 2) & (g % 4 == 1), _polygon(box, hole)).otherwise(_polygon(box))
    found = Q.poly_gap(_made(parts, shape, gap=True))
    return found.select(F.col("target_ref").cast("bigint").alias("layer_id"), F.regexp_extract("message", "^[0-9]+", 0).cast("int").alias("holes"))


@query("line_crossings", """WITH k AS (SELECT p_partkey AS k, p_partkey // 4 AS g, p_partkey % 4 AS i FROM part)
SELECT 'p' || a.k AS target_ref, 'crosses p' || b.k AS message FROM k a JOIN k b ON a.g = b.g AND (a.i, b.i) IN ((0, 1), (0, 2), (1, 3))""")
def line_crossings(spark, sf):
    """Four parts as lines: two cross, one goes on where the first ends, one runs along the first and crosses the second."""
    parts, i = _parts(spark, sf, 4), F.col("i")
    line = lambda *p: F.concat(F.lit('{"type":"LineString","coordinates":['), F.concat_ws(",", *[_at(F.lit(x), F.lit(y)) for x, y in p]), F.lit("]}"))
    shape = F.when(i == 0, line((0, 0), (2, 2))).when(i == 1, line((0, 2), (2, 0))).when(i == 2, line((2, 2), (3, 1))).otherwise(line((0.5, 0.5), (1.5, 1.5)))
    return Q.line_cross(_made(parts, shape, cross=True)).select("target_ref", "message")
