"""Queries on geometry: point query, joins, measures, tiles, georeferencing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import overlay
from ..operators import georef, provenance, spatial
from .base import query, relation, table

R = 6378137.0
_MX, _MY = "radians({0}) * 6378137.0", "ln(tan(pi() / 4 + radians({0}) / 2)) * 6378137.0"
_DIST = f"""sqrt(power(greatest({_MX.format('f.minx')} - {_MX.format('p.lon')}, 0, {_MX.format('p.lon')} - {_MX.format('f.maxx')}), 2)
  + power(greatest({_MY.format('f.miny')} - {_MY.format('p.lat')}, 0, {_MY.format('p.lat')} - {_MY.format('f.maxy')}), 2))"""


def features(spark, sf):
    f = relation(spark, sf, "features")
    return f.withColumn("geom", G.box(*map(F.col, ("minx", "miny", "maxx", "maxy"))))


def _published(spark, sf):
    """features x layers x published datasets, the two small sides broadcast while they are few rows."""
    layers = relation(spark, sf, "layers").join(relation(spark, sf, "datasets"), "dataset_id").where("published")
    small = layers.limit(100_001).count() <= 100_000
    return features(spark, sf).join(F.broadcast(layers) if small else layers, "layer_id")


@query("point_query", f"""SELECT point_id, id, round(dist, 4) AS distance_m, CAST(rank AS INTEGER) AS rank, layer_name, dataset_name, derivation_level FROM (
  SELECT p.point_id, f.id, d.dist, layer_name, dataset_name, derivation_level, row_number() OVER (PARTITION BY p.point_id ORDER BY d.dist, f.id) AS rank
  FROM points p JOIN features f ON true JOIN layers USING (layer_id) JOIN datasets USING (dataset_id), LATERAL (SELECT {_DIST} AS dist) d WHERE published AND d.dist <= 3000) WHERE rank <= 5""")
def point_query(spark, sf):
    found = spatial.nearest(relation(spark, sf, "points"), _published(spark, sf), 3000.0, 5, "id")
    return found.select("point_id", "id", F.round("distance_m", 4).alias("distance_m"), "rank", "layer_name", "dataset_name", "derivation_level")


@query("nearest_k", f"""SELECT point_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT p.point_id, f.id, row_number() OVER (PARTITION BY p.point_id ORDER BY d.dist, f.id) AS rank
  FROM points p JOIN features f ON true, LATERAL (SELECT {_DIST} AS dist) d WHERE d.dist <= 5000) WHERE rank <= 3""")
def nearest_k(spark, sf):
    return spatial.nearest(relation(spark, sf, "points"), features(spark, sf), 5000.0, 3, "id").select("point_id", "id", "rank")


@query("points_in_polygons", "SELECT p.point_id, f.id FROM points p JOIN features f ON p.lon >= f.minx AND p.lon < f.maxx AND p.lat > f.miny AND p.lat <= f.maxy")
def points_in_polygons(spark, sf):
    return spatial.points_in(relation(spark, sf, "points"), features(spark, sf)).select("point_id", "id")


@query("bbox_features", "SELECT id, fkey, layer_id FROM features WHERE minx <= 106 AND maxx >= 104 AND miny <= 16 AND maxy >= 12")
def bbox_features(spark, sf):
    return features(spark, sf).where(G.bbox_intersects(F.col("geom"), 104, 12, 106, 16)).select("id", "fkey", "layer_id")


@query("geojson_page", "SELECT id, count(*) OVER () AS total FROM features WHERE layer_id % 2 = 0 QUALIFY row_number() OVER (ORDER BY id) BETWEEN 51 AND 250")
def geojson_page(spark, sf):
    from ..operators.publish import page

    rows = features(spark, sf).where("layer_id % 2 = 0").select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"), F.col("class"))).alias("feature"))
    return page(rows, ["id"], offset=50, limit=200).select("id", "total")


@query("version_extent", "SELECT dataset_id, round(min(minx), 9) AS minx, round(min(miny), 9) AS miny, round(max(maxx), 9) AS maxx, round(max(maxy), 9) AS maxy FROM features JOIN layers USING (layer_id) GROUP BY dataset_id")
def version_extent(spark, sf):
    f = features(spark, sf).join(relation(spark, sf, "layers"), "layer_id")
    return f.groupBy("dataset_id").agg(*[F.round(fn(c), 9).alias(c) for c, fn in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))])


_Q = "(1 - {e2}) * (sin(radians({x})) / (1 - {e2} * sin(radians({x})) * sin(radians({x}))) - ln((1 - {e} * sin(radians({x}))) / (1 + {e} * sin(radians({x})))) / (2 * {e}))"
_q = lambda x: _Q.format(x=x, e=repr(G.E) + "::DOUBLE", e2=repr(G.E2) + "::DOUBLE")
_AREA = lambda x0, y0, x1, y1: f"(radians(({x1}) - ({x0})) * ({_q(y1)} - {_q(y0)}) * 6378137.0::DOUBLE * 6378137.0::DOUBLE / 2)"


@query("area_m2", f"SELECT id, round({_AREA('minx', 'miny', 'maxx', 'maxy')}, 1) AS area FROM features")
def area_m2(spark, sf):
    return features(spark, sf).select("id", F.round(G.area_m2(F.col("geom")), 1).alias("area"))


@query("distance_3857", f"SELECT p.point_id, f.id, round({_DIST}, 3) AS distance FROM points p JOIN features f ON f.id = p.point_id * 3")
def distance_3857(spark, sf):
    j = relation(spark, sf, "points").join(features(spark, sf), F.col("id") == F.col("point_id") * 3)
    return j.select("point_id", "id", F.round(G.distance_3857(F.col("geom"), F.col("lon"), F.col("lat")), 3).alias("distance"))


def _moved(spark, sf):
    """Boxes beside copies of them, a third of them moved by half their width."""
    f = relation(spark, sf, "features")
    dx = F.when(F.col("id") % 3 == 0, (F.col("maxx") - F.col("minx")) / 2).otherwise(0.0)
    return f.withColumn("a", G.box(*map(F.col, ("minx", "miny", "maxx", "maxy")))).withColumn("b", G.box(F.col("minx") + dx, F.col("miny"), F.col("maxx") + dx, F.col("maxy")))


@query("symdiff_m2", f"SELECT id, CASE WHEN id % 3 = 0 THEN round({_AREA('minx', 'miny', 'maxx', 'maxy')}, 0) ELSE 0 END AS changed FROM features")
def symdiff_m2(spark, sf):
    return _moved(spark, sf).select("id", (F.round(overlay.symdiff_m2("a.parts", "b.parts"), 0) + 0.0).alias("changed"))


@query("geom_equal", "SELECT id, id % 3 <> 0 AS same FROM features")
def geom_equal(spark, sf):
    return _moved(spark, sf).select("id", G.equal_exact(F.col("a"), F.col("b")).alias("same"))


@query("force_2d", "SELECT id, round(minx, 9) AS x, round(miny, 9) AS y FROM features")
def force_2d(spark, sf):
    p = relation(spark, sf, "features").withColumn("p", G.force_2d(F.array(F.array("minx", "miny", F.lit(7.0)))))
    return p.select("id", F.round(F.col("p")[0]["x"], 9).alias("x"), F.round(F.col("p")[0]["y"], 9).alias("y"))


@query("crs_to_4326", "SELECT id, id % 3 <> 2 AS identified, id % 3 = 1 AS vn2000, CASE WHEN id % 3 <> 2 THEN round(minx, 7) END AS x, CASE WHEN id % 3 <> 2 THEN round(miny, 7) END AS y FROM features")
def crs_to_4326(spark, sf):
    epsg = F.when(F.col("id") % 3 == 0, 3857).when(F.col("id") % 3 == 1, 4756).otherwise(999)
    f = relation(spark, sf, "features").withColumn("epsg", epsg)
    x = F.when(F.col("epsg") == 3857, G.mercator_x(F.col("minx"))).otherwise(F.col("minx"))
    y = F.when(F.col("epsg") == 3857, G.mercator_y(F.col("miny"))).otherwise(F.col("miny"))
    f = f.withColumn("p", G.to_degrees(F.col("epsg"), x, y))
    return f.select("id", G.identified(F.col("epsg")).alias("identified"), G.is_vn2000(F.col("epsg")).alias("vn2000"), F.round("p.x", 7).alias("x"), F.round("p.y", 7).alias("y"))


@query("plausible_degrees", "SELECT id, minx BETWEEN 100 AND 117 AND miny BETWEEN 5 AND 26 AS plausible FROM features")
def plausible_degrees(spark, sf):
    return relation(spark, sf, "features").select("id", G.plausible_degrees(F.col("minx"), F.col("miny")).alias("plausible"))


@query("geometry_roundtrip")
def geometry_roundtrip(spark, sf):
    f = features(spark, sf)
    back = G.from_geojson(G.to_geojson(F.col("geom")))
    return f.select("id", G.equal_exact(F.col("geom"), back).alias("same"), G.structure_issue(back).alias("issue"))


_TX, _TY = "CAST(floor(({0} + 180) / 360 * power(2, z)) AS BIGINT)", "CAST(floor((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * power(2, z)) AS BIGINT)"
_COVER = f"""SELECT id, layer_id, z, x, y FROM (SELECT *, unnest(range({_TY.format('maxy')}, {_TY.format('miny')} + 1)) AS y FROM (
  SELECT *, unnest(range({_TX.format('minx')}, {_TX.format('maxx')} + 1)) AS x FROM (SELECT *, unnest(range(0, 11)) AS z FROM features)))"""


@query("tile_cover", f"SELECT CAST(z AS INTEGER) AS z, x, y, count(*) AS n, min(id) AS first_id FROM ({_COVER}) GROUP BY z, x, y")
def tile_cover(spark, sf):
    return spatial.tile_cover(features(spark, sf), 0, 10).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("tile_rows_live", f"SELECT CAST(z AS INTEGER) AS z, x, y, count(*) AS n FROM ({_COVER}) JOIN layers USING (layer_id) JOIN datasets USING (dataset_id) WHERE published GROUP BY z, x, y")
def tile_rows_live(spark, sf):
    return spatial.tile_cover(_published(spark, sf), 0, 10).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("tile_stats", f"SELECT count(*) AS tiles, CAST(min(z) AS INTEGER) AS min_zoom, CAST(max(z) AS INTEGER) AS max_zoom FROM (SELECT DISTINCT z, x, y FROM ({_COVER}))")
def tile_stats(spark, sf):
    t = spatial.tile_cover(features(spark, sf), 0, 10).select("z", "x", "y").distinct()
    return t.agg(F.count(F.lit(1)).alias("tiles"), F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"))


@query("hilbert_id", f"""WITH RECURSIVE t AS (SELECT DISTINCT 6 AS z, {_TX.format('minx').replace('z', '6')} AS x, {_TY.format('miny').replace('z', '6')} AS y FROM features),
h AS (SELECT x AS ox, y AS oy, x, y, CAST(1365 AS BIGINT) AS d, 32 AS s FROM t UNION ALL
  SELECT ox, oy, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 63 - y ELSE y END ELSE x END, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 63 - x ELSE x END ELSE y END, d + s * s * xor(3 * rx, ry), s // 2
  FROM (SELECT *, CASE WHEN x & s > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & s > 0 THEN 1 ELSE 0 END AS ry FROM h WHERE s > 0))
SELECT ox AS x, oy AS y, d AS tile_id FROM h WHERE s = 0""")
def hilbert_id(spark, sf):
    f = features(spark, sf).select(G.tile_x(F.col("minx"), F.lit(6)).alias("x"), G.tile_y(F.col("miny"), F.lit(6)).alias("y")).distinct()
    return f.select("x", "y", G.hilbert_id(F.lit(6), F.col("x"), F.col("y")).alias("tile_id"))


@query("tile_geometry")
def tile_geometry(spark, sf):
    t = spatial.tile_cover(_published(spark, sf), 6, 8)
    t = t.withColumn("b", G.tile_bounds(F.col("z"), F.col("x"), F.col("y")))
    return t.select("id", "z", "x", "y", "class", "layer_name", "derivation_level", "review_status", F.to_json(overlay.tile_geometry("geom.parts", "b")).alias("quantised"))


@query("grid_enumeration", """WITH g AS (SELECT i * 81 + j AS ord, 102 + j * 0.125 AS lon, 8 + i * 0.125 AS lat FROM range(0, 121) a(i), range(0, 81) b(j))
SELECT id, min(ord) AS first_probe FROM g JOIN features ON lon >= minx AND lon < maxx AND lat > miny AND lat <= maxy GROUP BY id""")
def grid_enumeration(spark, sf):
    met = spatial.points_in(spatial.grid((102.0, 8.0, 112.0, 23.0), 0.125, spark), features(spark, sf))
    return met.groupBy("id").agg(F.min("ord").alias("first_probe"))


# provenance


@query("provenance_summary", "SELECT id, layer_name, dataset_name, derivation_level, 's' || dataset_id AS source_key FROM features JOIN layers USING (layer_id) JOIN datasets USING (dataset_id)")
def provenance_summary(spark, sf):
    d = relation(spark, sf, "datasets").withColumn("source_key", F.concat(F.lit("s"), F.col("dataset_id").cast("string")))
    found = provenance.summary(relation(spark, sf, "features"), relation(spark, sf, "layers"), d)
    return found.select("id", "p.layer_name", "p.dataset_name", "p.derivation_level", "p.source_key")


_EDGES = "SELECT DISTINCT 'o' || l_orderkey AS child, 'p' || l_partkey AS parent FROM lineitem UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


@query("provenance_bfs", f"""WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT DISTINCT child AS root, child AS node, 0 AS depth FROM e WHERE child LIKE 'o%' UNION SELECT root, parent, depth + 1 FROM w JOIN e ON e.child = w.node WHERE depth < 50)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY root, node""")
def provenance_bfs(spark, sf):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda t, a, x, b, y: table(spark, sf, t).select(s(a, x).alias("child"), s(b, y).alias("parent"))
    orders = edge("lineitem", "o", "l_orderkey", "p", "l_partkey").union(edge("orders", "o", "o_orderkey", "c", "o_custkey"))
    edges = orders.union(edge("customer", "c", "c_custkey", "n", "c_nationkey")).union(edge("nation", "n", "n_nationkey", "r", "n_regionkey")).distinct()
    return provenance.walk(edges, orders.select(F.col("child").alias("root")).distinct())


@query("entity_labels", "SELECT o_orderkey AS ref_id, CASE WHEN o_orderkey % 3 = 0 THEN 'customer' WHEN o_orderkey % 3 = 1 THEN 'nation' ELSE 'ghost' END AS entity_type, coalesce(c_name, n_name, '(deleted)') AS label FROM orders LEFT JOIN customer ON o_orderkey % 3 = 0 AND c_custkey = o_custkey LEFT JOIN nation ON o_orderkey % 3 = 1 AND n_nationkey = o_custkey")
def entity_labels(spark, sf):
    k = F.col("o_orderkey") % 3
    refs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ref_id"), F.when(k == 0, "customer").when(k == 1, "nation").otherwise("ghost").alias("entity_type"), F.col("o_custkey").alias("entity_id"))
    names = table(spark, sf, "customer").select(F.lit("customer").alias("entity_type"), F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("label")).union(table(spark, sf, "nation").select(F.lit("nation"), F.col("n_nationkey").cast("bigint"), "n_name"))
    return provenance.labelled(refs, names).select("ref_id", "entity_type", "label")


@query("provenance_emit", "SELECT 'feature' AS entity_type, CAST(id AS VARCHAR) AS entity_id, 'normalize' AS operation, CAST(1 AS INTEGER) AS n_inputs, sha256(fkey) AS output_sha256 FROM features")
def provenance_emit(spark, sf):
    f = relation(spark, sf, "features")
    e = provenance.events(f, F.lit("feature"), F.col("id"), "normalize", F.array(F.struct(F.lit("layer").alias("entity_type"), F.col("layer_id").cast("string").alias("entity_id"))), F.sha2("fkey", 256))
    return e.select("entity_type", "entity_id", "operation", F.size("input_refs").alias("n_inputs"), "output_sha256")


@query("provenance_inputs", "SELECT layer_id AS input_id, count(*) AS n FROM features GROUP BY layer_id")
def provenance_inputs(spark, sf):
    f = relation(spark, sf, "features")
    e = provenance.events(f, F.lit("feature"), F.col("id"), "normalize", F.array(F.struct(F.lit("layer").alias("entity_type"), F.col("layer_id").cast("string").alias("entity_id"))), F.sha2("fkey", 256))
    return e.select(F.explode_outer("input_refs").alias("r")).groupBy(F.col("r.entity_id").cast("int").alias("input_id")).agg(F.count(F.lit(1)).alias("n"))


# georeferencing: every twelve customers are the control points of a job, on an exact affine


def _gcps(spark, sf, outliers: bool):
    k, j = F.col("c_custkey") % 997, F.col("job_id") % 25
    px, py = (k * k * 7 % 1000).cast("double"), (k * 91 % 800).cast("double")
    c = table(spark, sf, "customer").withColumn("job_id", F.floor(F.col("c_custkey") / 12)).withColumn("n", (F.col("c_custkey") % 12 + 1).cast("int"))
    off = F.when(F.col("n") == 5, 0.5).otherwise(0.0) if outliers else F.lit(0.0)
    return c.select("job_id", F.col("n").alias("gcp_id"), px.alias("px"), py.alias("py"), (105 + j * 0.01 + px * 1e-4 + py * 2e-5 + off).alias("mx"), (20 + j * 0.01 - py * 1e-4 + px * 1e-5).alias("my"), F.lit(True).alias("enabled"))


_JOBS = "(SELECT c_custkey // 12 AS job_id, count(*) AS n FROM customer GROUP BY 1)"


@query("georef_affine", f"SELECT job_id, CAST(1e-4 AS DOUBLE) AS a, CAST(2e-5 AS DOUBLE) AS b, CAST(1e-5 AS DOUBLE) AS d, CAST(-1e-4 AS DOUBLE) AS e, round(105 + job_id % 25 * 0.01::DOUBLE, 6) AS c, round(20 + job_id % 25 * 0.01::DOUBLE, 6) AS f FROM {_JOBS} WHERE n >= 3")
def georef_affine(spark, sf):
    m = georef.fit_affine(_gcps(spark, sf, False))
    return m.select("job_id", *[F.round(c, 9).alias(c) for c in "abde"], F.round("c", 6).alias("c"), F.round("f", 6).alias("f"))


@query("georef_residuals", f"SELECT job_id, CAST(0 AS DOUBLE) AS rmse FROM {_JOBS} WHERE n >= 3")
def georef_residuals(spark, sf):
    g = _gcps(spark, sf, False)
    return georef.residuals(g, georef.fit_affine(g)).select("job_id", F.abs(F.round("rmse", 8)).alias("rmse"))


@query("georef_consensus", "SELECT c_custkey // 12 AS job_id, CAST(count(*) - count(*) FILTER (WHERE c_custkey % 12 = 4) AS BIGINT) AS inliers, CASE WHEN count(*) FILTER (WHERE c_custkey % 12 = 4) > 0 THEN 5 END AS rejected FROM customer GROUP BY 1 HAVING count(*) >= 6")
def georef_consensus(spark, sf):
    g = _gcps(spark, sf, True)
    enough = g.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 6").select("job_id")
    return georef.consensus(g.join(enough, "job_id")).select("job_id", "inliers", F.get("rejected", F.lit(0)).alias("rejected"))


@query("georef_nonaffine", f"""SELECT job_id, kind, CASE WHEN n >= least THEN 'computed' ELSE 'too_few_points' END AS status, CASE WHEN n >= least THEN CAST(0 AS DOUBLE) END AS rmse
  FROM {_JOBS}, (VALUES ('poly2', 6), ('projective', 4), ('tps', 3)) k(kind, least)""")
def georef_nonaffine(spark, sf):
    """All jobs by each kind of transform; every kind fits an exact affine."""
    g = _gcps(spark, sf, False)
    fits = [georef.fit_other(g, kind) for kind in ("poly2", "projective", "tps")]
    return fits[0].union(fits[1]).union(fits[2]).select("job_id", "kind", "status", F.abs(F.round("rmse", 6)).alias("rmse"))


@query("georef_apply", "SELECT job_id, gcp_id, true AS same FROM (SELECT c_custkey // 12 AS job_id, CAST(c_custkey % 12 + 1 AS INTEGER) AS gcp_id, count(*) OVER (PARTITION BY c_custkey // 12) AS n FROM customer) WHERE n >= 3")
def georef_apply(spark, sf):
    g = _gcps(spark, sf, False)
    at = georef.apply_affine(g.join(georef.fit_affine(g), "job_id"))
    return at.select("job_id", "gcp_id", ((F.abs(F.col("x") - F.col("mx")) < 1e-7) & (F.abs(F.col("y") - F.col("my")) < 1e-7)).alias("same"))


@query("georef_review", "SELECT r_regionkey AS dataset_id, CASE r_regionkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS review_status FROM region")
def georef_review(spark, sf):
    r = table(spark, sf, "region")
    jobs = r.where("r_regionkey % 3 < 2").select(F.col("r_regionkey").alias("dataset_id"), F.when(F.col("r_regionkey") % 3 == 0, "approved").otherwise("rejected").alias("decision"), F.lit("computed").alias("status"))
    return georef.review(r.select(F.col("r_regionkey").alias("dataset_id"), F.lit("pending").alias("review_status")), jobs)


