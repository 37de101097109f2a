"""The golden scenarios of the blueprint, rebuilt as small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.functions import geometry as G
from landloom.functions import overlay
from landloom.operators import dedupe, diff, georef, observe, provenance, publish, quality, search, spatial, topology, versions
from landloom.sources import files, payloads
from landloom.streaming.observe import observation_stream

X0, Y0, U = 105.88, 20.93, 0.0375
V1 = {"ODT": (0.05, 0.55, 0.45, 0.95, 14.6), "DVCL": (0.55, 0.55, 0.95, 0.95, 14.6), "CAY": (0.05, 0.05, 0.45, 0.45, 14.6), "CN": (0.55, 0.05, 0.95, 0.45, 14.6)}
V2 = {"ODT": (0.05, 0.55, 0.35, 0.95, 10.95), "TT": (0.35, 0.55, 0.45, 0.95, 3.65), "DVCL": V1["DVCL"], "CAY": (0.05, 0.05, 0.50, 0.45, 16.425), "CN": (0.50, 0.05, 0.95, 0.45, 16.425)}


def district(spark, layer):
    rows = [(k, X0 + a * U, Y0 + b * U, X0 + c * U, Y0 + d * U, str(ha), i) for i, (k, (a, b, c, d, ha)) in enumerate(layer.items())]
    df = spark.createDataFrame(rows, "key string, a double, b double, c double, d double, ha string, ord int")
    return df.select("key", F.col("key").alias("class"), G.box(*map(F.col, "abcd")).alias("geom"), F.create_map(F.lit("dien_tich_ha"), F.col("ha")).alias("properties"), "ord")


def test_golden_diff(spark):
    d = diff.diff(district(spark, V1), district(spark, V2))
    s = diff.changeset_summary(d).first()
    assert (s.added, s.removed, s.geometry_changed, s.classification_changed, s.properties_changed, s.unchanged) == (1, 0, 3, 0, 3, 1)
    assert s.added_m2 > 1e4 and s.modified_m2 > s.added_m2
    same = diff.changeset_summary(diff.diff(district(spark, V1), district(spark, V1))).first()
    assert same.unchanged == 4 and same.modified_m2 == 0


def test_null_keys_go_and_last_wins(spark):
    a = district(spark, V1).withColumn("key", F.when(F.col("ord") < 2, "k").when(F.col("ord") == 2, None).otherwise(F.col("key")))
    assert {r.key for r in diff.keyed(a).collect()} == {"k", "CN"}
    assert diff.keyed(a).where("key = 'k'").first()["class"] == "DVCL"


def test_observation_cycle(spark):
    keys = "source_id int, resource_key string, url string, meta string, sha string"
    empty = spark.createDataFrame([], keys + ", status string")
    found = lambda *rows: spark.createDataFrame([(1, k, "u", "m", s, o) for k, s, o in rows], keys + ", outcome string")
    events = lambda s: {(r.resource_key, r.change_type) for r in observe.change_events(s).collect()}
    s1 = observe.observation_cycle(empty, found(("a", "1", "ok"), ("b", "2", "ok")), True)
    assert events(s1) == {("a", "added"), ("b", "added")}
    s2 = observe.observation_cycle(s1.drop("events"), found(("a", "1", "ok"), ("b", None, "not_modified")), True)
    assert events(s2) == set() and s2.where("resource_key = 'b'").first().sha == "2"
    partial = observe.observation_cycle(s2.drop("events"), found(("a", "1", "ok")), False)
    assert events(partial) == set()
    s3 = observe.observation_cycle(s2.drop("events"), found(("a", "1", "ok")), True)
    assert events(s3) == {("b", "disappeared")}
    s4 = observe.observation_cycle(s3.drop("events"), found(("a", "9", "ok"), ("b", "2", "ok")), True)
    assert events(s4) == {("b", "reappeared"), ("a", "checksum_changed")}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "r", i, f"2024-01-01 00:00:{i:02d}", str(i // 2 % 3)) for i in range(20)] + [(2, "q", 50, "2024-01-02 00:00:00", None)]
    df = spark.createDataFrame(rows, "source_id long, resource_key string, event_id long, t string, sha string").select("source_id", "resource_key", "event_id", F.to_timestamp("t").alias("ts"), "sha")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = observation_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    batch = {(r.event_id, r.state) for r in observe.classify(df, ["source_id", "resource_key"]).collect()}
    assert {(r.event_id, r.state) for r in spark.table("seen").collect()} == batch


def test_digest_ignores_order_and_partitions(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    a = {tuple(r) for r in dedupe.digests(rows, ["k"], "h").collect()}
    assert a == {tuple(r) for r in dedupe.digests(rows.repartition(7).orderBy(F.desc("h")), ["k"], "h").collect()}


@pytest.mark.parametrize("n_roots", [2, 40])
def test_walk_by_brute_force(spark, n_roots):
    """Few roots (walked by themselves) and many that share their inputs; cycles, a root that is an input, a bound of depth."""
    import random

    rng = random.Random(n_roots)
    inner = [f"n{i}" for i in range(9)]
    pairs = {(a, b) for a in inner for b in rng.sample(inner, 2)} | {(f"r{i}", rng.choice(inner)) for i in range(n_roots) for _ in range(3)} | {("n0", "r0")}
    edges = spark.createDataFrame(list(pairs), "child string, parent string")
    for bound in (50, 2):
        want = set()
        for root in [f"r{i}" for i in range(n_roots)] + ["alone"]:
            depth, level = {root: 0}, [root]
            for d in range(1, bound + 1):
                level = [b for a, b in pairs if a in level and b not in depth]
                depth |= dict.fromkeys(level, d)
            want |= {(root, n, d) for n, d in depth.items()}
        roots = spark.createDataFrame([(f"r{i}",) for i in range(n_roots)] + [("alone",)], "root string")
        assert {tuple(r) for r in provenance.walk(edges, roots, bound).collect()} == want


def test_walk_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "child string, parent string")
    got = {(r.node, r.depth) for r in provenance.walk(e, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_wide_boxes_meet_once(spark):
    a = spark.createDataFrame([(i, i * 1.0, 0.0, i + 0.5, 0.5) for i in range(50)], "i int, ax double, ay double, bx double, by double")
    b = spark.createDataFrame([(1, -1000.0, -1000.0, 1000.0, 1000.0), (2, 3.2, 0.2, 3.3, 0.3)], "j int, cx double, cy double, dx double, dy double")
    got = spatial.box_join(a, b, ("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy"), 0.1).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted([(i, 1) for i in range(50)] + [(3, 2)])


def test_boxes_of_both_sides_go_to_their_levels(spark):
    rows = [(i, i * 1.0, 0.0, i + 0.5, 0.5) for i in range(20)] + [(90, -1000.0, -1000.0, 1000.0, 1000.0), (91, 0.0, 0.0, 3.0, 3.0), (92, 5.25, 0.25, 5.25, 0.25)]
    a = spark.createDataFrame(rows, "i int, ax double, ay double, bx double, by double")
    b = a.toDF("j", "cx", "cy", "dx", "dy")
    got = spatial.box_join(a, b, ("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy"), 0.1).select("i", "j").collect()
    want = [(p[0], q[0]) for p in rows for q in rows if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert sorted(map(tuple, got)) == sorted(want)
    own = a.withColumn("_own", spatial._level(*map(F.col, ("ax", "ay", "bx", "by")), 0.1))
    keys = spatial._keyed(own, own, ("ax", "ay", "bx", "by"), 0.1, (0,), 1).groupBy("i", "_lv").count()
    assert keys.agg(F.max("count")).first()[0] <= spatial.WIDE_CELLS


@pytest.mark.parametrize("kind", ["poly2", "projective", "tps"])
def test_other_fits(spark, kind):
    rows = [(1, i, float(i % 4 * 10), float(i // 4 * 10), i % 4 * 10 * 2.0 + 5, i // 4 * 10 * -1.0 + 1, True) for i in range(12)] + [(2, 1, 0.0, 0.0, 0.0, 0.0, True)]
    g = spark.createDataFrame(rows, "job_id int, gcp_id int, px double, py double, mx double, my double, enabled boolean")
    got = {r.job_id: r for r in georef.fit_other(g, kind).collect()}
    assert got[1].status == "computed" and got[1].rmse < 1e-6 and got[2].status == "too_few_points"


def ctx(spark, rows, **layer):
    f = spark.createDataFrame([(1, i, f"f{i}", t) for i, t in enumerate(rows)], "layer_id int, ord int, key string, g string").select("layer_id", "ord", "key", G.from_geojson(F.col("g")).alias("geom"), F.create_map(F.lit("a"), F.lit("1")).alias("properties"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    opts = {"overlap": False, "gap": False, "cross": False} | layer
    ls = spark.createDataFrame([(1, "L", 1, None, None, ["a"])], "layer_id int, layer_name string, dataset_id int, geometry_type string, expected_type string, required array<string>").select("*", *[F.lit(v).alias(k) for k, v in opts.items()])
    ds = spark.createDataFrame([(1, 4326)], "dataset_id int, epsg int")
    return quality.Context(f, ls, ds)


def poly(*p):
    return '{"type":"Polygon","coordinates":[[' + ",".join(f"[{x},{y}]" for x, y in [*p, p[0]]) + "]]}"


def codes(df):
    return [(r.target_ref, r.rule_code) for r in df.collect()]


def test_geometry_rules(spark):
    bow = poly((0, 0), (1, 1), (1, 0), (0, 1))
    a, b = poly((0, 0), (2, 0), (2, 2), (0, 2)), poly((1, 1), (3, 1), (3, 3), (1, 3))
    c = ctx(spark, [bow, a, b, a], overlap=True)
    assert codes(quality.geom_invalid(c)) == [("f0", "QH-GEOM-INVALID")]
    assert codes(quality.geom_duplicate(c)) == [("f3", "QH-GEOM-DUPLICATE")]
    assert {r.target_ref for r in quality.poly_overlap(ctx(spark, [a, b], overlap=True)).collect()} == {"f0"}
    assert quality.poly_overlap(ctx(spark, [a, b])).count() == 0
    assert codes(quality.crs_bounds(ctx(spark, ['{"type":"Point","coordinates":[0,0]}']))) == [("f0", "QH-CRS-BOUNDS")]


def test_gap_and_cross(spark):
    ring = [poly((0, 0), (3, 0), (3, 1), (0, 1)), poly((0, 2), (3, 2), (3, 3), (0, 3)), poly((0, 1), (1, 1), (1, 2), (0, 2)), poly((2, 1), (3, 1), (3, 2), (2, 2))]
    split = [poly((0, 0), (3, 0), (3, 1), (2, 1), (1, 1), (0, 1)), poly((0, 2), (1, 2), (2, 2), (3, 2), (3, 3), (0, 3)), ring[2], ring[3]]
    assert quality.poly_gap(ctx(spark, split, gap=True)).count() == 1
    assert quality.poly_gap(ctx(spark, split[:1], gap=True)).count() == 0
    lines = ['{"type":"LineString","coordinates":[[0,0],[2,2]]}', '{"type":"LineString","coordinates":[[0,2],[2,0]]}', '{"type":"LineString","coordinates":[[5,5],[6,6]]}']
    assert [r.target_ref for r in quality.line_cross(ctx(spark, lines, cross=True)).collect()] == ["f0"]


def polygon(*rings):
    return '{"type":"Polygon","coordinates":[' + ",".join("[" + ",".join(f"[{x},{y}]" for x, y in [*r, r[0]]) + "]" for r in rings) + "]}"


def square(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d)]


COVERED = [  # shapes, pieces, holes
    ([square(0, 0, 1, 1)], 1, 0),
    ([square(0, 0, 3, 1), square(0, 2, 3, 3), square(0, 1, 1, 2), square(2, 1, 3, 2)], 1, 1),  # T-junctions at every corner
    ([square(0, 0, 2, 3), square(1, 0, 3, 1), square(1, 2, 3, 3), square(2.5, 0, 3, 3)], 1, 1),  # overlaps around a gap
    ([square(0, 0, 2, 2), square(0, 0, 2, 2), square(1, 1, 3, 3)], 1, 0),  # a copy, and crossing outlines
    ([square(0, 0, 1, 1), square(1, 1, 2, 2)], 2, 0),  # apart but for a point
    ([square(1, 0, 2, 1), square(0, 1, 1, 2), square(2, 1, 3, 2), square(1, 2, 2, 3)], 4, 1),  # four that touch around a place
    ([[(0, 0), (4, 0), (4, 4), (0, 4)], square(9, 9, 10, 10)], 2, 0),
    ([square(0, 0, 1, 3), square(1, 0, 2, 1), square(1, 2, 2, 3), square(2, 0, 3, 3), square(1.4, 1.4, 1.6, 1.6)], 2, 1),  # an island in the gap
    ([square(0, 0, 3, 1.5), square(0, 1.5, 3, 3)], 1, 0),
    ([polygon(square(0, 0, 9, 9), square(1, 1, 2, 2), square(3, 3, 4, 4))], 1, 2),
]


def test_coverage(spark):
    """Every case a layer."""
    rows = [(k, f"f{i}", s if isinstance(s, str) else polygon(s)) for k, (shapes, *_) in enumerate(COVERED) for i, s in enumerate(shapes)]
    p = spark.createDataFrame(rows, "layer_id int, key string, g string").select("layer_id", "key", G.from_geojson(F.col("g")).alias("geom"))
    assert {r.layer_id: (r.pieces, r.holes) for r in topology.coverage(p, 0.7).collect()} == {k: (pieces, holes) for k, (_, pieces, holes) in enumerate(COVERED)}


def test_lines_that_join_and_lines_that_run_along(spark):
    line = lambda *p: '{"type":"LineString","coordinates":[' + ",".join(f"[{x},{y}]" for x, y in p) + "]}"
    hits = lambda *ls: [r.target_ref for r in quality.line_cross(ctx(spark, list(ls), cross=True)).collect()]
    assert hits(line((0, 0), (1, 1)), line((1, 1), (2, 2))) == ["f0"]  # end to end in one straight line
    assert hits(line((0, 0), (1, 0)), line((1, 0), (1, 1))) == ["f0"]
    assert hits(line((0, 0), (2, 0)), line((1, 0), (3, 0))) == []  # a common part is no point
    assert hits(line((0, 0), (1, 0)), line((2, 0), (3, 0))) == [] and hits(line((0, 0), (1, 0)), line((0, 1), (1, 1))) == []
    assert hits(line((0, 0), (2, 0)), line((0, 1), (1, -1), (2, 1))) == []  # two points
    assert hits(line((0, 0), (0, 0), (1, 0)), line((0.5, -1), (0.5, 1))) == ["f0"]


@pytest.mark.parametrize(
    "rings, issue",
    [
        ([[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]]], None),
        ([[[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (2, 1), (1, 2)]]], None),  # a hole that touches in a corner
        ([[[(0, 0), (2, 2), (2, 0), (0, 2)]]], "self_intersection"),
        ([[[(0, 0), (4, 0), (4, 4), (0, 4)], [(3, 1), (5, 1), (5, 2), (3, 2)]]], "self_intersection"),
        ([[[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 1), (1, 1), (1, 2), (0, 2)]]], "self_intersection"),  # along the shell
        ([[[(0, 0), (4, 0), (4, 4), (0, 4)], [(6, 1), (7, 1), (7, 2), (6, 2)]]], "hole_outside_shell"),
        ([[[(0, 0), (9, 0), (9, 9), (0, 9)], [(1, 1), (8, 1), (8, 8), (1, 8)], [(2, 2), (3, 2), (3, 3), (2, 3)]]], "nested_holes"),
        ([[[(0, 0), (4, 0), (4, 4), (0, 4)]], [[(1, 1), (2, 1), (2, 2), (1, 2)]]], "nested_parts"),
        ([[[(0, 0), (9, 0), (9, 9), (0, 9)], [(1, 1), (8, 1), (8, 8), (1, 8)]], [[(2, 2), (3, 2), (3, 3), (2, 3)]]], None),  # a part in a hole
        ([[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(1, 1), (2, 1), (2, 2), (1, 2)]]], None),
    ],
)
def test_broken_polygons(rings, issue):
    parts = [[[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]] for r in part] for part in rings]
    assert overlay.broken_rule(parts) == issue


def test_broken_rule_becomes_a_finding(spark):
    quality.RULES["QH-ZZZ"] = quality.Rule("QH-ZZZ", "", "error", "dataset", lambda c: 1 / 0)
    try:
        got = quality.run(ctx(spark, []), spark, only=("QH-ZZZ",)).collect()
    finally:
        del quality.RULES["QH-ZZZ"]
    assert got[0].rule_code == "QH-RULE-ERROR"


def test_rule_that_fails_as_it_runs_hides_no_other(spark):
    quality.RULES["QH-ZZZ"] = quality.Rule("QH-ZZZ", "", "error", "feature", lambda c: quality.found(c.features.where(1 / F.col("ord") > 2), "GEOM-EMPTY", F.lit("x"), F.col("key")))
    try:
        got = quality.run(ctx(spark, [None, poly((0, 0), (1, 1), (1, 0))]), spark, only=("QH-ZZZ", "QH-GEOM-EMPTY")).collect()
    finally:
        del quality.RULES["QH-ZZZ"]
    assert {(r.rule_code, r.target_ref) for r in got} == {("QH-RULE-ERROR", None), ("QH-GEOM-EMPTY", "f0")}
    assert [r.message for r in got if r.rule_code == "QH-RULE-ERROR"][0].endswith("DIVIDE_BY_ZERO")


def test_dataset_digest_covers_every_part(spark):
    def digest(layer="l", ext="e", cls="c", props={"a": "1", "b": "x"}, x=0.0, twice=False):
        rows = [(1, layer, ext, cls, props, x), (1, "m", None, None, None, 5.0)] + [(1, layer, ext, cls, props, x)] * twice
        df = spark.createDataFrame(rows, "dataset_id int, layer_name string, external_id string, class string, properties map<string,string>, x double")
        return dedupe.dataset_digests(df.withColumn("geom", G.box(F.col("x"), F.lit(0.0), F.col("x") + 1, F.lit(1.0))).repartition(3)).first().digest

    same = digest()
    assert same == digest(props={"b": "x", "a": "1"})
    others = [digest(layer="k"), digest(ext="f"), digest(cls=None), digest(props={"a": "1"}), digest(x=0.001), digest(twice=True), digest(layer="le", ext="")]
    assert len({same, *others}) == len(others) + 1


def test_search_by_the_rarest_run(spark):
    titles = [("record", i, f"quy hoach khu {i}", 1) for i in range(300)] + [("record", 900, "quy hoach ven song", 1), ("unit", 901, "Vên", 2)]
    entities = spark.createDataFrame(titles, "kind string, id long, title string, place int")
    asked = spark.createDataFrame([("quy hoach",), ("HOACH VEN",), ("ven",), ("ve",), ("nothing",), ("",), ("khu 299",)], "q string")
    got = {}
    for r in search.search(asked, entities, 3).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    assert got == {"quy hoach": [0, 1, 2], "HOACH VEN": [900], "ven": [900, 901], "ve": [900, 901], "khu 299": [299]}


def test_overlay_of_many_edges():
    turn = [2 * math.pi * i / 3000 for i in range(3000)]
    ring = lambda x, r: np.array([[x + r * math.cos(t), r * math.sin(t), x + r * math.cos(u), r * math.sin(u)] for t, u in zip(turn, [*turn[1:], turn[0]], strict=True)])
    a, b = ring(0, 1), ring(1, 1)
    lens = 2 * math.pi / 3 - math.sqrt(3) / 2
    assert overlay.overlap_area(a, a) == pytest.approx(math.pi, rel=1e-5) and overlay.overlap_area(a, b) == pytest.approx(lens, rel=1e-5)
    assert overlay.overlap_area(a, ring(9, 1)) == 0 and overlay.overlap_area(a, ring(0, 0.5)) == pytest.approx(math.pi / 4, rel=1e-5)


def test_gate_and_tiles(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "official_vector", "pending", 1), (2, "b", "derived_machine_unreviewed", "pending", 2)], "dataset_id int, dataset_name string, derivation_level string, review_status string, version_id int")
    assert {(r.version_id, r.ok) for r in publish.gate(d).collect()} == {(1, True), (2, False)}
    ls = spark.createDataFrame([(1, 1), (2, 2)], "layer_id int, dataset_id int")
    f = spark.createDataFrame([(7, 1), (8, 2)], "id int, layer_id int").withColumn("geom", G.box(*[F.lit(v) for v in (105.0, 20.0, 105.01, 20.01)]))
    target = str(tmp_path / "t")
    out = {r.version_id: r for r in publish.publish(d, ls, f, target, max_zoom=3).collect()}
    assert (out[1].status, out[1].tile_count, out[1].feature_count, out[2].status, out[2].blocked, out[2].checksum) == ("published", 4, 4, "blocked", [2], None)
    assert publish.read_tile(spark, target, 1, 0, 0, 0).first().ids == [7]
    with pytest.raises(LookupError):
        publish.read_tile(spark, target, 2, 0, 0, 0)
    again = {r.version_id: r for r in publish.publish(d, ls, f, target, max_zoom=2, allow_unreviewed=True).collect()}
    assert again[1].tile_count == 3 and [e.tiles for e in again[1].events] == [4, 3] and again[2].status == "published"
    assert {tuple(r) for r in publish.published_datasets(spark, target).collect()} == {(1, 1), (2, 2)}


def test_failed_publication_leaves_the_old_one(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(1, "a", "official_vector", "pending", 1)], "dataset_id int, dataset_name string, derivation_level string, review_status string, version_id int")
    ls, target = spark.createDataFrame([(1, 1)], "layer_id int, dataset_id int"), str(tmp_path / "t")
    f = spark.createDataFrame([(7, 1)], "id int, layer_id int").withColumn("geom", G.box(*[F.lit(v) for v in (105.0, 20.0, 105.01, 20.01)]))
    publish.publish(d, ls, f, target, max_zoom=1)
    before = publish.publications(spark, target).read().collect()
    monkeypatch.setattr(publish.StateTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        publish.publish(d, ls, f.withColumn("id", F.lit(9)), target, max_zoom=1)
    assert publish.publications(spark, target).read().collect() == before
    assert publish.read_tile(spark, target, 1, 1, 1, 0).first().ids == [7]


def test_tiles_are_cut_into_chunks(spark):
    f = spark.range(500).select("id", F.lit(1).alias("version_id"), G.box(*[F.lit(v) for v in (105.0, 20.0, 105.01, 20.01)]).alias("geom"))
    rows = publish.tiles(f, 0, 1, geometry=False, chunk=40).collect()
    for z in (0, 1):
        own = [r for r in rows if r.z == z]
        assert sorted(i for r in own for i in r.ids) == list(range(500)) and len({r.chunk for r in own}) == len(own) > 8
        assert all(r.n == len(r.ids) <= 80 and r.ids == sorted(r.ids) for r in own)


def test_tasks_conflict(spark):
    t = spark.createDataFrame([(1, "pending"), (2, "done"), (3, "pending")], "task_id int, status string")
    got = {r.task_id: (r.status, r.outcome) for r in versions.resolve_tasks(t, spark.createDataFrame([(1, "done"), (2, "done"), (3, "maybe")], "task_id int, decision string")).collect()}
    assert got == {1: ("done", "resolved"), 2: ("done", "conflict"), 3: ("pending", "bad_decision")}


def test_payloads(spark):
    row = lambda body: spark.createDataFrame([("s", "https://h/x?y=1", body)], "source_key string, url string, body string")
    assert payloads.sitemap(row("<urlset><url><loc>https://h/a.pdf</loc></url><url><loc>https://h/b</loc></url></urlset>"), include=(r"\.pdf$",)).first().filename == "a.pdf"
    assert payloads.feed(row("<feed><entry><id>1</id><link href='https://h/p'/><link rel='enclosure' href='https://h/f.pdf'/></entry></feed>")).first().url == "https://h/f.pdf"
    wms = "<Layer><Title>g</Title><Layer queryable='1'><Title>A &amp; B</Title><Name>a</Name><Style><Name>s</Name></Style></Layer><wms:Layer><wms:Name>b</wms:Name></wms:Layer></Layer><!-- <Layer><Name>c</Name></Layer> -->"
    assert [(r.identity, r.metadata["title"]) for r in payloads.wms_layers(row(wms)).collect()] == [("wms:a", "A & B"), ("wms:b", "b")]
    html = row("<a href=/a?x=1&amp;y=2>one</a><a href=v&#233;&#xE9;.pdf?&#38;lt;>n</a><a class=k href='b.pdf' data-href='z'>two</a>").withColumn("page", F.lit(1))
    assert [r.link for r in payloads.links(html).orderBy("ord").collect()] == ["https://h/a?x=1&y=2", "https://h/véé.pdf?&lt;", "https://h/b.pdf"]
    assert payloads.ckan(row("not json")).count() == 0 and payloads.wfs_types(row("")).count() == 0
    assert payloads.arcgis_layers(row('{"id":3,"name":"n","fields":[{"name":"FID","type":"esriFieldTypeOID"}]}')).first().metadata["oid"] == "FID"


@pytest.mark.parametrize("body, ok", [('var x = {"type":"FeatureCollection","features":[]};', True), ('var x = {"type":"Feature"};', False), ('var x = {"type":"FeatureCollection","features":{}};', False), ("var x = {bad", False)])
def test_js_variable(spark, body, ok):
    assert (spark.range(1).select(files.unwrap_js(F.lit(body))).first()[0] is not None) == ok
