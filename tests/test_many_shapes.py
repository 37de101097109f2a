"""Shapes by the many: judged and quantised together as one by one, dealt over tasks, copies counted once."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from landloom.functions import geometry as G
from landloom.functions import overlay
from landloom.operators import quality as Q
from landloom.operators import publish, topology
from landloom.plans import catalog, quality_queries
from landloom.storage import materialise

PARTS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def _ring(*p):
    return [{"x": float(x), "y": float(y)} for x, y in (*p, p[0])]


def _box(a, b, c, d):
    return _ring((a, b), (c, b), (c, d), (a, d))


def _drawn(rng):
    ring = lambda: _ring(*[(rng.randrange(6), rng.randrange(6)) for _ in range(rng.choice((3, 4)))]) if rng.random() < 0.2 else _box(x := rng.randrange(6), y := rng.randrange(6), x + rng.choice((1, 3)), y + rng.choice((1, 3)))
    return [[ring() for _ in range(rng.choice((1, 1, 2)))] for _ in range(rng.choice((1, 1, 2)))]


def test_rules_of_many_polygons_are_those_of_each():
    rng = random.Random(3)
    shapes = [_drawn(rng) for _ in range(1500)] + [None, [], [[]], [[_box(0, 0, 9, 9), _box(1, 1, 8, 8), _box(2, 2, 7, 7)]], [[_box(0, 0, 9, 9)], [_box(1, 1, 2, 2)]], [[_ring((0, 0), (0, 0), (1, 0), (1, 1))]], [[[]]]]
    want = [overlay.broken_rule(s) if s != [[[]]] else "self_intersection" for s in shapes]
    assert {"self_intersection", "hole_outside_shell", "nested_holes", "nested_parts", None} == set(want)
    array = pa.array(shapes, PARTS)
    assert list(overlay.broken_rules(array)[:-1]) == want[:-1] and list(overlay.broken_rules(array.slice(200, 900))) == want[200:1100]


def test_tile_shapes_are_cut_as_rings_are(spark):
    rng = random.Random(4)
    shapes = [_drawn(rng) for _ in range(200)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "id int, parts array<array<array<struct<x:double,y:double>>>>")
    told = rows.select("id", overlay.tile_geometry("parts", G.tile_bounds(F.lit(7), F.lit(65), F.lit(63))).alias("s"), G.tile_bounds(F.lit(7), F.lit(65), F.lit(63)).alias("b"))
    import math

    merc = lambda lat: math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    some = 0
    for r in told.collect():
        b, want = r.b, []
        for part in shapes[r.id]:
            unit = [[{"x": (q["x"] - b.minx) / (b.maxx - b.minx), "y": (merc(b.maxy) - merc(q["y"])) / (merc(b.maxy) - merc(b.miny))} for q in ring] for ring in part]
            cut = [c for c in (overlay.clip_ring(u, -64 / 4096, -64 / 4096, 1 + 64 / 4096, 1 + 64 / 4096) for u in unit) if c]
            if cut:
                want.append([[(round(q["x"] * 4096), round(q["y"] * 4096)) for q in c] for c in cut])
        assert [[[tuple(q) for q in ring] for ring in part] for part in r.s] == want
        some += bool(want)
    assert some > 20


def test_groups_of_high_numbers_stay_in_the_extent(spark, tmp_path):
    spark.range(6_600_000, 6_600_012).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted((r.target_ref, r.message) for r in quality_queries.faulty_shapes(spark, str(tmp_path)).collect())
    says = ["self_intersection", "geometry collection", "outside the expected extent", "hole_outside_shell", "nested_holes"]
    assert got == sorted((f"p{k}", says[k % 6]) for k in range(6_600_000, 6_600_012) if k % 6 < 5)


def test_rows_that_make_much_work_are_dealt(spark, monkeypatch):
    f = spark.range(60_000).coalesce(1).select("id", F.lit(1).alias("version_id"), G.box(*[F.lit(v) for v in (105.0, 20.0, 105.01, 20.01)]).alias("geom"))
    dealt = []
    monkeypatch.setattr(publish.spatial, "tile_cover", lambda df, *a, own=publish.spatial.tile_cover: dealt.append(df.rdd.getNumPartitions()) or own(df, *a))
    publish.tiles(f, 0, 0, geometry=False)
    assert dealt == [3]


def _context(spark, shapes):
    f = spark.createDataFrame([(1, i // 2, f"k{i}", [s]) for i, s in enumerate(shapes)], "layer_id int, ord int, key string, parts array<array<array<struct<x:double,y:double>>>>")
    f = f.select("layer_id", F.col("ord"), "key", G.make(F.lit("Polygon"), F.col("parts")).alias("geom"))
    return f, spark.createDataFrame([(1, "L", 1, True)], "layer_id int, layer_name string, dataset_id int, overlap boolean")


def test_overlaps_of_boxes_and_others(spark):
    """Boxes by their sides, others by their shapes, in layers of both; a Z of five places along its box is no box."""
    shapes = [[_box(0, 0, 2, 2)], [_box(0, 0, 2, 2)], [_box(1, 1, 3, 3)], [_box(2, 2, 3, 3)], [_ring((0, 0), (2, 0), (0, 2))], [_ring((2, 0.1), (2, 2), (1.9, 2))], [_box(0, 0, 3, 3), _box(0.5, 0.5, 2.5, 2.5)]]
    f, layers = _context(spark, shapes)
    f = f.withColumn("ord", F.substring("key", 2, 9).cast("int"))
    got = {(r.target_ref, r.message) for r in Q.poly_overlap(Q.Context(f, layers, None, cell=1.0)).collect()}
    area = lambda a, b: overlay.overlap_area(overlay.edges([shapes[a]]), overlay.edges([shapes[b]]))
    assert got == {(f"k{a}", f"overlaps k{b}") for a in range(7) for b in range(a + 1, 7) if area(a, b) > 1e-8}
    assert [r.b for r in f.orderBy("ord").select(G.is_box(F.col("geom")).alias("b")).collect()] == [True, True, True, True, False, False, False]


def test_copies_at_one_place_in_two_files_are_duplicates(spark):
    f, layers = _context(spark, [[_box(0, 0, 1, 1)]] * 2 + [[_box(5, 5, 6, 6)]])
    assert [(r.target_ref, r.message) for r in Q.geom_duplicate(Q.Context(f, layers)).collect()] == [("k1", "duplicate of k0")]


def test_copies_of_a_polygon_cover_once(spark, monkeypatch):
    """A thousand copies of four boxes around a gap bring the edges of four."""
    shapes = [[_box(0, 0, 3, 1)], [_box(0, 2, 3, 3)], [_box(0, 1, 1, 2)], [_box(2, 1, 3, 2)]] * 250
    f, _ = _context(spark, shapes)
    edges = []
    monkeypatch.setattr(topology, "noded", lambda e, cell, own=topology.noded: edges.append(e.count()) or own(e, cell))
    assert [tuple(r) for r in topology.coverage(materialise(f, "copies").select("layer_id", "key", "geom"), 1.0).collect()] == [(1, 1, 1)]
    assert edges == [16]


def test_features_of_high_numbers_are_no_copies(spark, tmp_path):
    """Boxes come again after 210,000 ids: two of one layer at other places of their files."""
    ids = [(i, f"n{i}", 3, 1.0, "m") for i in (1, 2, 210_002, 420_002)]
    spark.createDataFrame(ids, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert "QH-GEOM-DUPLICATE" not in {r.state for r in catalog.QUERIES["vector_ingest"](spark, str(tmp_path)).collect()}
