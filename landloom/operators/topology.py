"""Outlines of layers: what all polygons of a layer cover together, as counts of its pieces and holes.

Edges are noded first: pairs whose boxes meet, found by grid cells, split each other where they cross, touch or run along
each other. Then a piece of an edge is on the outline if just one side of it is covered: polygons that have it as an edge
cover the side of their inside, and it is inside others that hold its middle. Outlines are linked to rings by the order of
their pieces around each corner, once along the covered side, which gives the pieces of the whole, and once along the
open side, which gives its holes; a ring's pieces find their smallest by doubling steps, each written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import discard, materialise
from . import spatial

#: Corners are rounded to so many decimals of a degree; nearer ones are one.
DECIMALS = 9
NEAR = 10.0**-DECIMALS


def _snapped(p: Column) -> Column:
    return F.struct(F.round(p["x"], DECIMALS).alias("x"), F.round(p["y"], DECIMALS).alias("y"))


def directed_edges(polygons: DataFrame) -> DataFrame:
    """polygons(layer_id, key, geom) -> layer_id, key, a, b: all ring edges with the polygon on their left."""
    ring = polygons.select("layer_id", "key", F.explode("geom.parts").alias("part")).select("layer_id", "key", F.posexplode("part").alias("n", "ring"))
    left = (G.planar_area(F.col("ring")) >= 0) == (F.col("n") == 0)
    e = ring.select("layer_id", "key", F.explode(G.segments(F.when(left, F.col("ring")).otherwise(F.reverse("ring")))).alias("s"))
    return e.select("layer_id", "key", _snapped(F.col("s.a")).alias("a"), _snapped(F.col("s.b")).alias("b")).where("a <> b")


def noded(edges: DataFrame, cell: float) -> DataFrame:
    """edges(layer_id, key, a, b), split where they meet: their pieces, in the edges' directions."""
    e = materialise(edges.withColumn("id", F.monotonically_increasing_id()), "edges")
    low, high = (lambda c: F.least(f"a.{c}", f"b.{c}")), (lambda c: F.greatest(f"a.{c}", f"b.{c}"))
    boxed = e.select("layer_id", "id", F.struct("a", "b").alias("e"), low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))
    side = lambda s: boxed.select("layer_id", *[F.col(c).alias(f"{s}_{c}") for c in boxed.columns if c != "layer_id"])
    box = lambda s: tuple(f"{s}_{c}" for c in ("x0", "y0", "x1", "y1"))
    p = spatial.box_join(side("s"), side("t"), box("s"), box("t"), cell, on=["layer_id"]).where("s_id < t_id").select("layer_id", "s_id", "t_id", F.col("s_e").alias("s"), F.col("t_e").alias("t"))
    across = lambda e, o: F.expr(f"({e}.b.x - {e}.a.x) * ({o}.y - {e}.a.y) - ({e}.b.y - {e}.a.y) * ({o}.x - {e}.a.x)")
    length = lambda e: F.expr(f"sqrt(power({e}.b.x - {e}.a.x, 2) + power({e}.b.y - {e}.a.y, 2))")
    along = lambda e, o: F.expr(f"(({o}.x - {e}.a.x) * ({e}.b.x - {e}.a.x) + ({o}.y - {e}.a.y) * ({e}.b.y - {e}.a.y)) / power({length_of[e]}, 2)")
    length_of = {"s": "ls", "t": "lt"}
    p = p.withColumn("ls", length("s")).withColumn("lt", length("t"))
    # an end of one edge that lies on the other
    on = lambda e, o: F.when((F.abs(across(e, o)) <= NEAR * F.col(length_of[e])) & along(e, o).between(0, 1), F.expr(o))
    touch = [on("t", "s.a"), on("t", "s.b"), on("s", "t.a"), on("s", "t.b")]
    p = p.withColumns({f"end{i}": c for i, c in enumerate(touch)})
    det = F.expr("(s.b.x - s.a.x) * (t.b.y - t.a.y) - (s.b.y - s.a.y) * (t.b.x - t.a.x)")
    u = F.expr("((t.a.x - s.a.x) * (t.b.y - t.a.y) - (t.a.y - s.a.y) * (t.b.x - t.a.x)) / nullif(det, 0)")
    v = F.expr("((t.a.x - s.a.x) * (s.b.y - s.a.y) - (t.a.y - s.a.y) * (s.b.x - s.a.x)) / nullif(det, 0)")
    apart = F.coalesce(*[F.col(f"end{i}") for i in range(4)]).isNull()
    p = p.withColumn("det", det).withColumn("cross", F.when(apart & (F.col("det") != 0) & u.between(0, 1) & v.between(0, 1), _snapped(F.struct((F.expr("s.a.x") + u * F.expr("s.b.x - s.a.x")).alias("x"), (F.expr("s.a.y") + u * F.expr("s.b.y - s.a.y")).alias("y")))))
    cut = lambda e, ends: p.select(F.col(f"{e}_id").alias("id"), F.explode(F.array_compact(F.array("cross", *ends))).alias("at"))
    cuts = cut("t", ("end0", "end1")).union(cut("s", ("end2", "end3"))).groupBy("id").agg(F.collect_set("at").alias("ats"))
    place = lambda q: (q["x"] - F.col("a.x")) * F.expr("b.x - a.x") + (q["y"] - F.col("a.y")) * F.expr("b.y - a.y")
    corners = F.array_sort(F.transform(F.array_union(F.coalesce("ats", F.array().cast("array<struct<x:double,y:double>>")), F.array("a", "b")), lambda q: F.struct(place(q).alias("at"), q.alias("q"))))
    pieces = e.join(cuts, "id", "left").withColumn("c", corners)
    step = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.get(F.col("c"), i - 1)["q"].alias("a"), F.get(F.col("c"), i)["q"].alias("b")))
    out = materialise(pieces.select("layer_id", "key", F.explode(step).alias("p")).select("layer_id", "key", "p.a", "p.b").where("a <> b"), "pieces")
    discard(e)
    return out


def outline(polygons: DataFrame, cell: float) -> DataFrame:
    """layer_id, a, b: the pieces of edges that have a covered side and an open one, the covered one on their left."""
    pieces = noded(directed_edges(polygons), cell)
    both = pieces.select("layer_id", "key", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("a") <= F.col("b")).alias("ahead"))
    sides = both.groupBy("layer_id", "lo", "hi").agg(F.bool_or("ahead").alias("one"), F.bool_or(~F.col("ahead")).alias("other"), F.collect_set("key").alias("keys")).where("one <> other")
    sides = materialise(sides.withColumns({"mx": F.expr("(lo.x + hi.x) / 2"), "my": F.expr("(lo.y + hi.y) / 2")}), "sides")
    middles = sides.select("layer_id", "lo", "hi", "keys", *[F.col(c).alias(n) for c, n in (("mx", "px0"), ("my", "py0"), ("mx", "px1"), ("my", "py1"))])
    boxes = polygons.select("layer_id", "key", "geom", *[F.col(f"geom.{c}").alias(f"f_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    held = spatial.box_join(middles, boxes, ("px0", "py0", "px1", "py1"), ("f_minx", "f_miny", "f_maxx", "f_maxy"), cell, on=["layer_id"])
    inside = held.where(~F.array_contains("keys", F.col("key")) & G.contains_point(F.col("geom"), F.col("px0"), F.col("py0"))).select("layer_id", "lo", "hi").distinct()
    left = sides.join(inside, ["layer_id", "lo", "hi"], "left_anti")
    return left.select("layer_id", F.when(F.col("one"), F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("one"), F.col("hi")).otherwise(F.col("lo")).alias("b"))


def _rings(pieces: DataFrame, turn: str) -> DataFrame:
    """layer_id, area of each ring of directed pieces(layer_id, id, a, b, next_<turn>): every piece takes the smallest id that
    it reaches, doubling its reach in each round."""
    step = materialise(pieces.select("layer_id", "id", F.col(f"next_{turn}").alias("next"), F.col("id").alias("low"), (F.expr("a.x * b.y - b.x * a.y") / 2).alias("area")), "rings")
    while True:
        far = step.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("low").alias("far_low"))
        low = F.least("low", "far_low")
        moved = materialise(step.join(far, "next").select("layer_id", "id", F.col("far").alias("next"), low.alias("low"), "area", (low != F.col("low")).alias("changed")), "rings")
        discard(step)
        step = moved
        if moved.where("changed").isEmpty():
            return step.groupBy("layer_id", "low").agg(F.sum("area").alias("area"))


def coverage(polygons: DataFrame, cell: float = 0.05) -> DataFrame:
    """polygons(layer_id, key, geom) -> layer_id, pieces, holes of what the layer's polygons cover together. Pieces that
    touch in a point are apart; a hole may touch the outside in a point. A layer whose pieces don't alternate around a
    corner (corners nearer than DECIMALS tell apart) has nulls. Polygons of a layer that are equal count once: copies cover
    nothing more, and their edges would all meet each other."""
    polygons = materialise(polygons.groupBy("layer_id", "geom").agg(F.min("key").alias("key")).select("layer_id", "key", "geom"), "polygons")
    pieces = materialise(outline(polygons, cell).withColumn("id", F.monotonically_increasing_id()), "outline")
    ray = lambda at, to, end: pieces.select("layer_id", F.col(at).alias("at"), F.atan2(F.col(f"{to}.y") - F.col(f"{at}.y"), F.col(f"{to}.x") - F.col(f"{at}.x")).alias("angle"), "id", F.lit(end).alias("ends"))
    around = Window.partitionBy("layer_id", "at").orderBy("angle", "ends")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("id", "ends")
    rays = ray("a", "b", False).union(ray("b", "a", True))
    linked = rays.withColumn("open", F.coalesce(F.lead(one).over(around), F.first(one).over(whole))).withColumn("covered", F.coalesce(F.lag(one).over(around), F.last(one).over(whole))).where("ends")
    next_ = linked.select("layer_id", "id", F.col("open.id").alias("next_open"), F.col("covered.id").alias("next_covered"), (F.col("open.ends") | F.col("covered.ends")).alias("odd"))
    odd = next_.where("odd").select("layer_id").distinct()
    sound = materialise(pieces.join(next_.drop("layer_id"), "id").join(odd, "layer_id", "left_anti"), "linked")
    parts = _rings(sound, "covered").groupBy("layer_id").agg(F.count_if(F.col("area") > 0).alias("pieces"))
    holes = _rings(sound, "open").groupBy("layer_id").agg(F.count_if(F.col("area") < 0).alias("holes"))
    return polygons.select("layer_id").distinct().join(parts, "layer_id", "left").join(holes, "layer_id", "left")
