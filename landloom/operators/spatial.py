"""Spatial joins by grid cells: points to geometries, geometries to geometries, geometries to tiles.

Both sides are keyed by the cells that their boxes cover and joined by equality; a pair is kept in one cell only, so no
distinct is needed. Boxes of either side that cover more than WIDE_CELLS cells are keyed by coarser cells, eight times as
wide at each level, so one national polygon doesn't make millions of keys; levels that a side doesn't use are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

WIDE_CELLS = 64
LEVELS = 6


def cells(minx: Column, miny: Column, maxx: Column, maxy: Column, size: Column) -> Column:
    """array<struct<cx, cy>> of the cells a box touches."""
    xs = F.sequence(F.floor(minx / size), F.floor(maxx / size))
    return F.flatten(F.transform(xs, lambda cx: F.transform(F.sequence(F.floor(miny / size), F.floor(maxy / size)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def _level(minx: Column, miny: Column, maxx: Column, maxy: Column, size: float) -> Column:
    """The first level at which the box covers few cells."""
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        s = size * 8**k
        out = F.when((F.floor(maxx / s) - F.floor(minx / s) + 1) * (F.floor(maxy / s) - F.floor(miny / s) + 1) <= WIDE_CELLS, k).otherwise(out)
    return out


def _keyed(df: DataFrame, others: DataFrame, box: tuple[str, ...], size: float, at_home: tuple[int, ...], away: int) -> DataFrame:
    """df once for each cell and turn: at its own level in the turns at_home, and at wider levels, where the other side has
    rows of its own, in the turn away."""
    turn = lambda k, t, guest: F.struct(k.alias("_lv"), F.lit(t).alias("_turn"), F.lit(guest).alias("_guest"))
    wider = F.filter(F.array(*[F.lit(k) for k in range(LEVELS)]), lambda k: k > F.col("_own"))
    turns = F.concat(F.array(*[turn(F.col("_own"), t, False) for t in at_home]), F.transform(wider, lambda k: turn(k, away, True)))
    width = F.element_at(F.array(*[F.lit(size * 8**k) for k in range(LEVELS)]), F.col("_lv") + 1)
    levels = df.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("_lv"), F.lit(False).alias("_guest"))
    used = levels.union(others.select("_own", F.lit(True)).distinct()).agg(F.collect_set(F.struct("_lv", "_guest")).alias("_used"))  # 2 LEVELS at most
    own = df.columns
    met = F.filter(turns, lambda t: F.array_contains("_used", F.struct(t["_lv"].alias("_lv"), t["_guest"].alias("_guest"))))  # before cells are made
    out = df.crossJoin(F.broadcast(used)).select(*own, F.inline(met)).drop("_own", "_guest").withColumn("_w", width)
    return out.select("*", F.inline(cells(*map(F.col, box), F.col("_w"))).alias("_cx", "_cy"))


def box_join(left: DataFrame, right: DataFrame, lbox: tuple[str, str, str, str], rbox: tuple[str, str, str, str], size: float, on: list[str] | None = None) -> DataFrame:
    """All pairs whose boxes meet (sides included), and that agree in the `on` columns. Each box has the level where it is
    few cells, and a pair meets at the wider level of its two: in turn 0 left boxes of the level meet right ones of it or
    below, in turn 1 right boxes of the level meet left ones below. So two boxes below a level never meet at it, and no box
    of either side is more than WIDE_CELLS cells at a level. The pair is kept in the cell of the larger lower corner."""
    a, b = (df.withColumn("_own", _level(*map(F.col, box), size)) for df, box in ((left, lbox), (right, rbox)))
    met = _keyed(a, b, lbox, size, (0,), 1).join(_keyed(b, a, rbox, size, (0, 1), 0).drop("_w"), [*(on or []), "_lv", "_turn", "_cx", "_cy"])
    lx, ly, hx, hy = (F.col(c) for c in lbox)
    rx, ry, sx, sy = (F.col(c) for c in rbox)
    once = (F.floor(F.greatest(lx, rx) / F.col("_w")) == F.col("_cx")) & (F.floor(F.greatest(ly, ry) / F.col("_w")) == F.col("_cy"))
    return met.where((lx <= sx) & (hx >= rx) & (ly <= sy) & (hy >= ry) & once).drop("_lv", "_turn", "_cx", "_cy", "_w")


def within_distance(points: DataFrame, features: DataFrame, metres: float, geom: str = "geom", size: float = 5000.0) -> DataFrame:
    """points(point_id, lon, lat) x features with a geometry within so many web-mercator metres, and distance_m."""
    x, y = G.mercator_x(F.col("lon")), G.mercator_y(F.col("lat"))
    p = points.select("*", (x - metres).alias("_px0"), (y - metres).alias("_py0"), (x + metres).alias("_px1"), (y + metres).alias("_py1"))
    g = F.col(geom)
    f = features.select("*", G.mercator_x(g["minx"]).alias("_fx0"), G.mercator_y(g["miny"]).alias("_fy0"), G.mercator_x(g["maxx"]).alias("_fx1"), G.mercator_y(g["maxy"]).alias("_fy1"))
    pairs = box_join(p, f, ("_px0", "_py0", "_px1", "_py1"), ("_fx0", "_fy0", "_fx1", "_fy1"), size)
    near = pairs.withColumn("distance_m", G.distance_3857(F.col(geom), F.col("lon"), F.col("lat"))).where(F.col("distance_m") <= metres)
    return near.drop("_px0", "_py0", "_px1", "_py1", "_fx0", "_fy0", "_fx1", "_fy1")


def nearest(points: DataFrame, features: DataFrame, metres: float, k: int, tie: str, **settings) -> DataFrame:
    """The k nearest of within_distance for each point, rank added."""
    w = Window.partitionBy("point_id").orderBy("distance_m", tie)
    return within_distance(points, features, metres, **settings).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def points_in(points: DataFrame, features: DataFrame, geom: str = "geom", size: float = 0.05) -> DataFrame:
    """points(lon, lat) x the polygons that contain them."""
    p = points.select("*", F.col("lon").alias("_px0"), F.col("lat").alias("_py0"), F.col("lon").alias("_px1"), F.col("lat").alias("_py1"))
    g = F.col(geom)
    f = features.select("*", g["minx"].alias("_fx0"), g["miny"].alias("_fy0"), g["maxx"].alias("_fx1"), g["maxy"].alias("_fy1"))
    met = box_join(p, f, ("_px0", "_py0", "_px1", "_py1"), ("_fx0", "_fy0", "_fx1", "_fy1"), size)
    return met.where(G.contains_point(F.col(geom), F.col("lon"), F.col("lat"))).drop("_px0", "_py0", "_px1", "_py1", "_fx0", "_fy0", "_fx1", "_fy1")


def tile_cover(features: DataFrame, min_zoom: int, max_zoom: int, geom: str = "geom") -> DataFrame:
    """features x the tiles z, x, y that their boxes touch."""
    g = F.col(geom)
    zoomed = features.withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    z = F.col("z")
    with_x = zoomed.withColumn("x", F.explode(F.sequence(G.tile_x(g["minx"], z), G.tile_x(g["maxx"], z))))
    return with_x.withColumn("y", F.explode(F.sequence(G.tile_y(g["maxy"], z), G.tile_y(g["miny"], z))))


def grid(bbox: tuple[float, float, float, float], step: float, spark) -> DataFrame:
    """Probe points of a lattice: ord, lon, lat, row by row, end sides included."""
    nx, ny = (int((bbox[k + 2] - bbox[k]) / step + 1e-9) + 1 for k in (0, 1))
    i = F.col("id")
    return spark.range(nx * ny).select(i.alias("ord"), (F.lit(bbox[0]) + (i % nx) * step).alias("lon"), (F.lit(bbox[1]) + F.floor(i / nx) * step).alias("lat"))
