"""Geometry as a struct of rings with a bounding box: construction, measure, predicates, projections and tiles.

struct<gtype, srid, parts: array<array<array<struct<x,y>>>>, minx, miny, maxx, maxy>; parts hold rings (the outer ring
first, even-odd fill), a line has one ring per part, a point one ring of one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
POINT = "struct<x:double,y:double>"
SCHEMA = f"struct<gtype:string,srid:int,parts:array<array<array<{POINT}>>>,minx:double,miny:double,maxx:double,maxy:double>"
#: The extent that coordinates in degrees are expected in.
EXTENT = (100.0, 5.0, 117.0, 26.0)


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def make(gtype: Column, parts: Column, srid: int = 4326) -> Column:
    """A geometry of its parts, its bounding box worked out; null parts make a null geometry."""

    def boxed(p: Column) -> Column:
        places = F.flatten(F.flatten(p))
        xs, ys = F.transform(places, lambda q: q["x"]), F.transform(places, lambda q: q["y"])
        return F.struct(gtype.alias("gtype"), F.lit(srid).alias("srid"), p.alias("parts"), F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))

    return F.when(parts.isNotNull(), let(parts, boxed))


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    ring = F.array(xy(minx, miny), xy(maxx, miny), xy(maxx, maxy), xy(minx, maxy), xy(minx, miny))
    return F.struct(F.lit("Polygon").alias("gtype"), F.lit(4326).alias("srid"), F.array(F.array(ring)).alias("parts"), minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


def is_box(g: Column) -> Column:
    """Whether a geometry is one ring along its bounding box, each side once."""
    ring = F.get(F.get(g["parts"], F.lit(0)), F.lit(0))
    corner = lambda p: p["x"].isin(g["minx"], g["maxx"]) & p["y"].isin(g["miny"], g["maxy"])
    one = (F.size(g["parts"]) == 1) & (F.size(F.get(g["parts"], F.lit(0))) == 1) & (F.size(ring) == 5) & (F.get(ring, F.lit(0)) == F.get(ring, F.lit(4)))
    straight = lambda s: (s["a"]["x"] == s["b"]["x"]) != (s["a"]["y"] == s["b"]["y"])
    return F.coalesce(one & (F.size(F.array_distinct(ring)) == 4) & F.forall(ring, corner) & F.forall(segments(ring), straight), F.lit(False))


def line(points: Column) -> Column:
    return make(F.lit("LineString"), F.array(F.array(points)))


def _parts(kind: Column, coords: Column) -> Column:
    """Parts, rings and places of a geometry's coordinates as JSON text."""
    place = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(r, place)
    read = lambda depth: F.from_json(F.concat(F.lit('{"c":'), coords, F.lit("}")), f"c {'array<' * depth}double{'>' * depth}")["c"]
    return (
        F.when(kind == "Polygon", F.array(F.transform(read(3), ring)))
        .when(kind == "MultiPolygon", F.transform(read(4), lambda p: F.transform(p, ring)))
        .when(kind == "LineString", F.array(F.array(F.transform(read(2), place))))
        .when(kind == "MultiLineString", F.transform(read(3), lambda r: F.array(F.transform(r, place))))
        .when(kind == "Point", F.array(F.array(F.array(place(read(1))))))
        .when(kind == "MultiPoint", F.transform(read(2), lambda p: F.array(F.array(place(p)))))
    )


def from_geojson(text: Column) -> Column:
    """Geometry of a GeoJSON geometry text; heights are dropped; a collection has the parts of its members; unknown types and
    bad JSON give null."""
    kind = F.get_json_object(text, "$.type")
    members = F.from_json(text, "geometries array<struct<type:string,coordinates:string>>")["geometries"]
    together = F.flatten(F.array_compact(F.transform(members, lambda m: _parts(m["type"], m["coordinates"]))))
    return make(kind, F.when(kind == "GeometryCollection", together).otherwise(_parts(kind, F.get_json_object(text, "$.coordinates"))))


def geometry_text(g: Column) -> Column:
    """Type and places (nine decimals) of a geometry as one text, the same wherever it was read from; null for none."""
    ring = lambda r: F.array_join(F.transform(r, lambda p: F.format_string("%.9f %.9f", p["x"], p["y"])), ",")
    return F.concat(g["gtype"], F.lit("|"), F.array_join(F.transform(g["parts"], lambda p: F.array_join(F.transform(p, ring), ";")), "/"))


def to_geojson(g: Column) -> Column:
    """GeoJSON text of polygons and of boxes."""
    rings = F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    return F.when(g["gtype"] == "Polygon", F.to_json(F.struct(g["gtype"].alias("type"), rings[0].alias("coordinates")))).otherwise(F.to_json(F.struct(g["gtype"].alias("type"), rings.alias("coordinates"))))


def force_2d(points: Column) -> Column:
    """Places of arrays [x, y, z...]."""
    return F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def segments(ring: Column) -> Column:
    """array<struct<a, b>> of consecutive places."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))


def _ring_sum(ring: Column, term) -> Column:
    return let(ring, lambda r: F.aggregate(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), F.struct(F.lit(0.0).alias("s"), r[0].alias("p")), lambda acc, q: F.struct((acc["s"] + term(acc["p"], q)).alias("s"), q.alias("p")), lambda acc: acc["s"]))


def planar_area(ring: Column) -> Column:
    """Signed area in the units of the coordinates; counter-clockwise is positive."""
    return _ring_sum(ring, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]) / 2)


def authalic(lat: Column) -> Column:
    """q of the ellipsoid's equal-area latitude."""
    s = F.sin(F.radians(lat))
    return (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E * s) / (1 + E * s)) / (2 * E))


def ring_area_m2(ring: Column) -> Column:
    """Ellipsoidal area of a ring in degrees; edges are straight in (longitude, q)."""
    return F.abs(_ring_sum(ring, lambda a, b: F.radians(b["x"] - a["x"]) * (authalic(a["y"]) + authalic(b["y"])) / 2)) * A * A / 2


def area_m2(g: Column) -> Column:
    """Outer rings less holes."""
    part = lambda p: F.aggregate(p, F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("f")), lambda acc, r: F.struct((acc["s"] + acc["f"] * ring_area_m2(r)).alias("s"), F.lit(-1.0).alias("f")), lambda acc: acc["s"])
    return F.when(g["gtype"].isin("Polygon", "MultiPolygon"), F.aggregate(g["parts"], F.lit(0.0), lambda s, p: s + part(p))).otherwise(0.0)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * A


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * A


def contains_point(g: Column, x: Column, y: Column) -> Column:
    """Even-odd test over all rings; a lower edge counts, an upper one doesn't."""
    crossing = lambda a, b: ((a["y"] <= y) != (b["y"] <= y)) & (x < a["x"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"]))
    ring = lambda r: _ring_sum(r, lambda a, b: F.when(a["y"] == b["y"], 0.0).when(crossing(a, b), 1.0).otherwise(0.0))
    total = F.aggregate(g["parts"], F.lit(0.0), lambda s, p: F.aggregate(p, s, lambda t, r: t + ring(r)))
    near = (x >= g["minx"]) & (x <= g["maxx"]) & (y >= g["miny"]) & (y <= g["maxy"])
    return F.when(near & g["gtype"].isin("Polygon", "MultiPolygon"), total % 2 == 1).otherwise(False)


def distance_3857(g: Column, lon: Column, lat: Column) -> Column:
    """Planar distance in web-mercator metres, 0 inside."""

    def to_segment(px: Column, py: Column, s: Column) -> Column:
        def measured(v: Column) -> Column:
            dx, dy = v["bx"] - v["ax"], v["by"] - v["ay"]
            n = dx * dx + dy * dy
            t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - v["ax"]) * dx + (py - v["ay"]) * dy) / n)))
            return F.hypot(px - v["ax"] - t * dx, py - v["ay"] - t * dy)

        return let(F.struct(mercator_x(s["a"]["x"]).alias("ax"), mercator_y(s["a"]["y"]).alias("ay"), mercator_x(s["b"]["x"]).alias("bx"), mercator_y(s["b"]["y"]).alias("by")), measured)

    rings = F.flatten(g["parts"])
    pairs = F.flatten(F.transform(rings, lambda r: F.when(F.size(r) > 1, segments(r)).otherwise(F.array(F.struct(r[0].alias("a"), r[0].alias("b"))))))
    at = F.struct(mercator_x(lon).alias("x"), mercator_y(lat).alias("y"))
    nearest = let(at, lambda p: F.array_min(F.transform(pairs, lambda s: to_segment(p["x"], p["y"], s))))
    return F.when(contains_point(g, lon, lat), 0.0).otherwise(nearest)


def bbox_intersects(g: Column, minx, miny, maxx, maxy) -> Column:
    return (g["minx"] <= maxx) & (g["maxx"] >= minx) & (g["miny"] <= maxy) & (g["maxy"] >= miny)


def _canonical_ring(ring: Column) -> Column:
    """Counter-clockwise, closed place dropped, starting at the smallest place."""

    def turned(open_ring: Column) -> Column:
        k = F.array_position(open_ring, F.array_min(open_ring)).cast("int")
        return F.concat(F.slice(open_ring, k, F.size(open_ring)), F.slice(open_ring, F.lit(1), k - 1))

    directed = F.when(planar_area(ring) >= 0, ring).otherwise(F.reverse(ring))
    return let(F.slice(directed, F.lit(1), F.greatest(F.size(directed) - 1, F.lit(1))), turned)


def equal_exact(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """The same rings within a tolerance, wherever they start and whichever way they run; nulls equal nulls only."""
    flat = lambda g: F.flatten(F.transform(F.flatten(g["parts"]), _canonical_ring))
    near = F.zip_with(flat(a), flat(b), lambda p, q: F.coalesce((F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance), F.lit(False)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((a["gtype"] == b["gtype"]) & F.forall(near, lambda ok: ok))


def structure_issue(g: Column) -> Column:
    """null, empty, unclosed_ring, few_points or not_finite; null when sound."""
    rings = F.flatten(g["parts"])
    polygon = g["gtype"].isin("Polygon", "MultiPolygon")
    return (
        F.when(g.isNull(), "null").when(F.size(F.flatten(rings)) == 0, "empty")
        .when(F.exists(rings, lambda r: F.exists(r, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))), "not_finite")
        .when(polygon & F.exists(rings, lambda r: F.size(r) < 4), "few_points")
        .when(polygon & F.exists(rings, lambda r: r[0] != F.element_at(r, -1)), "unclosed_ring")
    )


def plausible_degrees(x: Column, y: Column) -> Column:
    return x.between(EXTENT[0], EXTENT[2]) & y.between(EXTENT[1], EXTENT[3])


def tile_x(lon: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((lon + 180) / 360 * n))).cast("bigint")


def tile_y(lat: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    r = F.radians(lat)
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n))).cast("bigint")


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """struct of a tile's corners in degrees."""
    n = F.pow(F.lit(2.0), z)
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return F.struct((x / n * 360 - 180).alias("minx"), lat(y + 1).alias("miny"), ((x + 1) / n * 360 - 180).alias("maxx"), lat(y).alias("maxy"))


def hilbert_id(z: Column, x: Column, y: Column) -> Column:
    """Number of a tile on the Hilbert curve, tiles of smaller zooms before it; null outside the pyramid."""
    one = F.lit(1).cast("bigint")
    start = F.struct(((F.pow(F.lit(4.0), z) - 1) / 3).cast("bigint").alias("d"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))

    def step(s: Column, k: Column) -> Column:
        side = F.expr("1").cast("bigint") * F.pow(F.lit(2.0), k).cast("bigint")
        rx, ry = F.when(s["x"].bitwiseAND(side) > 0, 1).otherwise(0), F.when(s["y"].bitwiseAND(side) > 0, 1).otherwise(0)
        d = s["d"] + side * side * ((rx * 3).bitwiseXOR(ry))
        last = side * 2 - 1
        low_x, low_y = s["x"].bitwiseAND(side * 2 - 1), s["y"].bitwiseAND(last)
        fx, fy = F.when((ry == 0) & (rx == 1), side - 1 - low_x.bitwiseAND(side - 1)).otherwise(low_x.bitwiseAND(side - 1)), F.when((ry == 0) & (rx == 1), side - 1 - low_y.bitwiseAND(side - 1)).otherwise(low_y.bitwiseAND(side - 1))
        return F.struct(d.cast("bigint").alias("d"), F.when(ry == 0, fy).otherwise(fx).cast("bigint").alias("x"), F.when(ry == 0, fx).otherwise(fy).cast("bigint").alias("y"))

    walked = F.when(z == 0, start["d"]).otherwise(F.aggregate(F.reverse(F.sequence(F.lit(0), F.greatest(z - 1, F.lit(0)))), start, step, lambda s: s["d"]))
    _ = one
    return F.when(z.between(0, 26) & (x >= 0) & (y >= 0) & (x < F.pow(F.lit(2.0), z)) & (y < F.pow(F.lit(2.0), z)), walked)


#: EPSG codes read here. method, central meridian, scale at it; all transverse Mercators have a false
#: easting of 500 km and start at the equator. vn2000 is geographic 4756 or a projection of it.
CRS = {
    4326: ("degrees", 0.0, 1.0, False), 4756: ("degrees", 0.0, 1.0, True), 3857: ("mercator", 0.0, 1.0, False), 32648: ("tm", 105.0, 0.9996, False), 32649: ("tm", 111.0, 0.9996, False), 3405: ("tm", 105.0, 0.9996, True), 3406: ("tm", 111.0, 0.9996, True),
    5896: ("tm", 104.0, 0.9999, True), 5897: ("tm", 104.5, 0.9999, True), 5898: ("tm", 104.75, 0.9999, True), 5899: ("tm", 105.5, 0.9999, True),
}


def is_vn2000(epsg: Column) -> Column:
    return F.coalesce(epsg.isin(*[k for k, v in CRS.items() if v[3]]), F.lit(False))


def identified(epsg: Column) -> Column:
    return F.coalesce(epsg.isin(*CRS), F.lit(False))


def _inverse_tm(x: Column, y: Column, meridian: Column, scale: Column) -> Column:
    """Inverse transverse Mercator by the series in the third flattening (four terms)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)

    def solve(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        xi2 = xi - sum((b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(beta)), F.lit(0.0))
        eta2 = eta - sum((b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(beta)), F.lit(0.0))
        return let(F.struct(xi2.alias("xi"), eta2.alias("eta")), place)

    def place(v: Column) -> Column:
        chi = F.asin(F.sin(v["xi"]) / F.cosh(v["eta"]))
        lat = chi + sum((d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(delta)), F.lit(0.0))
        return F.struct((meridian + F.degrees(F.atan2(F.sinh(v["eta"]), F.cos(v["xi"])))).alias("x"), F.degrees(lat).alias("y"))

    return let(F.struct((y / (scale * radius)).alias("xi"), ((x - 500000.0) / (scale * radius)).alias("eta")), solve)


def to_degrees(epsg: Column, x: Column, y: Column) -> Column:
    """struct(x, y) in EPSG:4326 order lon, lat; null where the code isn't known, never a guess."""
    table = F.create_map(*[F.lit(v) for k, (m, lon, s, _) in CRS.items() if m == "tm" for v in (k, f"{lon}|{s}")])
    lookup = table[epsg]
    mercator = F.struct(F.degrees(x / A).alias("x"), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2).alias("y"))
    tm = _inverse_tm(x, y, F.substring_index(lookup, "|", 1).cast("double"), F.substring_index(lookup, "|", -1).cast("double"))
    return F.when(epsg.isin(4326, 4756), xy(x, y)).when(epsg == 3857, mercator).when(lookup.isNotNull(), tm)
