"""Polygon overlay, validity and clipping in numpy, used in pandas UDFs where columns can't express them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import E2, A, E


_TILE_POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])


def edges(parts) -> np.ndarray:
    """n x 4 array of all ring edges."""
    out = []
    for part in parts if parts is not None else []:
        for ring in part:
            p = np.array([(q["x"], q["y"]) for q in ring], float)
            if len(p) > 1:
                out.append(np.hstack([p[:-1], p[1:]]))
    return np.concatenate(out) if out else np.zeros((0, 4))


def equal_area(e: np.ndarray) -> np.ndarray:
    """Edges in degrees -> metres of the ellipsoid's equal-area cylinder."""
    out = e.copy()
    out[:, [0, 2]] = np.radians(e[:, [0, 2]]) * A
    s = np.sin(np.radians(e[:, [1, 3]]))
    out[:, [1, 3]] = (1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - E * s) / (1 + E * s)) / (2 * E)) * A / 2
    return out


#: Pairs of edges that are looked at together.
PAIRS = 1 << 18


def _pairs(a: np.ndarray, b: np.ndarray):
    """Places of edges of a and of b whose heights and widths meet, in batches of a bounded size: a sweep up both, each edge
    against those of the other that start at or below its end and have not ended before it starts."""
    low, high = np.minimum(b[:, 1], b[:, 3]), np.maximum(b[:, 1], b[:, 3])
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    reach = np.maximum.accumulate(high)  # before the first place where this is high enough, all have ended
    bottom, top = np.minimum(a[:, 1], a[:, 3]), np.maximum(a[:, 1], a[:, 3])
    first, stop = np.searchsorted(reach, bottom, "left"), np.searchsorted(low, top, "right")
    count = np.maximum(stop - first, 0)
    ends = np.cumsum(count)
    at = 0
    while at < len(a):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")) - at)
        i = np.repeat(np.arange(at, at + n), count[at : at + n])
        own = np.arange(len(i)) - np.repeat(np.cumsum(count[at : at + n]) - count[at : at + n], count[at : at + n])
        j = order[first[i] + own]
        near = (np.minimum(a[i, 0], a[i, 2]) <= np.maximum(b[j, 0], b[j, 2])) & (np.minimum(b[j, 0], b[j, 2]) <= np.maximum(a[i, 0], a[i, 2]))
        yield i[near], j[near]
        at += n


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which edges of a cross edges of b."""
    out = [np.zeros(0)]
    for i, j in _pairs(a, b):
        d, f, w = a[i, 2:] - a[i, :2], b[j, 2:] - b[j, :2], b[j, :2] - a[i, :2]
        det = d[:, 0] * f[:, 1] - d[:, 1] * f[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * f[:, 1] - w[:, 1] * f[:, 0]) / det
            u = (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / det
        ok = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        out.append(np.unique(a[i, 1][ok] + t[ok] * d[ok, 1]))
    return np.concatenate(out)


class _Active:
    """The edges that a rising line meets: each comes in at its lower end and goes at its upper one."""

    def __init__(self, e: np.ndarray):
        up = e[np.argsort(np.minimum(e[:, 1], e[:, 3]), kind="stable")]
        self.low, self.edges, self.next, self.on = np.minimum(up[:, 1], up[:, 3]), up, 0, np.zeros((0, 4))

    def spans(self, y: float) -> np.ndarray:
        """Even-odd filled intervals at height y; heights must rise from call to call."""
        stop = int(np.searchsorted(self.low, y, "right"))
        q = np.concatenate([self.on, self.edges[self.next : stop]]) if stop > self.next else self.on
        self.next = stop
        self.on = q = q[np.maximum(q[:, 1], q[:, 3]) > y]
        x = np.sort(q[:, 0] + (y - q[:, 1]) / (q[:, 3] - q[:, 1]) * (q[:, 2] - q[:, 0]))
        return x[: len(x) // 2 * 2].reshape(-1, 2)


def _shared_length(s: np.ndarray, t: np.ndarray) -> float:
    """Length that two lists of disjoint rising intervals share."""
    if not len(s) or not len(t):
        return 0.0
    covered = np.concatenate([[0.0], np.cumsum(t[:, 1] - t[:, 0])])

    def upto(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(t[:, 0], x, "right")
        return covered[np.maximum(k - 1, 0)] + np.where(k > 0, np.clip(x - t[np.maximum(k - 1, 0), 0], 0, t[np.maximum(k - 1, 0), 1] - t[np.maximum(k - 1, 0), 0]), 0)

    return float((upto(s[:, 1]) - upto(s[:, 0])).sum())


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two even-odd filled edge sets share: slabs between vertex and crossing heights, intervals at mid-slab."""
    if not len(a) or not len(b):
        return 0.0
    meets = [_crossings(a, b)] if a is b else [_crossings(a, b), _crossings(a, a), _crossings(b, b)]
    ys = np.unique(np.concatenate([a[:, 1], a[:, 3], b[:, 1], b[:, 3], *meets]))
    first, second, total = _Active(a), _Active(b), 0.0
    for low, high in zip(ys[:-1], ys[1:], strict=True):
        s = first.spans((low + high) / 2)
        total += (high - low) * (float((s[:, 1] - s[:, 0]).sum()) if a is b else _shared_length(s, second.spans((low + high) / 2)))
    return float(total)


def _side(p, q, r):
    return np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))


def _within(p, q, r):
    return (np.minimum(p, q) <= r).all(-1) & (r <= np.maximum(p, q)).all(-1)


def _where(ring: np.ndarray, p: np.ndarray) -> np.ndarray:
    """1 for places inside a ring, 0 on it, -1 outside."""
    a, b, q = ring[None, :-1], ring[None, 1:], p[:, None]
    on = ((_side(a, b, q) == 0) & _within(a, b, q)).any(1)
    up = (a[..., 1] <= q[..., 1]) != (b[..., 1] <= q[..., 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = a[..., 0] + (q[..., 1] - a[..., 1]) / (b[..., 1] - a[..., 1]) * (b[..., 0] - a[..., 0])
    return np.where(on, 0, np.where((up & (cut > q[..., 0])).sum(1) % 2 == 1, 1, -1))


def _of(ring: np.ndarray, other: np.ndarray) -> int:
    """Where a ring that doesn't cross another lies: 1 inside, -1 outside, 0 along it. Corners tell first, then middles."""
    for p in (other[:-1], (other[:-1] + other[1:]) / 2):
        w = _where(ring, p)
        if (w != 0).any():
            return int(w[w != 0][0])
    return 0


def broken_rule(parts) -> str | None:
    """self_intersection: edges of a ring that aren't neighbours meet, or rings cross or run along each other;
    hole_outside_shell, nested_holes, nested_parts: rings that lie in the wrong place. Rings may touch in points."""
    rings, owner = [], []
    for k, part in enumerate(parts if parts is not None else []):
        for h, ring in enumerate(part):
            p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
            keep = np.ones(len(p), bool)
            keep[1:] = (p[1:] != p[:-1]).any(1)
            rings.append(p[keep])
            owner.append((k, h))
    if not rings or any(len(r) < 4 for r in rings):
        return "self_intersection" if rings else None
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    of = np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
    at = np.concatenate([np.arange(len(r) - 1) for r in rings])
    last = np.array([len(r) - 2 for r in rings])[of]
    order = np.argsort(np.minimum(a[:, 0], b[:, 0]), kind="stable")
    a, b, of, at, last = a[order], b[order], of[order], at[order], last[order]
    stop = np.searchsorted(np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0]), "right")
    for i in range(len(a)):  # a sweep: each edge against those that start before it ends
        c, d = a[i + 1 : stop[i]], b[i + 1 : stop[i]]
        if not len(c):
            continue
        s1, s2, s3, s4 = _side(a[i], b[i], c), _side(a[i], b[i], d), _side(c, d, a[i]), _side(c, d, b[i])
        proper = (s1 * s2 < 0) & (s3 * s4 < 0)
        touch = (s1 == 0) & _within(a[i], b[i], c) | (s2 == 0) & _within(a[i], b[i], d) | (s3 == 0) & _within(c, d, a[i]) | (s4 == 0) & _within(c, d, b[i])
        low, high = np.maximum(np.minimum(a[i], b[i]), np.minimum(c, d)), np.minimum(np.maximum(a[i], b[i]), np.maximum(c, d))
        along = (s1 == 0) & (s2 == 0) & (low <= high).all(1) & (low < high).any(1)
        same = of[i + 1 : stop[i]] == of[i]
        step = np.abs(at[i + 1 : stop[i]] - at[i])
        beside = same & ((step == 1) | (step == last[i]))
        if (proper | along | (touch & same & ~beside)).any():
            return "self_intersection"
    shells = [i for i, (_, h) in enumerate(owner) if h == 0]
    for i, (k, h) in enumerate(owner):
        shell = next(s for s in shells if owner[s][0] == k)
        if h and _of(rings[shell], rings[i]) < 0:
            return "hole_outside_shell"
        if h and any(_of(rings[j], rings[i]) > 0 for j, (m, g) in enumerate(owner) if m == k and g and j != i):
            return "nested_holes"
    for s in shells:
        for t in shells:
            inside = s != t and (rings[s].min(0) <= rings[t].min(0)).all() and (rings[s].max(0) >= rings[t].max(0)).all() and _of(rings[s], rings[t]) >= 0
            if inside and not any(_of(rings[j], rings[t]) >= 0 for j, (m, g) in enumerate(owner) if m == owner[s][0] and g):
                return "nested_parts"
    return None


#: Polygons of up to so many edges and rings are judged together, those of one make at once; so many pairs of edges at a time.
FEW_EDGES, FEW_RINGS, AT_ONCE = 32, 6, 1 << 20


def _flat(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each geometry's parts, each part's rings and each ring's places start, and all places (n x 2, nan for none)."""
    places = parts.values.values.values
    xy = np.stack([places.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"], axis=1) if len(places) else np.zeros((0, 2))
    return parts.offsets.to_numpy(), parts.values.offsets.to_numpy(), parts.values.values.offsets.to_numpy(), xy


def _sides(rings: np.ndarray, others: np.ndarray) -> np.ndarray:
    """_of for many rings at once: rings (n x k x 2) and others (n x m x 2)."""
    p = np.concatenate([others[:, :-1], (others[:, :-1] + others[:, 1:]) / 2], axis=1)
    a, b, q = rings[:, None, :-1], rings[:, None, 1:], p[:, :, None]
    on = ((_side(a, b, q) == 0) & _within(a, b, q)).any(2)
    up = (a[..., 1] <= q[..., 1]) != (b[..., 1] <= q[..., 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = a[..., 0] + (q[..., 1] - a[..., 1]) / (b[..., 1] - a[..., 1]) * (b[..., 0] - a[..., 0])
    w = np.where(on, 0, np.where((up & (cut > q[..., 0])).sum(2) % 2 == 1, 1, -1))
    return np.take_along_axis(w, np.argmax(w != 0, axis=1)[:, None], axis=1)[:, 0]


def _broken_alike(rings: list[np.ndarray], owner: list[tuple[int, int]]) -> np.ndarray:
    """broken_rule of polygons of one make: rings[r] holds the r-th ring (n x places x 2) of all, without repeated places."""
    a, b = np.concatenate([r[:, :-1] for r in rings], axis=1), np.concatenate([r[:, 1:] for r in rings], axis=1)
    edges_of = [r.shape[1] - 1 for r in rings]
    of, at, last = np.repeat(np.arange(len(rings)), edges_of), np.concatenate([np.arange(k) for k in edges_of]), np.repeat(np.array(edges_of) - 1, edges_of)
    start, end = np.minimum(a[..., 0], b[..., 0]), np.maximum(a[..., 0], b[..., 0])
    order = np.argsort(start, axis=1, kind="stable")
    i, j = np.triu_indices(a.shape[1], 1)
    first, second = order[:, i], order[:, j]
    row = np.arange(len(a))[:, None]
    p, q, c, d = a[row, first], b[row, first], a[row, second], b[row, second]
    s1, s2, s3, s4 = _side(p, q, c), _side(p, q, d), _side(c, d, p), _side(c, d, q)
    proper = (s1 * s2 < 0) & (s3 * s4 < 0)
    touch = (s1 == 0) & _within(p, q, c) | (s2 == 0) & _within(p, q, d) | (s3 == 0) & _within(c, d, p) | (s4 == 0) & _within(c, d, q)
    low, high = np.maximum(np.minimum(p, q), np.minimum(c, d)), np.minimum(np.maximum(p, q), np.maximum(c, d))
    along = (s1 == 0) & (s2 == 0) & (low <= high).all(-1) & (low < high).any(-1)
    same, step = of[first] == of[second], np.abs(at[first] - at[second])
    beside = same & ((step == 1) | (step == last[first]))
    near = np.take_along_axis(start, second, 1) <= np.take_along_axis(end, first, 1)
    out = np.where((near & (proper | along | (touch & same & ~beside))).any(1), "self_intersection", None).astype(object)
    shells = [r for r, (_, h) in enumerate(owner) if h == 0]
    tell = lambda where, what: out.__setitem__((out == None) & where, what)  # noqa: E711, E731
    for r, (k, h) in enumerate(owner):
        if h:
            tell(_sides(rings[next(s for s in shells if owner[s][0] == k)], rings[r]) < 0, "hole_outside_shell")
            for other, (m, g) in enumerate(owner):
                if m == k and g and other != r:
                    tell(_sides(rings[other], rings[r]) > 0, "nested_holes")
    for s in shells:
        for t in shells:
            if s != t:
                inside = (rings[s].min(1) <= rings[t].min(1)).all(1) & (rings[s].max(1) >= rings[t].max(1)).all(1) & (_sides(rings[s], rings[t]) >= 0)
                for hole, (m, g) in enumerate(owner):
                    if m == owner[s][0] and g:
                        inside &= _sides(rings[hole], rings[t]) < 0
                tell(inside, "nested_parts")
    return out


def broken_rules(parts: pa.Array) -> np.ndarray:
    """broken_rule of each: polygons of few edges by their make, many at once; others, and those with repeated places, one by one."""
    out, single = np.full(len(parts), None, object), []
    at_part, at_ring, at_place, xy = _flat(parts)
    ring_counts, lengths = np.diff(at_ring), np.diff(at_place)
    makes: dict[tuple[bytes, bytes], list[int]] = {}
    none = parts.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(parts)):
        p, q = at_part[i], at_part[i + 1]
        if not none[i] and q > p:
            makes.setdefault((ring_counts[p:q].tobytes(), lengths[at_ring[p] : at_ring[q]].tobytes()), []).append(i)
    for (counts, sizes), rows in makes.items():
        own, places = np.frombuffer(counts, ring_counts.dtype), np.frombuffer(sizes, lengths.dtype)
        m = int(places.sum()) - len(places)
        if not len(places) or places.min() < 4 or own.min() < 1 or m > FEW_EDGES or len(places) > FEW_RINGS:
            single += rows
            continue
        owner, ends, step = [(k, h) for k, n in enumerate(own) for h in range(n)], np.cumsum([0, *places]), max(1, AT_ONCE // (m * m))
        for lo in range(0, len(rows), step):
            some = np.array(rows[lo : lo + step])
            all_ = xy[at_place[at_ring[at_part[some]]][:, None] + np.arange(ends[-1])]
            rings = [all_[:, s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
            plain = np.isfinite(all_).all((1, 2))
            for r in rings:
                plain &= (r[:, 1:] != r[:, :-1]).any(2).all(1)
            single += some[~plain].tolist()
            out[some[plain]] = _broken_alike([r[plain] for r in rings], owner)
    for i in single:
        out[i] = broken_rule(parts[i].as_py())
    return out


def self_crossing(parts) -> bool:
    """Edges of the geometry meet where they may not."""
    return broken_rule(parts) == "self_intersection"


def clip_ring(ring: list, minx: float, miny: float, maxx: float, maxy: float) -> list:
    """A ring cut to a rectangle, one side after the other."""
    return [{"x": x, "y": y} for x, y in _clipped([(q["x"], q["y"]) for q in ring], minx, miny, maxx, maxy)]


def _clipped(p: list[tuple[float, float]], minx: float, miny: float, maxx: float, maxy: float) -> list[tuple[float, float]]:
    for axis, bound, keep in ((0, minx, 1), (0, maxx, -1), (1, miny, 1), (1, maxy, -1)):
        out = []
        for i, b in enumerate(p):
            a = p[i - 1]
            ina, inb = keep * (a[axis] - bound) >= 0, keep * (b[axis] - bound) >= 0
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(a[k] + t * (b[k] - a[k]) for k in (0, 1)))
            if inb:
                out.append(b)
        p = out
        if not p:
            return []
    return p


@F.pandas_udf(T.DoubleType())
def symdiff_m2(a: pd.Series, b: pd.Series) -> pd.Series:
    """Area in square metres that only one of two polygon part lists covers."""

    def one(x, y) -> float:
        e, f = equal_area(edges(x)), equal_area(edges(y))
        return overlap_area(e, e) + overlap_area(f, f) - 2 * overlap_area(e, f)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def overlap_degrees(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shared area in square degrees."""
    return pd.Series([overlap_area(edges(x), edges(y)) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.BooleanType())
def crosses_itself(parts: pd.Series) -> pd.Series:
    return pd.Series([self_crossing(x) for x in parts], dtype=bool)


@F.arrow_udf(T.StringType())
def breaks_rules(parts: pa.Array) -> pa.Array:
    """The rule that a polygon breaks, null for a valid one."""
    return pa.array(broken_rules(parts), pa.string())


@F.arrow_udf(T.ArrayType(T.ArrayType(T.ArrayType(_TILE_POINT))))
def tile_geometry(parts: pa.Array, bounds: pa.Array) -> pa.Array:
    """Parts clipped to a tile with a buffer of 64 and quantised to 4096 units a side, y down. All places of a batch are worked
    out at once; only rings that reach over the buffer are cut one by one."""
    at_part, at_ring, at_place, xy = _flat(parts)
    at_part = at_part - at_part[0] + (first := int(at_part[0]))  # an array may be a slice of a longer one
    rings = slice(int(at_ring[first]), int(at_ring[at_part[-1]]))
    at_ring = at_ring[first : at_part[-1] + 1] - rings.start
    at_part = at_part - first
    start = int(at_place[rings.start])
    at_place = at_place[rings.start : rings.stop + 1] - start
    xy = xy[start : start + at_place[-1]]
    part_of, ring_of = np.repeat(np.arange(len(at_ring) - 1), np.diff(at_ring)), np.repeat(np.arange(len(at_place) - 1), np.diff(at_place))
    feature_of = np.repeat(np.arange(len(parts)), np.diff(at_part))  # of a part
    merc = lambda lat: np.log(np.tan(math.pi / 4 + np.radians(lat) / 2))
    minx, miny, maxx, maxy = (bounds.field(c).to_numpy(zero_copy_only=False) for c in ("minx", "miny", "maxx", "maxy"))
    top, bottom, own = merc(maxy), merc(miny), feature_of[part_of[ring_of]]
    x, y = (xy[:, 0] - minx[own]) / (maxx - minx)[own], (top[own] - merc(xy[:, 1])) / (top - bottom)[own]
    low, high, n = -64 / 4096, 1 + 64 / 4096, len(at_place) - 1
    outside = np.zeros(n, bool)
    over = np.bincount(ring_of, ~((x >= low) & (x <= high) & (y >= low) & (y <= high)), n) > 0
    size = np.diff(at_place)
    for beyond in (x < low, x > high, y < low, y > high):
        outside |= (size > 0) & (np.bincount(ring_of, beyond, n) == size)
    cut = {int(r): _clipped(list(zip(x[at_place[r] : at_place[r + 1]].tolist(), y[at_place[r] : at_place[r + 1]].tolist(), strict=True)), low, low, high, high) for r in np.flatnonzero(over & ~outside)}
    kept = np.where(outside, 0, size)
    for r, p in cut.items():
        kept[r] = len(p)
    ends = np.cumsum([0, *kept])
    out = np.zeros((int(ends[-1]), 2))
    whole = ~(over | outside)[ring_of]
    out[(ends[:-1] - at_place[:-1])[ring_of[whole]] + np.flatnonzero(whole)] = np.stack([x[whole], y[whole]], axis=1)
    for r, p in cut.items():
        out[ends[r] : ends[r + 1]] = np.array(p, float).reshape(-1, 2)
    out = np.rint(out * 4096).astype(np.int32)
    some = kept > 0
    by_part = np.bincount(part_of[some], minlength=len(at_ring) - 1)
    by_feature = np.bincount(feature_of[by_part > 0], minlength=len(parts))
    value = pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["x", "y"])
    for counts in (kept[some], by_part[by_part > 0], by_feature):
        value = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), value)
    return value
