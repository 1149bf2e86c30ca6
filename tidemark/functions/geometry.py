"""Rings: array<struct<x double, y double>>, open (the first point isn't repeated).

Areas, centroids and boxes are higher-order functions. Intersections are numpy over whole Arrow batches
(``clipping``); what needs a loop for each ring (hulls, simplification, repair) goes ring by ring.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import clipping

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _twice_area(ring: Column) -> Column:
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring: Column) -> Column:
    return F.abs(_twice_area(ring)) / 2


def ring_centroid(ring: Column) -> Column:
    """Centre of mass; the mean of the points where the area is 0."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    part = lambda axis: F.aggregate(F.zip_with(ring, after, lambda p, q: (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"])), F.lit(0.0), lambda a, v: a + v)
    mean = lambda axis: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[axis]) / F.size(ring)
    whole = _twice_area(ring)
    at = lambda axis: F.when(whole == 0, mean(axis)).otherwise(part(axis) / F.nullif(3 * whole, F.lit(0.0)))
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def ring_box(ring: Column) -> Column:
    take = lambda f, axis: f(F.transform(ring, lambda p: p[axis]))
    return F.struct(*[take(f, a).alias(f"{a}{k}") for k, f in ((0, F.array_min), (1, F.array_max)) for a in "xy"])


#: Rings count as rectangles, and as parallel, up to this share of their sides.
STRAIGHT = 1e-10


def common_direction(rings: DataFrame) -> tuple[float, float] | None:
    """A direction along the sides of all rings, if every one is a rectangle and all are parallel; else None.

    rings: ring and its box x0, y0, x1, y1; rows without a box don't count. The longer part of the direction is 1. One
    pass of sums; no rings at all have none.
    """
    p = [F.get("ring", F.lit(k)) for k in range(4)]
    e = [(q["x"] - o["x"], q["y"] - o["y"]) for o, q in zip(p, [*p[1:], p[0]])]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1]
    long_ = dot(e[0], e[0])
    tiny = STRAIGHT * F.sqrt(F.least(long_, dot(e[1], e[1])))
    right = (F.size("ring") == 4) & (tiny > 0) & (F.abs(dot(e[0], e[1])) <= STRAIGHT * F.sqrt(long_ * dot(e[1], e[1])))
    for k in range(2):
        right = right & (F.abs(e[0][k] + e[2][k]) <= tiny) & (F.abs(e[1][k] + e[3][k]) <= tiny)
    whole = F.nullif(long_, F.lit(0.0))
    cos, sin = (e[0][0] ** 2 - e[0][1] ** 2) / whole, 2 * e[0][0] * e[0][1] / whole  # of twice the angle
    fold = {"c": cos * cos - sin * sin, "s": 2 * cos * sin}  # of four times: equal for all four sides
    found = rings.filter(" AND ".join(f"{a}{k} IS NOT NULL" for a in "xy" for k in "01")).select(F.coalesce(right, F.lit(False)).alias("right"), *[v.alias(k) for k, v in fold.items()], F.struct(long_.alias("long"), e[0][0].alias("x"), e[0][1].alias("y")).alias("side"))
    told = found.agg(F.min("right").alias("right"), *[f(k).alias(f"{k}{f.__name__}") for k in fold for f in (F.min, F.max)], F.max("side").alias("side")).first()
    if not told["right"] or any(told[f"{k}max"] - told[f"{k}min"] > STRAIGHT for k in fold):
        return None
    x, y = told["side"]["x"], told["side"]["y"]
    whole = max(abs(x), abs(y))
    return x / whole, y / whole


def turned_boxes(rings: DataFrame, way: tuple[float, float]) -> DataFrame:
    """rings with x0, y0, x1, y1 along a direction in place of the ring and its box; areas are as many times larger as the square of the direction's length."""
    x, y = way
    turned = {"x": lambda p: p["x"] * x + p["y"] * y, "y": lambda p: p["y"] * x - p["x"] * y}
    side = lambda axis, f: f(F.transform("ring", turned[axis]))
    boxed = rings.filter(" AND ".join(f"{a}{k} IS NOT NULL" for a in "xy" for k in "01"))
    return boxed.withColumns({f"{axis}{k}": side(axis, f) for axis in "xy" for k, f in ((0, F.array_min), (1, F.array_max))}).drop("ring")


def normalise_ring(ring: Column, width: Column, height: Column) -> Column:
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.transform(ring, lambda p: F.struct(unit(p["x"] / width).alias("x"), unit(p["y"] / height).alias("y")))


def signed_area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def common_area(p: np.ndarray, q: np.ndarray) -> float:
    """Area of the intersection of two simple polygons."""
    return float(clipping.common_areas(p[None], np.array([len(p)]), q[None], np.array([len(q)]))[0])


def longest_side(p: np.ndarray) -> float:
    """Longer side of the smallest rectangle around a polygon, in any direction."""
    hull = convex_hull(p)
    if len(hull) < 3:
        return float(np.linalg.norm(np.ptp(p, axis=0))) if len(p) else 0.0
    best, long_ = np.inf, 0.0
    for a, b in zip(hull, np.roll(hull, -1, axis=0)):
        u = (b - a) / np.linalg.norm(b - a)
        w, h = np.ptp(hull @ u), np.ptp(hull @ np.array([-u[1], u[0]]))
        if w * h < best:
            best, long_ = w * h, max(w, h)
    return float(long_)


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull by a sweep over sorted points."""
    points = sorted(set(map(tuple, p)))
    if len(points) < 3:
        return np.array(points)

    def half(of):
        out: list = []
        for x in of:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of a ring that lie farther than tolerance from the chord they'd be cut by, found by halving."""
    if len(p) < 4:
        return p
    far = int(np.argmax(((p - p[0]) ** 2).sum(1)))
    keep, todo, closed = {0, far}, [(0, far), (far, len(p))], np.vstack([p, p[:1]])
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, inner = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        size = np.hypot(*chord)
        off = np.abs(chord[0] * inner[:, 1] - chord[1] * inner[:, 0]) / size if size else np.hypot(*inner.T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[sorted(keep)] if len(keep) > 2 else p


def _points(ring: list | None) -> np.ndarray:
    return np.array([(q["x"], q["y"]) for q in ring or []], float).reshape(-1, 2)


def _of_two(f: Callable[..., np.ndarray]):
    """A column of numbers from two columns of rings, computed for a whole batch; null where either is."""

    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        absent = ~(a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False))
        return pa.array(f(*clipping.padded(a), *clipping.padded(b)), pa.float64(), mask=absent)

    return run


def _of_one(kind: T.DataType, f: Callable):
    @F.arrow_udf(kind)
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(_points(x)) for x in a.to_pylist()])

    return run


def _shares(p: np.ndarray, np_: np.ndarray, q: np.ndarray, nq: np.ndarray) -> np.ndarray:
    common = clipping.common_areas(p, np_, q, nq)
    union = np.abs(clipping.signed_areas(p, np_)) + np.abs(clipping.signed_areas(q, nq)) - common
    good = (union > 0) & (common > 0)
    good[good] = clipping.are_simple(p[good], np_[good]) & clipping.are_simple(q[good], nq[good])
    return np.where(good, common / np.where(union > 0, union, 1.0), 0.0)


def _covered(p: np.ndarray, np_: np.ndarray, q: np.ndarray, nq: np.ndarray) -> np.ndarray:
    own = np.abs(clipping.signed_areas(p, np_)) * (np_ > 2)
    return np.where(own > 0, clipping.common_areas(p, np_, q, nq) / np.where(own > 0, own, 1.0), 0.0)


polygon_common_area = _of_two(clipping.common_areas)
polygon_iou = _of_two(_shares)
covered_share = _of_two(_covered)


@F.arrow_udf(T.BooleanType())
def polygon_is_simple(a: pa.Array) -> pa.Array:
    return pa.array(clipping.are_simple(*clipping.padded(a)), mask=~a.is_valid().to_numpy(zero_copy_only=False))


polygon_length = _of_one(T.DoubleType(), longest_side)


def loops(p: np.ndarray) -> list[np.ndarray]:
    """A ring that crosses itself, cut at its crossings into rings that don't."""
    n = len(p)
    for i in range(n):
        a, b = p[i], p[(i + 1) % n]
        for j in range(i + 2, n - (i == 0)):
            c, d = p[j], p[(j + 1) % n]
            whole = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if whole == 0:
                continue
            s = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / whole
            t = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / whole
            if 0 < s < 1 and 0 < t < 1:
                at = (a + (b - a) * s)[None]
                return loops(np.concatenate([p[: i + 1], at, p[j + 1 :]])) + loops(np.concatenate([at, p[i + 1 : j + 1]]))
    return [p]


def repaired(ring: Column) -> Column:
    """The ring itself, or the largest of the loops that a ring which crosses itself falls into; empty without an area."""

    @F.arrow_udf(RING)
    def run(a: pa.Array) -> pa.Array:
        out = []
        for x in a.to_pylist():
            parts = [q for q in loops(_points(x)) if len(q) > 2 and abs(signed_area(q)) > 0] if x else []
            best = max(parts, key=lambda q: abs(signed_area(q)), default=np.zeros((0, 2)))
            out.append(None if x is None else [{"x": u, "y": v} for u, v in best])
        return pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    return run(ring)


def simplify(ring: Column, tolerance: float) -> Column:
    @F.arrow_udf(RING)
    def run(a: pa.Array) -> pa.Array:
        kept = [None if x is None else [{"x": u, "y": v} for u, v in simplified(_points(x), tolerance)] for x in a.to_pylist()]
        return pa.array(kept, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    return run(ring)


def clip_to_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A ring cut to a box; empty where nothing is left."""

    @F.arrow_udf(RING)
    def run(a: pa.Array, *sides: pa.Array) -> pa.Array:
        l, b, r, t = (np.asarray(s.to_numpy(zero_copy_only=False), float) for s in sides)
        points, sizes = clipping.padded(a)
        corners = np.stack([np.stack(c, axis=1) for c in ((l, b), (r, b), (r, t), (l, t))], axis=1)
        sizes = np.where(np.isfinite(corners).all(axis=(1, 2)), sizes, 0)
        return clipping.rings_of(*clipping.clipped(points, sizes, np.nan_to_num(corners), np.full(len(sizes), 4)))

    return run(ring, x0, y0, x1, y1)
