"""Clipping and areas of many rings at once: each step is a few numpy operations over a whole Arrow batch.

A batch of rings is an array (rows, width, 2), padded, with the number of points of each row. Convex pairs are cut edge
by edge; of other simple rings, the common area is the signed sum over pairs of their fan triangles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Triangles or pairs that are cut at once.
AT_ONCE = 1 << 15


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Points and sizes of a column of rings; null rings and null points count as absent."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    out = np.zeros((len(sizes), int(sizes.max(initial=0)), 2))
    at = np.arange(out.shape[1]) < sizes[:, None]
    for k, axis in enumerate("xy"):
        out[..., k][at] = flat.field(axis).to_numpy(zero_copy_only=False)
    return out, sizes


def rings_of(points: np.ndarray, sizes: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
    """The column of rings that padded() takes; rows in absent are null."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = points[np.arange(points.shape[1]) < sizes[:, None]]
    value = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(offsets, mask=None), value, mask=pa.array(absent) if absent is not None else None)


def _after(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Index of the point behind each one, around the ring."""
    k = np.arange(points.shape[1]) + 1
    return np.where(k < sizes[:, None], k, 0)


def signed_areas(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not points.shape[1]:
        return np.zeros(len(sizes))
    after = np.take_along_axis(points, _after(points, sizes)[..., None], axis=1)
    cross = points[..., 0] * after[..., 1] - after[..., 0] * points[..., 1]
    return np.where(np.arange(points.shape[1]) < sizes[:, None], cross, 0.0).sum(axis=1) / 2


def counter_clockwise(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same rings, turned around where they run clockwise."""
    k = np.arange(points.shape[1])
    turned = np.where(k < sizes[:, None], np.maximum(sizes[:, None] - 1 - k, 0), k)
    back = np.take_along_axis(points, turned[..., None], axis=1)
    return np.where((signed_areas(points, sizes) < 0)[:, None, None], back, points)


def are_convex(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """At least three points, all turns to one side, once around."""
    if not points.shape[1]:
        return np.zeros(len(sizes), bool)
    inside = np.arange(points.shape[1]) < sizes[:, None]
    after = _after(points, sizes)
    edge = np.take_along_axis(points, after[..., None], axis=1) - points
    following = np.take_along_axis(edge, after[..., None], axis=1)
    turn = edge[..., 0] * following[..., 1] - edge[..., 1] * following[..., 0]
    one_way = np.where(inside, turn > 0, True).all(axis=1) | np.where(inside, turn < 0, True).all(axis=1)
    angle = np.where(inside, np.arctan2(turn, (edge * following).sum(axis=2)), 0.0).sum(axis=1)
    return (sizes > 2) & one_way & (np.abs(angle) < 3 * np.pi)


def cut(points: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of each ring lies to the left of its line from a to b; rows that aren't active stay."""
    width = points.shape[1]
    inside = np.arange(width) < sizes[:, None]
    way = b - a
    side = way[:, None, 0] * (points[..., 1] - a[:, None, 1]) - way[:, None, 1] * (points[..., 0] - a[:, None, 0])
    side = np.where(active[:, None], side, 1.0)
    after = _after(points, sizes)
    beyond = np.take_along_axis(side, after, axis=1)
    keep, meet = inside & (side >= 0), inside & ((side > 0) & (beyond < 0) | (side < 0) & (beyond > 0))
    upto = np.cumsum(keep.astype(np.int64) + meet, axis=1)
    total = upto[:, -1] if width else np.zeros(len(sizes), np.int64)
    out = np.zeros((len(sizes), int(total.max(initial=0)), 2))
    row, k = np.nonzero(keep)
    out[row, upto[row, k] - 1 - meet[row, k]] = points[row, k]
    row, k = np.nonzero(meet)
    p, q, s, t = points[row, k], points[row, after[row, k]], side[row, k], beyond[row, k]
    out[row, upto[row, k] - 1] = p + (q - p) * (s / (s - t))[:, None]
    return out, np.where(total > 2, total, 0)


def clipped(points: np.ndarray, sizes: np.ndarray, convex: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings cut to convex ones beside them (counter-clockwise)."""
    for k in range(convex.shape[1]):
        after = np.where(k + 1 < edges, k + 1, 0)
        points, sizes = cut(points, sizes, convex[:, k], convex[np.arange(len(edges)), after], k < edges)
    return points, sizes


def _boxes_meet(p: np.ndarray, np_: np.ndarray, q: np.ndarray, nq: np.ndarray) -> np.ndarray:
    span = lambda v, n, f, fill: f(np.where((np.arange(v.shape[1]) < n[:, None])[..., None], v, fill), axis=1, initial=fill)
    low = np.maximum(span(p, np_, np.min, np.inf), span(q, nq, np.min, np.inf))
    high = np.minimum(span(p, np_, np.max, -np.inf), span(q, nq, np.max, -np.inf))
    return (low < high).all(axis=1)


def _fans(points: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, row) of each ring's fan triangles."""
    for k in range(1, points.shape[1] - 1):
        rows = np.flatnonzero(k + 1 < sizes)
        if len(rows):
            yield k, rows


def common_areas(p: np.ndarray, np_: np.ndarray, q: np.ndarray, nq: np.ndarray) -> np.ndarray:
    """Areas of the intersections of simple rings, row by row."""
    out = np.zeros(len(np_))
    meet = (np_ > 2) & (nq > 2)
    if not meet.any():
        return out
    meet &= _boxes_meet(p, np_, q, nq)
    both = meet & are_convex(p, np_) & are_convex(q, nq)
    for rows in _pieces(np.flatnonzero(both)):
        inner, n = clipped(p[rows], np_[rows], counter_clockwise(q[rows], nq[rows]), nq[rows])
        out[rows] = np.abs(signed_areas(inner, n))
    rest = np.flatnonzero(meet & ~both)
    if len(rest):
        total = np.zeros(len(rest))
        three = lambda n: np.full(n, 3)
        for i, mine in _fans(p[rest], np_[rest]):
            for j, other in _fans(q[rest], nq[rest]):
                for at in _pieces(np.intersect1d(mine, other)):
                    rows = rest[at]
                    t, u = p[rows][:, [0, i, i + 1]], q[rows][:, [0, j, j + 1]]
                    sign = np.sign(signed_areas(t, three(len(at)))) * np.sign(signed_areas(u, three(len(at))))
                    inner, n = clipped(t, three(len(at)), counter_clockwise(u, three(len(at))), three(len(at)))
                    total[at] += sign * np.abs(signed_areas(inner, n))
        out[rest] = np.abs(total)
    return out


def _pieces(rows: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(0, len(rows), AT_ONCE):
        yield rows[k : k + AT_ONCE]


def are_simple(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """At least three points, some area, and no two edges that cross."""
    out = (sizes > 2) & (np.abs(signed_areas(points, sizes)) > 0)
    open_ = np.flatnonzero(out & ~are_convex(points, sizes))
    turn = lambda a, b, c: (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    for step in range(2, points.shape[1] - 1):  # every edge beside the one that many places further
        if not len(open_):
            break
        v, n = points[open_], sizes[open_]
        after = _after(v, n)
        row, k = np.nonzero((np.arange(v.shape[1]) < n[:, None]) & (np.arange(v.shape[1]) + step < n[:, None]) & ~((np.arange(v.shape[1]) == 0) & (step == n - 1)[:, None]))
        a, b, c, d = v[row, k], v[row, after[row, k]], v[row, k + step], v[row, after[row, k + step]]
        crosses = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
        bad = np.unique(row[crosses])
        out[open_[bad]] = False
        open_ = np.delete(open_, bad)
    return out
