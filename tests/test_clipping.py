"""Batched clipping against areas counted on a grid, and against one another."""

import numpy as np
import pyarrow as pa

from tidemark.functions import clipping


def batch(rings):
    column = pa.array([None if r is None else [{"x": x, "y": y} for x, y in r] for r in rings], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    return clipping.padded(column)


def star(rng, n):
    """A simple ring around its middle, mostly not convex."""
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    radius = rng.uniform(0.3, 1, n)
    return rng.uniform(-0.6, 0.6, 2) + np.stack([np.cos(angle), np.sin(angle)], axis=1) * radius[:, None]


def inside(ring, x, y):
    out = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0)):
        hit = (ay > y) != (by > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            out ^= hit & (x < ax + (y - ay) / (by - ay) * (bx - ax))
    return out


def test_areas_of_any_simple_rings_equal_counts_on_a_grid():
    rng = np.random.default_rng(3)
    p, q = [star(rng, rng.integers(3, 9)) for _ in range(60)], [star(rng, rng.integers(3, 9)) for _ in range(60)]
    found = clipping.common_areas(*batch(p), *batch(q))
    at = (np.arange(700) + 0.5) / 700 * 3.4 - 1.7
    x, y = np.meshgrid(at, at)
    for a, b, area in zip(p, q, found):
        assert abs((inside(a, x, y) & inside(b, x, y)).sum() * (3.4 / 700) ** 2 - area) < 0.01
    assert clipping.are_convex(*batch(p)).sum() < 60 and clipping.are_simple(*batch(p)).all()
    assert np.allclose(found, clipping.common_areas(*batch(q), *batch(p)))


def test_convex_pairs_and_odd_rings():
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    rings = [square, square[::-1], square, None, [], [(0, 0), (1, 1)], square, [(0, 0), (8, 0), (0, 8)]]
    other = [[(2, -2), (6, 2), (2, 6), (-2, 2)], [(3, 3), (9, 3), (9, 9), (3, 9)], [(5, 5), (6, 5), (6, 6)], square, square, square, square, square]
    assert np.allclose(clipping.common_areas(*batch(rings), *batch(other)), [16, 1, 0, 0, 0, 0, 16, 16])
    assert clipping.are_convex(*batch(rings)).tolist() == [True, True, True, False, False, False, True, True]
    bow = [(0, 0), (2, 2), (2, 0), (0, 2)]
    assert clipping.are_simple(*batch([bow, [(0, 0), (4, 0), (4, 4), (1, 1), (0, 4)], [(0, 0), (1, 0), (2, 0)], square])).tolist() == [False, True, False, True]
    points, sizes = batch([square, None, [(1, 1), (2, 1), (2, 2)]])
    column = clipping.rings_of(points, sizes, np.array([False, True, False])).to_pylist()
    assert column[1] is None and [tuple(p.values()) for p in column[2]] == [(1, 1), (2, 1), (2, 2)]


def test_clips_stay_within_and_keep_their_area():
    rng = np.random.default_rng(5)
    rings = [star(rng, 7) for _ in range(40)]
    points, sizes = batch(rings)
    box = np.broadcast_to(np.array([(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]), (40, 4, 2))
    cut, n = clipping.clipped(points, sizes, box, np.full(40, 4))
    assert all(np.abs(r[:k]).max() <= 0.5 + 1e-12 for r, k in zip(cut, n) if k)
    assert np.allclose(np.abs(clipping.signed_areas(cut, n)), clipping.common_areas(points, sizes, box, np.full(40, 4)))
