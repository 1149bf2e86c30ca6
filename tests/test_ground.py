"""Union areas and shared ground against counts on a grid and plain clipping."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_clipping import inside, star
from tidemark.functions.geometry import ring_area, ring_box
from tidemark.operators import shared_ground
from tidemark.operators.union_area import swept_area, union_area
from tidemark.scratch import Scratch

RING = "array<struct<x:double,y:double>>"


def struct(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def boxed(frame):
    return frame.withColumn("b", ring_box(F.col("ring"))).select("*", "b.x0", "b.y0", "b.x1", "b.y1")


@pytest.mark.parametrize("swept", [128, 3])
def test_union_equals_counts_on_a_grid(spark, swept):
    rng = np.random.default_rng(7)
    keys = {k: [star(rng, rng.integers(3, 8)) * 3 for _ in range(n)] for k, n in ((1, 1), (2, 6), (3, 14))}
    rows = [(k, struct(r)) for k, rings in keys.items() for r in rings] + [(3, struct(keys[3][0]))] + [(4, []), (4, struct([(0, 0), (1, 1)]))]
    got = {r.k: r.area for r in union_area(boxed(spark.createDataFrame(rows, f"k int, ring {RING}")), ["k"], 1.7, Scratch(spark, "t"), swept).collect()}
    at = (np.arange(900) + 0.5) / 900 * 10 - 5
    x, y = np.meshgrid(at, at)
    assert got.keys() == {1, 2, 3}
    for k, rings in keys.items():
        assert abs(got[k] - np.logical_or.reduce([inside(r, x, y) for r in rings]).sum() * (10 / 900) ** 2) < 0.08


def test_union_of_two_and_three_by_inclusion_and_exclusion(spark):
    a, b, c = [(0, 0), (4, 0), (4, 4), (0, 4)], [(2, -2), (6, 2), (2, 6), (-2, 2)], [(3, 3), (9, 3), (9, 9), (3, 9)]
    found = union_area(boxed(spark.createDataFrame([(1, struct(r)) for r in (a, b, c)], f"k int, ring {RING}")), ["k"], 2.5, Scratch(spark, "t")).first()
    # a and b share 16, all of a; c and a share 1, c and b the triangle over x + y <= 8: 2; all three 1
    assert found.area == pytest.approx(16 + 32 + 36 - 16 - 1 - 2 + 1)
    assert swept_area(np.array([a, b], float), np.array([4, 4])) == pytest.approx(32)


def scene(seed):
    rng = random.Random(seed)
    out = []
    for k in range(60):
        turn, cx, cy = rng.uniform(0, math.pi), rng.uniform(0, 120), rng.uniform(0, 60)
        corner = lambda u, v: (cx + math.cos(turn) * u - math.sin(turn) * v, cy + math.sin(turn) * u + math.cos(turn) * v)
        out.append((k, rng.choice(["A", "B", None]), rng.choice(["train", "train", "val", "test", "other"]), rng.choice(["photo", "mosaic"]), [corner(*p) for p in ((-10, -6), (10, -6), (10, 6), (-10, 6))]))
    return out + [(99, "A", "test", "photo", [])]


def near(ring, x, y, margin):
    """Within margin of a ring, or in it."""
    out = inside(ring, x, y)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        out |= np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) <= margin
    return out


def test_zones_masks_and_touched_tiles(spark):
    rows = scene(3)
    frame = spark.createDataFrame([(i, s, p, k, struct(r)) for i, s, p, k, r in rows], f"parent_id long, site string, split string, kind string, ring {RING}")
    zones = Scratch(spark, "t").keep(shared_ground.shared_zones(frame, 16.0))
    got = {(r.masked, r.kept): r for r in zones.collect()}
    step = 0.1
    x, y = np.meshgrid(np.arange(-20, 140, step), np.arange(-20, 80, step))
    rank, want, masks = {"train": 0, "val": 1, "test": 2}, {}, {}
    for i, site, split, kind, ring in rows:
        for j, other, above, sort, around in rows:
            if site and site == other and split in rank and above in rank and rank[split] < rank[above] and ring and around:
                both = inside(ring, x, y) & near(around, x, y, 0.25 if kind == sort == "mosaic" else 5.0)
                if both.any():
                    want[i, j] = both.sum() * step**2
                    masks[i] = masks.get(i, False) | both
    assert {k for k, v in want.items() if v > 1} <= got.keys() and {k for k in got if got[k].zone_area > 1} <= want.keys() and len(want) > 20
    for k in got.keys() & want.keys():
        assert abs(got[k].zone_area - want[k]) < 0.05 * want[k] + 0.6 and got[k].share == pytest.approx(got[k].zone_area / 240) and got[k].overlap <= got[k].zone_area + 1e-9
    areas = {r.masked: r.area for r in shared_ground.masked_areas(zones, 8.0, Scratch(spark, "t")).collect()}
    assert areas.keys() == {k for k, _ in got}
    assert all(abs(areas[i] - masks[i].sum() * step**2) < 0.05 * areas[i] + 0.8 for i in masks)
    assert any(areas[i] < sum(r.zone_area for k, r in got.items() if k[0] == i) - 1 for i in areas)  # zones that overlap count once

    tiles = [(i, f"{i}_{u}", struct([(u, v), (u + 5, v), (u + 5, v + 5), (u, v + 5)])) for i, *_ in rows for u in range(-20, 140, 40) for v in (20,)]
    on = {(r.parent_id, r.tile) for r in shared_ground.touched(spark.createDataFrame(tiles, f"parent_id long, tile string, ring {RING}"), zones, 16.0).collect()}
    for i, name, ring in tiles:
        u, v = ring[0]["x"], ring[0]["y"]
        part = masks[i][(y > v) & (y < v + 5) & (x > u) & (x < u + 5)].sum() * step**2 if i in masks else 0
        assert part < 0.5 and part > 0 or ((i, name) in on) == (part > 0)
