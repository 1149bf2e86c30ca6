"""Dark components and rescue windows against plain versions."""

import random

import numpy as np

from tidemark.operators.nodata import nodata_cells, plan_windows
from tidemark.scratch import Scratch

COLUMNS, ROWS = 90, 70


def images(seed):
    rng = random.Random(seed)
    out = {}
    for image in range(6):
        dark = {(rng.randrange(COLUMNS), rng.randrange(ROWS)) for _ in range(image * 500)}
        dark |= {(x, y) for x in range(40) for y in range(40) if x + y < image * 9}
        dark |= {(x, 35) for x in range(3, COLUMNS if image == 2 else 60)} | {(30 + k, k) for k in range(20, 50)}
        out[image] = dark
    return out


def components(dark):
    """Sets of joined cells, by a walk."""
    left, out = set(dark), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            own.add((x, y))
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(own)
    return out


def nodata(dark):
    edge = lambda p: p[0] in (0, COLUMNS - 1) or p[1] in (0, ROWS - 1)
    return [c for c in components(dark) if any(map(edge, c)) and len(c) >= 0.001 * COLUMNS * ROWS]


def test_components_equal_a_walk(spark):
    all_ = images(4)
    rows = [(i, x, y, COLUMNS, ROWS) for i, dark in all_.items() for x, y in dark] + [(0, 500, 2, COLUMNS, ROWS), (1, 1, 1, COLUMNS, ROWS)]
    frame = spark.createDataFrame(rows, "image long, x long, y long, columns int, rows int").repartition(3)
    got = {}
    for r in nodata_cells(frame, Scratch(spark, "t")).collect():
        got.setdefault((r.image, r.component), set()).add((r.x, r.y))
    all_[1].add((1, 1))
    want = sorted((i, sorted(c)) for i, dark in all_.items() for c in nodata(dark))
    assert sorted((i, sorted(c)) for (i, _), c in got.items()) == want and len(want) > 5
    assert nodata_cells(frame.limit(0), Scratch(spark, "t")).collect() == []


def plain_plan(dark, objects, side, stride, most, seen):
    free = lambda x, y: sum((u, v) in dark for u in range(x, x + side) for v in range(y, y + side)) <= most * side * side
    share = lambda o, w: max(0, min(o[2], w[0] + side) - max(o[0], w[0])) * max(0, min(o[3], w[1] + side) - max(o[1], w[1])) / ((o[2] - o[0]) * (o[3] - o[1]))
    at = lambda size: sorted({max(0, min(k, size - side)) for k in range(0, size, stride)})
    kept = [(x, y) for y in at(ROWS) for x in at(COLUMNS) if free(x, y)]
    added = []
    shown = lambda o: max((share(o, w) for w in kept + added), default=0) >= seen
    first = [o for o in objects if not shown(o)]
    for o in first if dark else []:
        if not shown(o):
            places = [(x, y) for y in range(ROWS - side + 1) for x in range(COLUMNS - side + 1) if x <= o[0] and o[2] <= x + side and y <= o[1] and o[3] <= y + side and free(x, y)]
            if places:
                place = min(places, key=lambda p: (p[0] - (o[0] + o[2] - side) / 2) ** 2 + (p[1] - (o[1] + o[3] - side) / 2) ** 2)
                if place not in kept + added:
                    added.append(place)
    return kept, added, sum(not shown(o) for o in objects)


def test_rescue_windows_equal_a_plain_version(spark):
    rng = random.Random(9)
    masks = {i: {p for c in nodata(d) for p in c} if i else set() for i, d in images(4).items()}
    objects = {i: [(x, y, x + rng.randrange(2, 9), y + rng.randrange(2, 9)) for x, y in ((rng.randrange(COLUMNS - 9), rng.randrange(ROWS - 9)) for _ in range(30))] for i in masks}
    frame = spark.createDataFrame([(i, k, *map(float, o)) for i, os in objects.items() for k, o in enumerate(os)] + [(9, 0, 1.0, 1.0, 1.0, 5.0)], "image long, id int, x0 double, y0 double, x1 double, y1 double").repartition(4)
    dark = spark.createDataFrame([(i, x, y) for i, m in masks.items() for x, y in m], "image long, x long, y long")
    got = plan_windows(frame, dark, COLUMNS, ROWS, 24, 20, 0.1).collect()
    rescued = 0
    for i in masks:
        kept, added, lost = plain_plan(masks[i], objects[i], 24, 20, 0.1, 0.8)
        mine = [r for r in got if r.image == i]
        assert sorted((r.x, r.y) for r in mine if not r.rescue) == sorted(kept) and sorted((r.x, r.y) for r in mine if r.rescue) == sorted(added)
        assert all(r.lost == lost and r.objects == 30 for r in mine)
        rescued += len(added)
    assert rescued > 5 and {r.image for r in got} == set(masks) and np.isfinite(rescued)
