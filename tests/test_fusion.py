"""Fusion, matching and clusters of models against versions that go object by object."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.geometry import common_area, signed_area
from tidemark.operators import matching
from tidemark.operators.fusion import fuse
from tidemark.scratch import Scratch

RING = "array<struct<x:double,y:double>>"
SIGHT = f"det_id long, photo_idx long, class_name string, confidence double, border boolean, cx double, cy double, ring {RING}, x0 double, y0 double, x1 double, y1 double"


def scene(seed):
    """Photos in a strip and things on the ground, each seen by some of the photos."""
    rng = random.Random(seed)
    photos = [(k, 60.0 * k, 5.0 * (k % 2), 60.0 * k + 140, 5.0 * (k % 2) + 90) for k in range(6)]
    found = []
    for _ in range(220):
        x, y, w, h = rng.uniform(0, 440), rng.uniform(0, 95), rng.uniform(0.2, 3), rng.uniform(0.2, 3)
        for k, *box in photos:
            if box[0] < x < box[2] and box[1] < y < box[3] and rng.random() < 0.6:
                cx, cy = x + rng.gauss(0, 0.03), y + rng.gauss(0, 0.03)
                turn = rng.uniform(0, math.pi)
                ring = [(cx + u * w * math.cos(turn) - v * h * math.sin(turn), cy + u * w * math.sin(turn) + v * h * math.cos(turn)) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
                xs, ys = zip(*ring)
                found.append((len(found), k, rng.choice("ab"), round(rng.uniform(0.2, 1), 1), rng.random() < 0.3, cx, cy, ring, min(xs), min(ys), max(xs), max(ys)))
    return photos, found


def slow_fusion(photos, found, res, margin):
    rings = {d[0]: np.array(d[7]) for d in found}
    area = {i: abs(signed_area(r)) for i, r in rings.items()}

    def owner(d):
        x, y = ((math.floor(v / res) + 0.5) * res for v in d[5:7])
        over = [(round((x - (a + u) / 2) ** 2 + (y - (b + v) / 2) ** 2, 6), k) for k, a, b, u, v in photos if a <= x <= u and b <= y <= v]
        return min(over)[1] if over else -1

    near = lambda p, q: math.dist(p[5:7], q[5:7]) < 0.08
    own = [d for d in found if owner(d) == d[1]]
    rest = [d for d in found if owner(d) != d[1] and not any(near(d, o) or common_area(rings[d[0]], rings[o[0]]) > 0 for o in own)]
    group = {d[0]: d[0] for d in rest}
    for _ in rest:
        before = dict(group)
        for p in rest:
            for q in rest:
                if p[0] < q[0] and p[1] != q[1]:
                    both = common_area(rings[p[0]], rings[q[0]])
                    if near(p, q) or both > 0 and (both / (area[p[0]] + area[q[0]] - both) >= 0.25 or both / min(area[p[0]], area[q[0]]) >= 0.6):
                        group[p[0]] = group[q[0]] = min(group[p[0]], group[q[0]])
        if before == group:
            break
    out = {d[0]: (d[2], d[3], d[3], 1, False) for d in own}
    for g in set(group.values()):
        ids = [d for d in rest if group[d[0]] == g]
        x, y = (sum(d[k] for d in ids) / len(ids) for k in (5, 6))
        available = sum(a + margin <= x < u - margin and b + margin <= y < v - margin for _, a, b, u, v in photos)
        best = {}
        for d in ids:
            if d[1] not in best or d[3] > best[d[1]][3]:
                best[d[1]] = d
        views = sorted(best.values(), key=lambda d: -d[3])
        second = views[1][3] if len(views) > 1 else 0.0
        score = (views[0][3] + second) / 2 if available >= 2 else views[0][3]
        rep = max(views, key=lambda d: round(d[3] - (0.3 if d[4] else 0), 9))
        votes = {}
        for d in views:
            votes[d[2]] = round(votes.get(d[2], 0) + d[3], 9)
        out[rep[0]] = (max(votes, key=votes.get), round(score, 4), views[0][3], len(views), True)
    return out


def test_fusion_object_by_object(spark):
    for seed in (1, 2, 3):
        photos, found = scene(seed)
        df = spark.createDataFrame([(*d[:7], [{"x": a, "y": b} for a, b in d[7]], *d[8:]) for d in found], SIGHT)
        ground = spark.createDataFrame(photos, "photo_idx long, x0 double, y0 double, x1 double, y1 double")
        got = fuse(df, ground, Scratch(spark, "test"), cell=4.0, res=5.0, margin=8.0).collect()
        assert {r.object_id: (r.class_name, r.confidence, r.best_view, r.n_views, r.rescued) for r in got} == slow_fusion(photos, found, 5.0, 8.0)
        assert any(r.rescued and r.n_views > 1 for r in got) and any(not r.rescued for r in got)
    assert fuse(df.limit(0), ground, Scratch(spark, "test")).count() == 0


def test_rounds_of_first_pairs_are_the_greedy_passes(spark):
    rng = random.Random(3)
    pairs = [(i, a, 100 + b, round(rng.random(), 1), sure) for i in range(3) for b in range(12) for sure in [round(rng.random(), 1)] for a in range(12) if rng.random() < 0.4]
    df = spark.createDataFrame(pairs, "image int, a int, b int, iou double, confidence double")
    for run, key in ((matching.by_overlap, lambda p: (-p[3], p[1], p[2])), (matching.by_confidence, lambda p: (-p[4], p[2], -p[3], p[1]))):
        used, want = set(), set()
        for p in sorted(pairs, key=lambda p: (p[0], key(p))):
            if (p[0], p[1]) not in used and (p[0], p[2]) not in used:
                used |= {(p[0], p[1]), (p[0], p[2])}
                want.add(p[:4])
        assert {tuple(r) for r in run(df, "image").collect()} == want and run(df.limit(0), "image").count() == 0


def test_clusters_over_models(spark):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        x, y = rng.uniform(0, 30), rng.uniform(0, 30)
        rows.append((k, rng.randrange(3), rng.randrange(3), round(rng.random(), 1), x, y, x + rng.uniform(1, 6), y + rng.uniform(1, 6)))

    def measures(p, q):
        both = max(0.0, min(p[6], q[6]) - max(p[4], q[4])) * max(0.0, min(p[7], q[7]) - max(p[5], q[5]))
        a, b = ((r[6] - r[4]) * (r[7] - r[5]) for r in (p, q))
        return both > 0 and (both / (a + b - both) >= 0.3 or both >= 0.5 * min(a, b))

    want = {}
    for photo in range(3):
        clusters = []
        for p in sorted((r for r in rows if r[1] == photo), key=lambda r: (r[2], -r[3], r[0])):
            mine = next((cl for cl in clusters if measures(p, cl[1])), None)
            if mine is None:
                mine = [p[0], p]
                clusters.append(mine)
            elif p[3] > mine[1][3]:
                mine[1] = p
            want[p[0]] = mine[0]
    df = spark.createDataFrame(rows, "det_id long, photo_idx long, model int, confidence double, x0 double, y0 double, x1 double, y1 double")
    links = spark.createDataFrame([(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and measures(p, q)], "a long, b long")
    got = matching.model_clusters(df, links, Scratch(spark, "test")).collect()
    assert {r.det_id: r.cluster for r in got} == want and len(got) == len(rows)
    assert len(set(want.values())) < len(rows)


def test_clusters_take_no_task_for_each_component(spark):
    """Small components are many: they are gone through in order, batch by batch, not one call for each."""
    rows = [(k, 0, k % 3, 0.5, 10.0 * (k // 4), 0.0, 10.0 * (k // 4) + 2, 2.0) for k in range(400)]
    df = spark.createDataFrame(rows, "det_id long, photo_idx long, model int, confidence double, x0 double, y0 double, x1 double, y1 double").repartition(3)
    links = spark.createDataFrame([(4 * g, 4 * g + i) for g in range(100) for i in (1, 2, 3)], "a long, b long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # components go on from batch to batch
    try:
        got = matching.model_clusters(df, links, Scratch(spark, "test"))
        assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
        opener = {g: min(range(4 * g, 4 * g + 4), key=lambda k: (k % 3, k)) for g in range(100)}
        assert {r.det_id: r.cluster for r in got.collect()} == {k: opener[k // 4] for k in range(400)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
