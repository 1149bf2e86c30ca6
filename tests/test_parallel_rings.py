"""Outlines that are parallel rectangles are boxes along their sides: no clipping, the same results."""

import numpy as np
import pytest

from tidemark.functions import geometry
from tidemark.plans import polygons


def frame(spark, rings):
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in r], *(float(v) for v in (*np.min(r, axis=0), *np.max(r, axis=0)))) for k, r in enumerate(rings)]
    return spark.createDataFrame(rows, "det_id long, ring array<struct<x double, y double>>, x0 double, y0 double, x1 double, y1 double")


def rectangle(rng, angle):
    cos, sin = np.cos(angle), np.sin(angle)
    w, h = rng.uniform(1, 9, 2)
    corners = np.array([(0, 0), (w, 0), (w, h), (0, h)]) @ np.array([(cos, sin), (-sin, cos)]) + rng.uniform(-5, 5, 2) + 1000
    return np.roll(corners[:: rng.choice([-1, 1])], rng.integers(4), axis=0)


def plan(query, spark, small):
    return query(spark, small)._jdf.queryExecution().executedPlan().toString()


def same_either_way(query, spark, small, monkeypatch):
    """The query clips nothing, and finds what it finds with clipping."""
    assert "EvalPython" not in plan(query, spark, small)
    rows = lambda: sorted(map(tuple, query(spark, small).collect()))
    found = rows()
    monkeypatch.setattr(polygons, "turned", lambda *_: None)
    assert found and found == rows()


def test_rectangles_of_one_direction_are_boxes_along_it(spark):
    rng = np.random.default_rng(1)
    for angle in (0.0, 0.3, np.pi / 4, 2.0):
        found = frame(spark, [rectangle(rng, angle + k % 4 * np.pi / 2) for k in range(12)])
        way = geometry.common_direction(found)
        boxes = geometry.turned_boxes(found, way)
        scale = way[0] ** 2 + way[1] ** 2
        pairs = found.selectExpr("det_id AS a", "ring AS p").crossJoin(found.selectExpr("det_id AS b", "ring AS q")).select("a", "b", geometry.polygon_common_area("p", "q").alias("common"))
        at = {r.det_id: r for r in boxes.collect()}
        for r in pairs.collect():
            a, b = at[r.a], at[r.b]
            common = max(0, min(a.x1, b.x1) - max(a.x0, b.x0)) * max(0, min(a.y1, b.y1) - max(a.y0, b.y0)) / scale
            assert common == pytest.approx(r.common, abs=1e-8)


def test_other_rings_have_no_common_direction(spark):
    rng = np.random.default_rng(2)
    rectangles = [rectangle(rng, 0.4) for _ in range(4)]
    assert geometry.common_direction(frame(spark, rectangles)) is not None
    skew = rectangles[0] + np.array([(0, 0), (0.001, 0), (0.001, 0), (0, 0)])
    for odd in (rectangle(rng, 0.4001), rectangles[0][:3], skew, np.repeat(rectangles[0][:2], 2, axis=0), np.vstack([rectangles[0], rectangles[0][:1]])):
        assert geometry.common_direction(frame(spark, [*rectangles, odd])) is None
    assert geometry.common_direction(frame(spark, rectangles).filter("false")) is None


def test_polygon_pairs(spark, small, monkeypatch):
    same_either_way(polygons.polygon_pairs, spark, small, monkeypatch)


def test_polygon_same_object(spark, small, monkeypatch):
    same_either_way(polygons.polygon_same_object, spark, small, monkeypatch)


def test_polygon_iou(spark, small, monkeypatch):
    same_either_way(polygons.polygon_iou, spark, small, monkeypatch)


def test_covered_share(spark, small, monkeypatch):
    same_either_way(polygons.covered_share, spark, small, monkeypatch)


def test_polygon_groups(spark, small, monkeypatch):
    same_either_way(polygons.polygon_groups, spark, small, monkeypatch)


def test_polygon_suppression(spark, small, monkeypatch):
    same_either_way(polygons.polygon_suppression, spark, small, monkeypatch)
