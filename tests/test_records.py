"""Rounds of rejection, coordinates there and back, polygons against boxes, readers and small tables with orphans."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import geodesy, geometry
from tidemark.operators.manifest import rejected_by_rounds
from tidemark.operators.running import best_from_here, in_parts, running
from tidemark.scratch import Scratch, shared_folder
from tidemark.sources import labels


def test_rejection_round_by_round(spark):
    rng = random.Random(5)
    for rows in ([(k, round(rng.expovariate(1), 2)) for k in range(200)], [(1, 1.0)], []):
        left, want, number = dict(rows), {}, 0
        while left:
            bad = sorted((k for k, r in left.items() if r > 3 * statistics.median(left.values())), key=lambda k: (-left[k], -k))
            if not bad:
                break
            number += 1
            for k in bad[: -(-len(bad) // 2)]:
                want[k] = number
                del left[k]
        found = rejected_by_rounds(spark.createDataFrame(rows, "pair int, residual double"), Scratch(spark, "test")).collect()
        assert {r.pair: r.round for r in found if r.round} == want and len(found) == len(rows)


def test_running_sums_over_parts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(40), k, rng.randrange(5)) for k in range(400)]
    order = [F.desc("x"), F.asc("k")]
    parts = in_parts(spark.createDataFrame(rows, "key string, x int, k int, v int"), ["key"], order, Scratch(spark, "test"))
    out = best_from_here(Scratch(spark, "test").keep(running(parts, ["key"], order, {"s": F.col("v")})), ["key"], [F.asc("x"), F.desc("k")], "v", "top").collect()
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        got = {r.k: (r.rn, r.s, r.top) for r in out if r.key == key}
        assert got == {r[2]: (n + 1, sum(q[3] for q in own[: n + 1]), max(q[3] for q in own[n:])) for n, r in enumerate(own)}


def test_utm_there_and_back(spark):
    points = [(46.4, -9.4), (2.35, 48.86), (-24.7, 16.8), (179.9, -60.0), (0.0, 0.0)]
    df = spark.createDataFrame(points, "lon double, lat double")
    zone = geodesy.utm_zone(F.col("lon"))
    east, north = geodesy.to_utm(F.col("lon"), F.col("lat"), zone)
    there = df.select("lon", "lat", zone.alias("zone"), east.alias("east"), north.alias("north"))
    lon, lat = geodesy.from_utm(F.col("east"), F.col("north"), F.col("zone"), F.col("lat") < 0)
    for r in there.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-8) and 100_000 < r.east < 900_000
    paris = next(r for r in there.collect() if r.zone == 31 and r.lat > 40)
    assert (paris.east, paris.north) == pytest.approx((452_320, 5_412_018), abs=400)


def test_outlines_are_suppressed_as_their_boxes(spark, small):
    a, b = ({r.det_id: r.kept for r in catalog.QUERIES[n](spark, small).collect()} for n in ("c6_polygon_suppression", "c6_greedy_suppression"))
    assert a == b and not all(a.values())


def test_crossing_rings_are_mended(spark):
    bow = np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)
    assert sorted(abs(geometry.signed_area(p)) for p in geometry.loops(bow)) == [1, 1]
    assert geometry.common_area(np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float), np.array([(2, -2), (6, 2), (2, 6), (-2, 2)], float)) == pytest.approx(16)


def test_orphans_on_both_sides(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (7,)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2,), (3,), (9,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r.problem for r in catalog.QUERIES["j21_orphans"](spark, str(tmp_path)).collect()}
    assert found == {1: "image without label", 7: "image without label", 3: "label without image", 9: "label without image"}


def test_strict_reader_refuses_another_geometry(spark, tmp_path):
    spark.createDataFrame([('{"type": "Feature", "geometry": {"type": "Point", "coordinates": []}, "properties": {}}',)], "value string").write.text(f"{tmp_path}/f")
    assert labels.geojson_lines(spark, f"{tmp_path}/f").count() == 0
    with pytest.raises(Exception, match="not a polygon"):
        labels.geojson_lines(spark, f"{tmp_path}/f", strict=True).collect()


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_hulls_hold_every_corner(spark, small):
    """The hull of each class is convex, of its own points, and no point lies outside."""
    from tidemark.plans.surveys import boxes

    points, hulls = {}, {}
    for r in boxes(spark, small).select("class_name", "x0", "y0").collect():
        points.setdefault(r.class_name, set()).add((r.x0, r.y0))
    for r in catalog.QUERIES["a44_site_hulls"](spark, small).collect():
        hulls.setdefault(r.class_name, []).append((r.x, r.y))
    assert set(hulls) == set(points)
    for name, hull in hulls.items():
        ring = geometry.convex_hull(np.array(hull))
        assert len(ring) == len(hull) and set(hull) <= points[name]
        all_ = np.array(sorted(points[name]))
        for a, b in zip(ring, np.roll(ring, -1, axis=0)):
            assert ((b[0] - a[0]) * (all_[:, 1] - a[1]) - (b[1] - a[1]) * (all_[:, 0] - a[0]) >= -1e-6).all()
