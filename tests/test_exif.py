"""Heads of photos: round trips in both byte orders, damage, and nothing that stops a job."""

import random

import pytest

from tidemark.sources.exif import read_head, write_head
from tidemark.sources.photos import from_heads


@pytest.mark.parametrize("little", [True, False])
def test_round_trip(little):
    rng = random.Random(little)
    for _ in range(200):
        make, model = rng.choice(["DJI", "A", "a long name of a maker", None]), rng.choice(["FC3411", "", None])
        focal, lat, lon = rng.choice([8.38, 24.0, None]), rng.choice([None, rng.uniform(-90, 90)]), rng.uniform(-180, 180)
        head = write_head(make, model, focal, lat, lon, 5472, 3648, ' a:b="1"', little, rng.choice([1, 6]))
        got = read_head(head + b"\xff\xda" + bytes(500))
        assert (got["make"], got["model"], got["width"], got["height"], got["problem"]) == (make, model, 5472, 3648, None) and got["orientation"] in (1, 6)
        assert got["focal_mm"] == (None if focal is None else pytest.approx(focal))
        assert got["lat"] == (None if lat is None else pytest.approx(lat, abs=2e-8)) and got["lon"] == (None if lat is None else pytest.approx(lon, abs=2e-8))


def test_damage_is_told_and_never_raised():
    head = write_head("DJI", "FC", 8.4, 1.5, -2.5, 100, 80, "", True)
    for content, why in ((None, "no JPEG"), (b"", "no JPEG"), (b"PNG", "no JPEG"), (head[:40], "cut short"), (b"\xff\xd8\xff\xd9", "no Exif"), (b"\xff\xd8\x00\x00\x00\x00", "damaged segment"), (head[:16] + b"\xff\xff\xff\x7f" + head[20:], "damaged directory"), (head[:12] + b"XX" + head[14:], "damaged directory")):
        got = read_head(content)
        assert got["problem"] == why and all(v is None for k, v in got.items() if k != "problem")
    rng = random.Random(1)
    for _ in range(3000):  # any byte may be anything
        broken = bytearray(head)
        for _ in range(rng.randrange(1, 6)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        read_head(bytes(broken[: rng.randrange(len(broken))] if rng.random() < 0.3 else broken))
    # a fraction over 0 is no position
    at = head.index((15_000).to_bytes(4, "little")) if (15_000).to_bytes(4, "little") in head else None
    assert at is None or read_head(head)["lat"] == pytest.approx(1.5)


def test_makes_and_reasons(spark):
    xmp = ' drone-dji:RelativeAltitude="+50.5" drone-dji:GimbalYawDegree="10" drone-dji:GimbalPitchDegree="-90"'
    camera = ' Camera:AboveGroundAltitude="60" Camera:Yaw="20" Camera:Pitch="5" drone-dji:GpsLatitude="1" drone-dji:GpsLongitude="2"'
    rows = {
        "good": write_head("DJI", "m", 8.0, 1.0, 2.0, 10, 10, xmp, True), "other": write_head("senseFly", "m", 8.0, 1.5, 2.0, 10, 10, camera, False), "attributes only": write_head("senseFly", "m", 8.0, None, None, 10, 10, camera, False),
        "turned": write_head("DJI", "m", 8.0, 1.0, 2.0, 10, 10, xmp, True, 3), "unknown make": write_head("X", "m", 8.0, 1.0, 2.0, 10, 10, xmp, True), "no make or model": write_head("DJI", " ", 8.0, 1.0, 2.0, 10, 10, xmp, True),
        "no focal length": write_head("DJI", "m", None, 1.0, 2.0, 10, 10, xmp, True), "no position": write_head("DJI", "m", 8.0, None, 2.0, 10, 10, xmp, True), "no altitude": write_head("DJI", "m", 8.0, 1.0, 2.0, 10, 10, "", True), "no JPEG": None,
    }
    got = {r.path: r for r in from_heads(spark.createDataFrame([(k, None if v is None else bytearray(v), "x") for k, v in rows.items()], "path string, content binary, reason string")).collect()}
    assert all(got[k].reason == k for k in rows if k not in ("good", "other", "attributes only"))
    assert (got["good"].lat, got["good"].alt, got["good"].yaw, got["good"].pitch, got["good"].reason, got["good"].differ) == (1.0, 50.5, 10.0, -90.0, None, False)
    assert (got["other"].lat, got["other"].alt, got["other"].pitch, got["other"].differ) == (1.5, 60.0, -85.0, True) and (got["attributes only"].lat, got["attributes only"].lon, got["attributes only"].reason) == (1.0, 2.0, None)
