"""Survey tables derived from the star schema by expressions, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import table

#: Kilograms on a square metre by class, low, middle and high. A class that is missing has no estimate.
DENSITIES = {"view": (0.89, 1.51, 2.27), "click": (0.67, 1.38, 2.51), "purchase": (1.5, 3.5, 7.0), "signup": (1.73, 3.29, 5.85)}


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, photo_idx, class_name, confidence, area_m2 (some null), k, ts."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("det_id"), F.col("user_id").alias("photo_idx"), F.col("event_type").alias("class_name"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
        F.when(k % 7 != 0, k / 100).alias("area_m2"), k.alias("k"), "ts",
    )


DETECTIONS = """detections AS (
    SELECT event_id AS det_id, user_id AS photo_idx, event_type AS class_name, least(1.0::DOUBLE, value / 100) AS confidence,
        CASE WHEN k % 7 <> 0 THEN k / 100.0::DOUBLE END AS area_m2, k, ts
    FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))"""


def densities(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{c}', {a}D, {b}D, {d}D)" for c, (a, b, d) in DENSITIES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS d(class_name, low, mid, high)")


DENSITY_ROWS = "densities(class_name, low, mid, high) AS (VALUES " + ", ".join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE)" for c, (a, b, d) in DENSITIES.items()) + ")"


def weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detections with weight_low, weight_mid, weight_high: null if the area is missing or the class has no density."""
    found = detections(spark, sf_dir).join(F.broadcast(densities(spark)), "class_name", "left")
    weights = [F.when(F.col("area_m2") > 0, F.col("area_m2") * F.col(c)).alias(f"weight_{c}") for c in ("low", "mid", "high")]
    return found.select("det_id", "photo_idx", "class_name", "confidence", "area_m2", "k", *weights)


WEIGHED = f"""{DETECTIONS}, {DENSITY_ROWS}, weighed AS (
    SELECT d.*, CASE WHEN area_m2 > 0 THEN area_m2 * low END AS weight_low, CASE WHEN area_m2 > 0 THEN area_m2 * mid END AS weight_mid,
        CASE WHEN area_m2 > 0 THEN area_m2 * high END AS weight_high FROM detections d LEFT JOIN densities USING (class_name))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, photo_idx, class_name, confidence, x0, y0, x1, y1: axis-aligned detections on a 20 000 x 2 000 ground."""
    key = F.col("l_orderkey") * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    x0, y0 = (F.col("l_orderkey") * 37 + F.col("l_partkey") * 11) % 20000, (F.col("l_partkey") * 53 + F.col("l_suppkey") * 7) % 2000
    rows = table(spark, sf_dir, "lineitem").select(
        key.alias("det_id"), F.col("l_suppkey").alias("photo_idx"), F.col("l_returnflag").alias("class_name"), F.round(1 - 5 * F.col("l_discount"), 2).alias("confidence"),
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), F.col("l_quantity").alias("w"), (F.col("l_linenumber") + 5).cast("double").alias("h"),
    )
    one = rows.groupBy("det_id").agg(*[F.min(c).alias(c) for c in ("photo_idx", "class_name", "confidence", "x0", "y0", "w", "h")])
    return one.select("det_id", "photo_idx", "class_name", "confidence", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


BOXES = """boxes AS (
    SELECT det_id, photo_idx, class_name, confidence, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM (
        SELECT l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS det_id, min(l_suppkey) AS photo_idx, min(l_returnflag) AS class_name,
            min(round(1 - 5 * l_discount, 2)) AS confidence, min((l_orderkey * 37 + l_partkey * 11) % 20000)::DOUBLE AS x0, min((l_partkey * 53 + l_suppkey * 7) % 2000)::DOUBLE AS y0,
            min(l_quantity) AS w, min(l_linenumber + 5)::DOUBLE AS h
        FROM lineitem GROUP BY 1)),
cells AS (SELECT b.*, cx.unnest AS cx, cy.unnest AS cy FROM boxes b, unnest(range(floor(x0 / 64)::BIGINT, floor(x1 / 64)::BIGINT + 1)) cx, unnest(range(floor(y0 / 64)::BIGINT, floor(y1 / 64)::BIGINT + 1)) cy)"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_idx, lon, lat, alt, pitch, yaw (some null), sensor_mm (some null), focal_mm, width, height, site."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("photo_idx"), F.when(k % 17 != 0, F.col("s_nationkey") * 14.0 - 170).alias("lon"), F.when(k % 17 != 0, (k % 120) - 60.0).alias("lat"), (F.col("s_acctbal") / 100).alias("alt"),
        (F.col("s_nationkey") - 102).cast("double").alias("pitch"), F.when(k % 13 != 0, (k * 37 % 360).cast("double")).alias("yaw"), F.when(k % 11 != 0, F.lit(13.1328)).alias("sensor_mm"),
        F.lit(8.38).alias("focal_mm"), F.lit(5472).alias("width"), F.lit(3648).alias("height"), F.concat(F.lit("S"), F.col("s_nationkey")).alias("site"),
    )


PHOTOS = """photos AS (
    SELECT s_suppkey AS photo_idx, CASE WHEN s_suppkey % 17 <> 0 THEN s_nationkey * 14.0::DOUBLE - 170 END AS lon, CASE WHEN s_suppkey % 17 <> 0 THEN (s_suppkey % 120) - 60.0::DOUBLE END AS lat,
        s_acctbal / 100 AS alt, (s_nationkey - 102)::DOUBLE AS pitch, CASE WHEN s_suppkey % 13 <> 0 THEN (s_suppkey * 37 % 360)::DOUBLE END AS yaw,
        CASE WHEN s_suppkey % 11 <> 0 THEN 13.1328::DOUBLE END AS sensor_mm, 8.38::DOUBLE AS focal_mm, 5472 AS width, 3648 AS height, 'S' || s_nationkey AS site FROM supplier)"""


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent_id, batch, site, weight, ground (equal for the same ground), frozen: annotated images."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("parent_id"), F.concat_ws(" ", F.upper("lang"), F.col("source")).alias("batch"), F.upper("lang").alias("site"), F.col("n_chars").alias("weight"), F.md5(F.col("text").cast("binary")).alias("ground"), (F.col("doc_id") % 23 == 0).alias("frozen"))


PARENTS = "parents AS (SELECT doc_id AS parent_id, upper(lang) || ' ' || source AS batch, upper(lang) AS site, n_chars AS weight, md5(text) AS ground, doc_id % 23 = 0 AS frozen FROM documents)"


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, photo_idx, class_name, confidence, border, cx, cy, ring, x0, y0, x1, y1: outlines as photos of a strip see them.

    Things lie on a lattice, so that neighbouring photos see some of them again, moved by a centimetre or two. A ring is
    a rectangle turned by 45 degrees.
    """
    b, c = boxes(spark, sf_dir), F.col
    at = b.select(
        "det_id", "photo_idx", "class_name", "confidence", (c("det_id") % 10 == 3).alias("border"), ((c("x1") - c("x0")) / 10).alias("w"), ((c("y1") - c("y0")) / 10).alias("h"),
        (c("photo_idx") * 160 + 10 * (c("x0") % 40) + 0.01 * (c("det_id") % 3)).alias("cx"), (c("photo_idx") % 5 * 140 + 10 * (c("y0") % 30)).alias("cy"),
    )
    corner = lambda u, v: F.struct((c("cx") + (u * c("w") + v * c("h")) / 2).alias("x"), (c("cy") + (u * c("w") - v * c("h")) / 2).alias("y"))
    half = (c("w") + c("h")) / 2
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    return at.select("det_id", "photo_idx", "class_name", "confidence", "border", "cx", "cy", ring.alias("ring"), (c("cx") - half).alias("x0"), (c("cy") - half).alias("y0"), (c("cx") + half).alias("x1"), (c("cy") + half).alias("y1"))


def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_idx, x0, y0, x1, y1: the ground that each photo of sightings shows."""
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(k.alias("photo_idx"), (k * 160 - 5).cast("double").alias("x0"), (k % 5 * 140 - 5).cast("double").alias("y0"))
    return p.select("photo_idx", "x0", "y0", (F.col("x0") + 410).alias("x1"), (F.col("y0") + 310).alias("y1"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes as rings turned by 45 degrees and halved in area: their overlap ratios are those of the boxes; ring_* is the box around each."""
    b, c = boxes(spark, sf_dir), F.col
    corner = lambda u, v: F.struct(((c(u) + c(v)) / 2).alias("x"), ((c(u) - c(v)) / 2).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    box = {"x0": (c("x0") + c("y0")) / 2, "y0": (c("x0") - c("y1")) / 2, "x1": (c("x1") + c("y1")) / 2, "y1": (c("x1") - c("y0")) / 2}
    return b.select("det_id", "photo_idx", "class_name", "confidence", ring.alias("ring"), *[v.alias(k) for k, v in box.items()])
