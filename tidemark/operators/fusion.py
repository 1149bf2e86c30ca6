"""Multi-view fusion: one object for each thing on the ground, from detections of overlapping photos.

Each place is read on the photo that sees it most centrally, its owner: the owner's detections stay as they are, each
an object. Where the owner saw nothing, other photos' detections are grouped between photos and rescued.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import polygon_common_area, ring_area
from tidemark.operators.cluster import connected_components
from tidemark.operators.spatial_join import in_cells, meeting_pairs, self_pairs
from tidemark.scratch import Scratch

#: Detections of different photos are one object if they overlap by this, if this share of the smaller is
#: covered, or if their middles are nearer than this (metres). A view at the border counts so much less as representative.
LEAST_IOU, LEAST_SMALLER, NEAR, BORDER = 0.25, 0.6, 0.08, 0.3


def _measured(pairs: DataFrame) -> DataFrame:
    """Pairs of rings with ``common`` (area) and ``apart`` (distance of middles)."""
    pairs = pairs.withColumn("apart", F.sqrt((F.col("a_cx") - F.col("b_cx")) ** 2 + (F.col("a_cy") - F.col("b_cy")) ** 2))
    return pairs.withColumn("common", polygon_common_area("a_ring", "b_ring"))


def owners(found: DataFrame, photos: DataFrame, res: float) -> DataFrame:
    """found with ``owner``: of the photos (photo_idx, x0, y0, x1, y1) over the cell of a detection's middle, the one whose own middle is nearest the cell's; -1 if none."""
    at = lambda v: F.floor(F.col(v) / res)
    wanted = found.select(at("cx").alias("gx"), at("cy").alias("gy")).distinct()
    mid = wanted.select("gx", "gy", *[((F.col(g) + 0.5) * res).alias(k) for g, k in (("gx", "x0"), ("gy", "y0"), ("gx", "x1"), ("gy", "y1"))])
    over = meeting_pairs(mid, photos, 512.0)
    d2 = (F.col("a_x0") - (F.col("b_x0") + F.col("b_x1")) / 2) ** 2 + (F.col("a_y0") - (F.col("b_y0") + F.col("b_y1")) / 2) ** 2
    best = over.groupBy(F.col("a_gx").alias("gx"), F.col("a_gy").alias("gy")).agg(F.min_by("b_photo_idx", F.struct(F.round(d2, 6), "b_photo_idx")).alias("owner"))
    return found.withColumn("gx", at("cx")).withColumn("gy", at("cy")).join(best, ["gx", "gy"], "left").drop("gx", "gy").withColumn("owner", F.coalesce("owner", F.lit(-1)))


def views_of(points: DataFrame, photos: DataFrame, margin: float) -> DataFrame:
    """points (object, cx, cy) with ``available``: photos that see each, farther than margin from their borders."""
    inner = in_cells(photos.select(*[(F.col(c) + s * margin).alias(c) for c, s in (("x0", 1), ("y0", 1), ("x1", -1), ("y1", -1))]).filter("x0 < x1 and y0 < y1"), 512.0)
    placed = points.withColumn("cell_x", F.floor(F.col("cx") / 512.0)).withColumn("cell_y", F.floor(F.col("cy") / 512.0))
    seen = (F.col("cx") >= F.col("x0")) & (F.col("cx") < F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") < F.col("y1"))
    met = placed.join(inner, ["cell_x", "cell_y"]).filter(seen).groupBy("object").agg(F.count("*").alias("available"))
    return points.join(met, "object", "left").withColumn("available", F.coalesce("available", F.lit(0)))


def fuse(found: DataFrame, photos: DataFrame, scratch: Scratch, cell: float = 64.0, res: float = 10.0, margin: float = 40.0) -> DataFrame:
    """object_id, class_name, confidence, best_view, n_views, rescued.

    found: det_id, photo_idx, class_name, confidence, border, cx, cy, ring and its box x0, y0, x1, y1; photos:
    photo_idx and box. A detection of another photo than the owner's is dropped if it meets one of the owner's or their
    middles are near. The rest is grouped between photos; a group has one view for each photo, its most confident.
    Its score is the mean of its two best views, a single one halved, unless fewer than two photos see its middle: then
    the best view's. It is represented by the most confident view, one at the border BORDER less; its class is the one
    with most confidence in all. Ties go to the smaller det_id (of views: to the photo seen first).
    """
    c = F.col
    found = scratch.keep(owners(found, photos, res))
    own, others = found.filter("photo_idx = owner"), found.filter("photo_idx <> owner")
    met = _measured(meeting_pairs(others, own, cell, distance=NEAR)).filter((c("common") > 0) | (c("apart") < NEAR))
    rest = scratch.keep(others.join(met.select(c("a_det_id").alias("det_id")).distinct(), "det_id", "left_anti"))
    pairs = _measured(self_pairs(rest, cell, (), "det_id", NEAR).filter("a_photo_idx <> b_photo_idx"))
    a, b = ring_area(c("a_ring")), ring_area(c("b_ring"))
    overlap = (c("common") > 0) & ((c("common") / (a + b - c("common")) >= LEAST_IOU) | (c("common") / F.least(a, b) >= LEAST_SMALLER))
    links = scratch.keep(pairs.filter(overlap | (c("apart") < NEAR)).select(c("a_det_id").alias("a"), c("b_det_id").alias("b")))
    labels = connected_components(links, scratch)
    grouped = scratch.keep(rest.join(labels, c("det_id") == c("node"), "left").withColumn("object", F.coalesce("label", "det_id")).drop("node", "label", "ring"))
    middles = views_of(grouped.groupBy("object").agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy")), photos, margin).select("object", "available")
    views = grouped.groupBy("object", "photo_idx").agg(F.min("det_id").alias("first"), F.min_by(F.struct("det_id", "class_name", "confidence", "border"), F.struct(-c("confidence"), c("det_id"))).alias("v"))
    views = views.select("object", "first", "v.*")
    turn = Window.partitionBy("object").orderBy(F.desc("confidence"), "first")
    views = views.withColumn("turn", F.row_number().over(turn))
    votes = views.groupBy("object", "class_name").agg(F.sum("confidence").alias("total"), F.min("turn").alias("turn"))
    votes = votes.groupBy("object").agg(F.min_by("class_name", F.struct(F.round(-c("total"), 9), "turn")).alias("class_name"))
    worth = c("confidence") - F.when(c("border"), BORDER).otherwise(0.0)
    best = views.groupBy("object").agg(F.max("confidence").alias("best"), F.coalesce(F.max(F.when(c("turn") == 2, c("confidence"))), F.lit(0.0)).alias("second"), F.count("*").alias("n_views"), F.min_by("det_id", F.struct(F.round(-worth, 9), "turn")).alias("object_id"))
    whole = best.join(votes, "object").join(middles, "object")
    score = F.when(c("available") >= 2, (c("best") + c("second")) / 2).otherwise(c("best"))
    rescued = whole.select("object_id", "class_name", F.round(score, 4).alias("confidence"), F.round("best", 4).alias("best_view"), "n_views", F.lit(True).alias("rescued"))
    kept = own.select(c("det_id").alias("object_id"), "class_name", "confidence", c("confidence").alias("best_view"), F.lit(1).cast("long").alias("n_views"), F.lit(False).alias("rescued"))
    return kept.union(rescued)
