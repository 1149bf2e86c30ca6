"""Spatial joins, suppression, clustering, ownership and fusion (J*, C*, F*, T* of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import geodesy
from tidemark.operators.copies import overlap_components, suppressed_boxes
from tidemark.operators.fusion import fuse
from tidemark.operators.matching import by_confidence, by_overlap
from tidemark.operators.spatial_join import area, drawn_in_for, iou, meeting_pairs, overlap, self_pairs
from tidemark.operators.tiling import most_square_grid, windows
from tidemark.plans.registry import register, table
from tidemark.plans.surveys import BOXES, PHOTOS, boxes, photos, sightings, strip
from tidemark.scratch import Scratch

CELL = 64.0
#: For joins of many boxes that overlap by a share: near their mean size.
CELL_OF_BOX = (32.0, 16.0)
#: SQL of the intersection of boxes a and b, and of their overlap ratio.
INTER = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
IOU = f"({INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {INTER}))"
MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
PAIRS = f"""pairs AS (SELECT DISTINCT a.det_id AS a, b.det_id AS b, a.photo_idx AS a_photo, b.photo_idx AS b_photo, a.class_name, a.confidence AS a_confidence, b.confidence AS b_confidence, {IOU} AS iou, {INTER} AS inter
    FROM cells a JOIN cells b ON a.cx = b.cx AND a.cy = b.cy AND a.class_name = b.class_name AND a.det_id < b.det_id AND {MEET})"""


def class_pairs(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    pairs = self_pairs(boxes(spark, sf_dir), CELL_OF_BOX, ("class_name",), "det_id", shrink=drawn_in_for(least))
    return pairs.withColumn("iou", iou()).filter(F.col("iou") >= least)


@register("j1_overlapping_pairs", f"WITH {BOXES}, {PAIRS} SELECT a, b, class_name, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.3")
def overlapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial self-join: pairs of one class that overlap by at least 0.3."""
    return class_pairs(spark, sf_dir, 0.3).select(F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"), F.col("a_class_name").alias("class_name"), F.round("iou", 6).alias("iou"))


@register(
    "c2_duplicate_groups",
    f"""WITH RECURSIVE {BOXES}, {PAIRS}, links AS (SELECT a, b FROM pairs WHERE iou >= 0.5 UNION SELECT b, a FROM pairs WHERE iou >= 0.5),
    reach(node, other) AS (SELECT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
    SELECT node AS det_id, 'grp:' || min(other) AS group_id, count(*) AS members FROM reach GROUP BY node""",
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of overlaps of 0.5, named by their smallest member."""
    scratch = Scratch(spark, "groups")
    labels = scratch.keep(overlap_components(boxes(spark, sf_dir), ("class_name",), 0.5, CELL_OF_BOX, scratch))
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    return labels.join(sizes, "label").select(F.col("node").alias("det_id"), F.concat(F.lit("grp:"), "label").alias("group_id"), "members")


@register(
    "c4_overlap_dedup",
    f"""WITH RECURSIVE {BOXES}, {PAIRS}, links AS (SELECT a, b FROM pairs WHERE iou >= 0.5 UNION SELECT b, a FROM pairs WHERE iou >= 0.5),
    reach(node, other) AS (SELECT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
    g AS (SELECT node, min(other) AS label FROM reach GROUP BY node),
    d AS (SELECT b.*, coalesce(label, det_id) AS cluster, x0 % 500 < 3 AS touch, round(sqrt(pow((x0 + x1) / 2 % 500 - 250, 2) + pow((y0 + y1) / 2 % 500 - 250, 2)) / (250 * sqrt(2)), 6) AS off FROM boxes b LEFT JOIN g ON node = det_id),
    r AS (SELECT *, bool_or(touch) OVER w AND NOT bool_and(touch) OVER w AS drop_touching, count(*) OVER w AS views FROM d WINDOW w AS (PARTITION BY cluster)),
    s AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY (touch AND drop_touching), off, confidence DESC, det_id) AS rn FROM r)
    SELECT det_id, views, off FROM s WHERE rn = 1 AND views > 1""",
)
def overlap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner of each group of views: border-touching views only if all touch, then the most central, then confident."""
    scratch = Scratch(spark, "dedup")
    labels = overlap_components(boxes(spark, sf_dir), ("class_name",), 0.5, CELL_OF_BOX, scratch)
    c = F.col
    found = boxes(spark, sf_dir).join(labels, c("det_id") == c("node"))  # a node has a link, so that its group has two views at least
    away = lambda a, b: F.pow((c(a) + c(b)) / 2 % 500 - 250, F.lit(2.0))
    found = found.withColumn("touch", c("x0") % 500 < 3).withColumn("off", F.round(F.sqrt(away("x0", "x1") + away("y0", "y1")) / (250 * F.sqrt(F.lit(2.0))), 6))
    turn = F.struct("off", F.coalesce(-c("confidence"), F.lit(float("inf"))).alias("sure"), "det_id")
    best = lambda touch: F.min(F.when(c("touch") == touch, turn))
    won = found.groupBy("label").agg(F.coalesce(best(False), best(True)).alias("won"), F.count("*").alias("views"))
    return won.select("won.det_id", "views", "won.off")


def suppressed(spark: SparkSession, sf_dir: str, measure, least: float, name: str, shrink: float = 0.0) -> DataFrame:
    return suppressed_boxes(boxes(spark, sf_dir), ("class_name",), measure, least, CELL_OF_BOX, Scratch(spark, name), shrink)


@register("c6_greedy_suppression")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression by confidence within a class, overlap from 0.3 on; what is dropped suppresses nobody."""
    return suppressed(spark, sf_dir, iou(), 0.3, "nms", drawn_in_for(0.3))


@register("c7_suppression_by_smaller")
def suppression_by_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the share of the smaller box that is covered, from 0.6 on."""
    return suppressed(spark, sf_dir, overlap() / F.least(area("a"), area("b")), 0.6, "nms-smaller")


@register(
    "j2_similar_neighbours",
    """WITH e AS (SELECT vec_id, label, embedding, (vec_id * 7 % 40)::DOUBLE AS x, (vec_id * 11 % 40)::DOUBLE AS y FROM embeddings WHERE embedding IS NOT NULL)
    SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 64
    WHERE round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) >= 0.25""",
)
def similar_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one class within 8 m whose embeddings have a cosine of at least 0.25; null embeddings take no part."""
    at = lambda k: (F.col("vec_id") * k % 40).cast("double")
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), at(7).alias("x0"), at(11).alias("y0"), at(7).alias("x1"), at(11).alias("y1"))
    near = self_pairs(e, 8.0, ("label",), "vec_id", distance=8.0)
    near = near.filter(F.pow(F.col("a_x0") - F.col("b_x0"), F.lit(2.0)) + F.pow(F.col("a_y0") - F.col("b_y0"), F.lit(2.0)) <= 64)
    dot = F.aggregate(F.zip_with("a_v", "b_v", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return near.filter(F.round(dot, 6) >= 0.25).select(F.col("a_vec_id").alias("a"), F.col("b_vec_id").alias("b"))


def candidates(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """Truth (even det_id) against predictions (odd), by class; an image is a block of the ground."""
    found = boxes(spark, sf_dir).withColumn("image", F.floor(F.col("x0") / 500) * 10 + F.floor(F.col("y0") / 500))
    truth, guess = found.filter("det_id % 2 = 0"), found.filter("det_id % 2 = 1")
    met = meeting_pairs(truth, guess, CELL, ("class_name", "image")).withColumn("iou", F.round(iou(), 9)).filter(F.col("iou") >= least)
    return met.select(F.col("a_image").alias("image"), F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"), "iou", F.col("b_confidence").alias("confidence"))


@register(
    "j3_match_candidates",
    f"""WITH {BOXES} SELECT DISTINCT floor(a.x0 / 500)::BIGINT * 10 + floor(a.y0 / 500)::BIGINT AS image, a.det_id AS a, b.det_id AS b, round({IOU}, 6) AS iou FROM cells a JOIN cells b ON a.cx = b.cx AND a.cy = b.cy
    AND a.class_name = b.class_name AND a.det_id % 2 = 0 AND b.det_id % 2 = 1 AND {MEET} AND floor(a.x0 / 500) = floor(b.x0 / 500) AND floor(a.y0 / 500) = floor(b.y0 / 500) WHERE {IOU} >= 0.1""",
)
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir, 0.1).select("image", "a", "b", F.round("iou", 6).alias("iou"))


@register("j4_match_by_overlap")
def match_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one by overlap, full outer: unmatched truth and predictions stay, with an overlap of 0."""
    pairs = by_overlap(candidates(spark, sf_dir, 0.1), "image")
    ids = boxes(spark, sf_dir).select("det_id")
    left = ids.filter("det_id % 2 = 0").join(pairs, F.col("det_id") == F.col("a"), "left").select(F.col("det_id").alias("truth"), F.col("b").alias("guess"), F.coalesce("iou", F.lit(0.0)).alias("iou"))
    alone = ids.filter("det_id % 2 = 1").join(pairs, F.col("det_id") == F.col("b"), "left_anti")
    return left.union(alone.select(F.lit(None).cast("long"), "det_id", F.lit(0.0)))


@register("j5_match_by_confidence")
def match_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy by confidence: each prediction takes the best truth still free, overlap from 0.5 on. Every prediction has a row, tp 0 if it found none."""
    taken = by_confidence(candidates(spark, sf_dir, 0.5), "image").select(F.col("b").alias("guess"), F.col("a").alias("truth"), "iou")
    guesses = boxes(spark, sf_dir).filter("det_id % 2 = 1").select(F.col("det_id").alias("guess"), "class_name", "confidence")
    return guesses.join(taken, "guess", "left").select("guess", "class_name", "confidence", "truth", F.coalesce("iou", F.lit(0.0)).alias("iou"), F.col("truth").isNotNull().cast("int").alias("tp"))


@register(
    "j6_unowned_candidates",
    f"""WITH {BOXES} SELECT b.det_id, b.class_name FROM boxes b WHERE b.det_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM cells a JOIN cells c ON a.cx = c.cx AND a.cy = c.cy WHERE c.det_id = b.det_id AND a.det_id % 3 <> 0 AND a.class_name = b.class_name AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)""",
)
def unowned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial anti join: candidates that no owner's detection of their class meets."""
    found = boxes(spark, sf_dir)
    own, others = found.filter("det_id % 3 <> 0"), found.filter("det_id % 3 = 0")
    met = meeting_pairs(others, own, CELL, ("class_name",)).select(F.col("a_det_id").alias("det_id")).distinct()
    return others.join(met, "det_id", "left_anti").select("det_id", "class_name")


#: Photos in a strip that overlap with the next ones, and three footprints (by class) of each beside each other.
FOOTPRINTS = """footprints AS (SELECT DISTINCT photo_idx, CASE class_name WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS code FROM boxes),
    f AS (SELECT photo_idx * 10 + code AS id, x0, y0, x0 + 400 AS x1, y0 + 300 AS y1 FROM (SELECT *, (photo_idx * 160 + code * 53)::DOUBLE AS x0, (photo_idx % 5 * 140 + code * 37)::DOUBLE AS y0 FROM footprints))"""


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("class_name") == "A", 0).when(F.col("class_name") == "N", 1).otherwise(2)
    by = boxes(spark, sf_dir).select("photo_idx", code.alias("code")).distinct()
    by = by.select((F.col("photo_idx") * 10 + F.col("code")).alias("id"), (F.col("photo_idx") * 160 + F.col("code") * 53).cast("double").alias("x0"), (F.col("photo_idx") % 5 * 140 + F.col("code") * 37).cast("double").alias("y0"))
    return by.select("id", "x0", "y0", (F.col("x0") + 400).alias("x1"), (F.col("y0") + 300).alias("y1"))


@register(
    "j8_overlap_neighbours",
    f"""WITH {BOXES}, {FOOTPRINTS}, p AS (SELECT a.id AS a, b.id AS b, round({INTER} / 120000, 6) AS share FROM f a JOIN f b ON a.id <> b.id AND {MEET}),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY share DESC, b) AS rn FROM p WHERE share >= 0.25)
    SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, share FROM r WHERE rn <= 10""",
)
def overlap_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints that share a quarter of the smaller; each one's ten best, either way, without repetition."""
    p = meeting_pairs(footprints(spark, sf_dir), footprints(spark, sf_dir), 512.0).filter("a_id <> b_id")
    p = p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(overlap() / 120000, 6).alias("share")).filter("share >= 0.25")
    best = p.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("share"), "b"))).filter("rn <= 10")
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "share").distinct()


@register(
    "j9_isolated_footprints",
    f"""WITH {BOXES}, {FOOTPRINTS}, p AS (SELECT a.id, max({INTER} / 120000) AS share FROM f a JOIN f b ON a.id <> b.id AND {MEET} GROUP BY 1)
    SELECT f.id, round(coalesce(share, 0), 6) AS share, coalesce(share, 0) < 0.15 AS isolated FROM f LEFT JOIN p USING (id)""",
)
def isolated_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = footprints(spark, sf_dir)
    best = meeting_pairs(all_, all_, 512.0).filter("a_id <> b_id").groupBy(F.col("a_id").alias("id")).agg(F.max(overlap() / 120000).alias("share"))
    share = F.coalesce("share", F.lit(0.0))
    return all_.select("id").join(best, "id", "left").select("id", F.round(share, 6).alias("share"), (share < 0.15).alias("isolated"))


OWNED = f"""{BOXES}, {FOOTPRINTS}, grid AS (SELECT f.id, gx.unnest AS gx, gy.unnest AS gy, round(pow(gx.unnest * 100 + 50 - (x0 + x1) / 2, 2) + pow(gy.unnest * 100 + 50 - (y0 + y1) / 2, 2), 3) AS d2
        FROM f, unnest(range(floor(x0 / 100)::BIGINT, floor(x1 / 100)::BIGINT + 1)) gx, unnest(range(floor(y0 / 100)::BIGINT, floor(y1 / 100)::BIGINT + 1)) gy
        WHERE gx.unnest * 100 + 50 BETWEEN x0 AND x1 AND gy.unnest * 100 + 50 BETWEEN y0 AND y1),
    owned AS (SELECT gx, gy, id FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY d2, id) AS rn FROM grid) WHERE rn = 1)"""


def owned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest join: each 100 m cell belongs to the footprint over its middle whose own middle is nearest."""
    c = F.col
    cells = lambda a, b: F.explode(F.sequence(F.floor(c(a) / 100), F.floor(c(b) / 100)))
    grid = footprints(spark, sf_dir).withColumn("gx", cells("x0", "x1")).withColumn("gy", cells("y0", "y1"))
    mx, my = c("gx") * 100 + 50, c("gy") * 100 + 50
    grid = grid.filter(mx.between(c("x0"), c("x1")) & my.between(c("y0"), c("y1")))
    d2 = F.round(F.pow(mx - (c("x0") + c("x1")) / 2, F.lit(2.0)) + F.pow(my - (c("y0") + c("y1")) / 2, F.lit(2.0)), 3)
    return grid.groupBy("gx", "gy").agg(F.min_by("id", F.struct(d2, "id")).alias("id"))


@register("j10_owned_cells", f"WITH {OWNED} SELECT gx, gy, id FROM owned")
def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned_cells(spark, sf_dir)


@register("a39_owned_area", f"WITH {OWNED} SELECT id, count(*) * 10000.0::DOUBLE AS area_m2 FROM owned GROUP BY id")
def owned_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned_cells(spark, sf_dir).groupBy("id").agg((F.count("*") * 10000.0).alias("area_m2"))


@register(
    "j11_point_owner",
    f"WITH {OWNED} SELECT det_id, coalesce(id, -1) AS owner FROM boxes LEFT JOIN owned ON gx = CAST(trunc((x0 + x1) / 200) AS BIGINT) AND gy = CAST(trunc((y0 + y1) / 200) AS BIGINT)",
)
def point_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection's owner by its cell; -1 outside. Truncation towards zero."""
    at = lambda a, b: ((F.col(a) + F.col(b)) / 200).cast("long")
    found = boxes(spark, sf_dir).select("det_id", at("x0", "x1").alias("gx"), at("y0", "y1").alias("gy"))
    return found.join(owned_cells(spark, sf_dir), ["gx", "gy"], "left").select("det_id", F.coalesce("id", F.lit(-1)).alias("owner"))


@register(
    "j17_block_borders",
    f"""WITH {OWNED}, n AS (SELECT a.id AS a, b.id AS b FROM owned a JOIN owned b ON (b.gx = a.gx + 1 AND b.gy = a.gy) OR (b.gx = a.gx AND b.gy = a.gy + 1))
    SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS borders, least(a, b) = greatest(a, b) AS same FROM n GROUP BY 1, 2""",
)
def block_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often cells of two owners lie side by side or one below the other."""
    cells = owned_cells(spark, sf_dir)
    step = cells.withColumn("s", F.explode(F.array(F.struct(F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.lit(0).alias("x"), F.lit(1).alias("y")))))
    step = step.select((F.col("gx") + F.col("s.x")).alias("gx"), (F.col("gy") + F.col("s.y")).alias("gy"), F.col("id").alias("other"))
    met = cells.join(step, ["gx", "gy"]).groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.count("*").alias("borders"))
    return met.withColumn("same", F.col("a") == F.col("b"))


@register("a46_union_area", f"WITH {BOXES}, {FOOTPRINTS} SELECT count(*) * 2500.0::DOUBLE AS area_m2 FROM (SELECT DISTINCT gx.unnest, gy.unnest FROM f, unnest(range(floor(x0 / 50)::BIGINT, ceil(x1 / 50)::BIGINT)) gx, unnest(range(floor(y0 / 50)::BIGINT, ceil(y1 / 50)::BIGINT)) gy)")
def union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under any footprint, by cells of 50 m."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 50), F.ceil(F.col(b) / 50) - 1))
    return footprints(spark, sf_dir).withColumn("gx", cells("x0", "x1")).withColumn("gy", cells("y0", "y1")).select("gx", "gy").distinct().agg((F.count("*") * 2500.0).alias("area_m2"))


@register(
    "j23_zone_of_detection",
    f"""WITH {BOXES}, {FOOTPRINTS}, z AS (SELECT b.det_id, a.id % 10 AS kind FROM f a JOIN boxes b ON {MEET} WHERE {INTER} >= 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0))
    SELECT det_id, coalesce(min(kind), 9)::BIGINT AS zone FROM boxes LEFT JOIN z USING (det_id) GROUP BY det_id""",
)
def zone_of_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone kind of highest precedence that covers half of a detection; 9 is none."""
    met = meeting_pairs(footprints(spark, sf_dir), boxes(spark, sf_dir), 256.0).filter(overlap() >= 0.5 * area("b"))
    zone = met.groupBy(F.col("b_det_id").alias("det_id")).agg(F.min(F.col("a_id") % 10).alias("zone"))
    return boxes(spark, sf_dir).select("det_id").join(zone, "det_id", "left").select("det_id", F.coalesce("zone", F.lit(9)).cast("long").alias("zone"))


@register("c8_owner_and_rescue")
def owner_and_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-view fusion: owners' detections, and what other photos saw where the owner saw nothing."""
    scratch = Scratch(spark, "fusion")
    return fuse(scratch.keep(sightings(spark, sf_dir)), strip(spark, sf_dir), scratch, cell=16.0)


@register(
    "t1_tile_windows",
    """WITH s AS (SELECT p_partkey, 400 + p_size * 90 AS w, 300 + p_size * 61 AS h FROM part),
    x AS (SELECT p_partkey, greatest(0, least(i.unnest, w - 640)) AS x0 FROM s, unnest(range(0, greatest(w, 1), 384)) i), y AS (SELECT p_partkey, greatest(0, least(i.unnest, h - 640)) AS y0 FROM s, unnest(range(0, greatest(h, 1), 384)) i)
    SELECT p_partkey, x0, y0, x0 + 640 AS x1, y0 + 640 AS y1, count(*) AS times FROM x JOIN y USING (p_partkey) GROUP BY ALL""",
)
def tile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 640 at steps of 384; they are moved inside at the far edge, and so repeat there."""
    s = table(spark, sf_dir, "part").select("p_partkey", (400 + F.col("p_size") * 90).alias("w"), (300 + F.col("p_size") * 61).alias("h"))
    return windows(s, "w", "h", 640, 384).groupBy("p_partkey", "x0", "y0", "x1", "y1").agg(F.count("*").alias("times"))


@register(
    "f40_most_square_grid",
    """WITH s AS (SELECT p_partkey, 4000 + p_size * 190 AS w, 3000 + p_size * 97 AS h, greatest(1, ceil((4000 + p_size * 190) * (3000 + p_size * 97) / 20000000))::INTEGER AS n FROM part),
    d AS (SELECT p_partkey, n, i.unnest::INTEGER AS k, round(abs(ln((w / i.unnest) / (h / (n / i.unnest)))), 9) AS off FROM s, unnest(range(1, n + 1)) i WHERE n % i.unnest = 0)
    SELECT p_partkey, arg_min(k, [off, k]) AS columns, (max(n) // arg_min(k, [off, k]))::INTEGER AS rows FROM d GROUP BY 1""",
)
def square_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of an image under a pixel cap, as near to squares as divisors allow."""
    s = table(spark, sf_dir, "part").select("p_partkey", (4000 + F.col("p_size") * 190).alias("w"), (3000 + F.col("p_size") * 97).alias("h"))
    return s.select("p_partkey", most_square_grid(F.col("w"), F.col("h"), 20_000_000).alias("g")).select("p_partkey", "g.columns", "g.rows")


@register(
    "f22_map_tiles",
    f"""WITH {PHOTOS}, u AS (SELECT photo_idx, lon, lat, least(21, ceil(log2(2 * 20037508.342789244 / 256 * cos(radians(lat)) / (alt * 13.1328 / (8.38 * 5472)))))::INTEGER AS zoom FROM photos WHERE lon IS NOT NULL AND alt > 1)
    SELECT photo_idx, zoom, floor((lon + 180) / 360 * pow(2, zoom))::BIGINT AS tx, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, zoom))::BIGINT AS ty FROM u""",
)
def map_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The XYZ tile of each photo at its native zoom."""
    c = F.col
    u = photos(spark, sf_dir).filter("lon is not null and alt > 1")
    u = u.withColumn("zoom", geodesy.native_zoom(geodesy.ground_sample(c("alt"), F.lit(13.1328), c("focal_mm"), c("width")), c("lat")))
    x, y = geodesy.tile_of(c("lon"), c("lat"), c("zoom"))
    return u.select("photo_idx", "zoom", x.cast("long").alias("tx"), y.cast("long").alias("ty"))
