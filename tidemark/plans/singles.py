"""Queries of single operators that others only use on the way: predicates, orders, windows, keys, class lists, bench sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import geodesy, keys
from tidemark.operators.copies import overlap_components
from tidemark.operators.running import in_parts, running
from tidemark.operators.split import hash_split
from tidemark.plans.registry import register, table
from tidemark.plans.spatial import BOXES, CELL_OF_BOX, FOOTPRINTS, INTER, MEET, OWNED, PAIRS, block_borders, footprints
from tidemark.plans.surveys import DENSITY_ROWS, DETECTIONS, PARENTS, PHOTOS, WEIGHED, boxes, densities, detections, parents, photos, weighed
from tidemark.operators.spatial_join import meeting_pairs, overlap
from tidemark.scratch import Scratch

c = F.col


# predicates


@register("p3_confident_of_classes", f"WITH {DETECTIONS} SELECT det_id FROM detections WHERE confidence >= 0.6 AND class_name IN ('view', 'click')")
def confident_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).filter((c("confidence") >= 0.6) & c("class_name").isin("view", "click")).select("det_id")


@register("p6_raw_border", f"WITH {BOXES} SELECT det_id, x0 % 640 <= 2 OR y0 % 640 <= 2 OR x1 % 640 >= 637 OR y1 % 640 >= 637 AS border FROM boxes")
def raw_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border flag of a raw detection in its 640-pixel window: 2 pixels at the near sides, 3 at the far ones."""
    at = lambda k: c(k) % 640
    return boxes(spark, sf_dir).select("det_id", ((at("x0") <= 2) | (at("y0") <= 2) | (at("x1") >= 637) | (at("y1") >= 637)).alias("border"))


@register("p9_batches_by_substring", f"WITH {PARENTS} SELECT parent_id, batch, row_number() OVER (PARTITION BY batch ORDER BY parent_id) AS turn FROM parents WHERE contains(lower(batch), 'src1') AND site = 'EN'")
def batches_by_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope and a substring of the batch, whatever its case; in order within each batch."""
    some = parents(spark, sf_dir).filter(F.contains(F.lower("batch"), F.lit("src1")) & (c("site") == "EN"))
    order = [F.asc("parent_id")]
    return running(in_parts(some, ["batch"], order, Scratch(spark, "batches")), ["batch"], order, {}).select("parent_id", "batch", c("rn").alias("turn"))


@register("p12_not_on_nodata", f"WITH {DETECTIONS} SELECT class_name, count(*) AS kept FROM detections WHERE (k % 20) / 20 < 0.5 GROUP BY 1")
def not_on_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that lie on nodata by less than half."""
    return detections(spark, sf_dir).filter(c("k") % 20 / 20 < 0.5).groupBy("class_name").agg(F.count("*").alias("kept"))


@register(
    "p16_resolution_warning",
    f"WITH {PHOTOS}, g AS (SELECT photo_idx, alt * sensor_mm / (focal_mm * width) AS gsd FROM photos) SELECT photo_idx, round(gsd, 9) AS gsd, NOT (gsd BETWEEN 0.85 * 0.005 AND 1.15 * 0.012) AS outside FROM g WHERE gsd IS NOT NULL AND gsd > 0",
)
def resolution_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ground sample beyond 15 % around the trained range."""
    g = photos(spark, sf_dir).select("photo_idx", geodesy.ground_sample(c("alt"), c("sensor_mm"), c("focal_mm"), c("width")).alias("gsd")).filter("gsd > 0")
    return g.select("photo_idx", F.round("gsd", 9).alias("gsd"), (~c("gsd").between(0.85 * 0.005, 1.15 * 0.012)).alias("outside"))


@register("p17_defaults", f"WITH {PHOTOS} SELECT photo_idx AS id, coalesce(lat, 0) AS latitude, coalesce(yaw, 0) AS heading, coalesce(sensor_mm, 13.2) AS sensor, site AS place FROM photos")
def with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = photos(spark, sf_dir)
    return p.select(c("photo_idx").alias("id"), F.coalesce("lat", F.lit(0.0)).alias("latitude"), F.coalesce("yaw", F.lit(0.0)).alias("heading"), F.coalesce("sensor_mm", F.lit(13.2)).alias("sensor"), c("site").alias("place"))


# clusters and views


@register(
    "c1_components",
    f"""WITH RECURSIVE {BOXES}, {PAIRS}, links AS (SELECT a, b FROM pairs WHERE iou >= 0.6 UNION SELECT b, a FROM pairs WHERE iou >= 0.6),
    reach(node, other) AS (SELECT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other) SELECT node, min(other) AS root FROM reach GROUP BY node""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest member that each node reaches over links."""
    scratch = Scratch(spark, "components")
    return overlap_components(boxes(spark, sf_dir), ("class_name",), 0.6, CELL_OF_BOX, scratch).withColumnRenamed("label", "root")


@register(
    "c3_cluster_winners",
    f"""WITH {DETECTIONS}, d AS (SELECT *, k < 3 AS touch, abs(k - 50) AS off FROM detections), r AS (SELECT *, bool_or(touch) OVER w AND NOT bool_and(touch) OVER w AS spare FROM d WINDOW w AS (PARTITION BY photo_idx, class_name)),
    s AS (SELECT *, row_number() OVER (PARTITION BY photo_idx, class_name ORDER BY (touch AND spare), off, confidence DESC, det_id) AS rn FROM r) SELECT photo_idx, class_name, det_id, off FROM s WHERE rn = 1""",
)
def cluster_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view of each cluster (a photo's class): none at the border if others are there; the most central, then the most confident."""
    d = detections(spark, sf_dir).withColumn("touch", c("k") < 3).withColumn("off", F.abs(c("k") - 50))
    # one pass with partial aggregates: the best of each kind, and the choice between them
    best = lambda rows: F.min(F.when(rows, F.struct("off", (-c("confidence")).alias("sure"), "det_id")))
    by = d.groupBy("photo_idx", "class_name").agg(best(~c("touch")).alias("inner"), best(c("touch")).alias("outer"))
    won = F.coalesce("inner", "outer")
    return by.select("photo_idx", "class_name", won["det_id"].alias("det_id"), won["off"].alias("off"))


@register(
    "c11_border_frequencies",
    f"""WITH {OWNED}, n AS (SELECT a.id AS a, b.id AS b FROM owned a JOIN owned b ON (b.gx = a.gx + 1 AND b.gy = a.gy) OR (b.gx = a.gx AND b.gy = a.gy + 1)),
    p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS borders FROM n GROUP BY 1, 2) SELECT a = b AS same, count(*) AS pairs, sum(borders)::BIGINT AS borders FROM p GROUP BY 1""",
)
def border_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_borders(spark, sf_dir).groupBy("same").agg(F.count("*").alias("pairs"), F.sum("borders").alias("borders"))


@register("a3_representative", f"WITH {DETECTIONS} SELECT photo_idx, arg_max(det_id, [round(confidence - CASE WHEN k < 5 THEN 0.3 ELSE 0 END, 6), -det_id]) AS det_id FROM detections GROUP BY 1")
def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view that stands for its group: most confident, one at the border 0.3 less."""
    worth = F.round(c("confidence") - F.when(c("k") < 5, 0.3).otherwise(0.0), 6)
    return detections(spark, sf_dir).groupBy("photo_idx").agg(F.max_by("det_id", F.struct(worth, -c("det_id"))).alias("det_id"))


@register(
    "a23_client_totals",
    f"""WITH {WEIGHED}, g AS (SELECT count(DISTINCT photo_idx) * 400.0::DOUBLE AS ground FROM weighed) SELECT coalesce(class_name, 'all') AS class_name, count(*) AS n, round(sum(area_m2), 3) AS area, round(sum(weight_mid), 3) AS weight,
    round(count(*) / max(ground), 6) AS density, round(100 * sum(area_m2) / max(ground), 6) AS ground_share FROM weighed CROSS JOIN g WHERE confidence >= 0.6 GROUP BY ROLLUP (class_name)""",
)
def client_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, area, weight, density and share of the ground at a threshold, by class and in all."""
    w = weighed(spark, sf_dir)
    ground = w.agg((F.countDistinct("photo_idx") * 400.0).alias("ground"))
    t = w.filter("confidence >= 0.6").rollup("class_name").agg(F.count("*").alias("n"), F.sum("area_m2").alias("area"), F.sum("weight_mid").alias("w")).join(F.broadcast(ground))
    return t.select(F.coalesce("class_name", F.lit("all")).alias("class_name"), "n", F.round("area", 3).alias("area"), F.round("w", 3).alias("weight"), F.round(c("n") / c("ground"), 6).alias("density"), F.round(100 * c("area") / c("ground"), 6).alias("ground_share"))


# windows and orders


@register("w4_rank_in_class", f"WITH {DETECTIONS} SELECT det_id, class_name, row_number() OVER (PARTITION BY class_name ORDER BY confidence DESC, det_id) AS rn FROM detections")
def rank_in_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of suppression; a class may hold any share of the rows."""
    order = [F.desc("confidence"), F.asc("det_id")]
    parts = in_parts(detections(spark, sf_dir).select("det_id", "class_name", "confidence"), ["class_name"], order, Scratch(spark, "ranks"))
    return running(parts, ["class_name"], order, {}).select("det_id", "class_name", "rn")


@register(
    "w5_nearest_neighbours",
    f"""WITH {BOXES}, {FOOTPRINTS}, p AS (SELECT a.id AS id, b.id AS other, round({INTER} / 120000, 6) AS share FROM f a JOIN f b ON a.id <> b.id AND {MEET})
    SELECT id, other, share, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, other) AS rn FROM p) WHERE rn <= 3""",
)
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the three footprints that each shares most ground with."""
    p = meeting_pairs(footprints(spark, sf_dir), footprints(spark, sf_dir), 512.0).filter("a_id <> b_id").select(c("a_id").alias("id"), c("b_id").alias("other"), F.round(overlap() / 120000, 6).alias("share"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("share"), "other"))).filter("place <= 3")


@register("w7_share_of_total", f"WITH {DETECTIONS} SELECT class_name, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS share FROM detections GROUP BY 1")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = detections(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("n"))
    return by.join(F.broadcast(by.agg(F.sum("n").alias("whole")))).select("class_name", "n", F.round(100 * c("n") / c("whole"), 6).alias("share"))


@register(
    "w8_spread_of_shares",
    "WITH s AS (SELECT l_returnflag AS class_name, l_linestatus AS split, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT class_name, split, 100 * n / sum(n) OVER (PARTITION BY split) AS share FROM s) SELECT class_name, round(max(share) - min(share), 6) AS spread, count(*) AS splits FROM r GROUP BY 1",
)
def spread_of_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(c("l_returnflag").alias("class_name"), c("l_linestatus").alias("split")).agg(F.count("*").alias("n"))
    r = s.withColumn("share", 100 * c("n") / F.sum("n").over(Window.partitionBy("split")))
    return r.groupBy("class_name").agg(F.round(F.max("share") - F.min("share"), 6).alias("spread"), F.count("*").alias("splits"))


@register("o1_classes_by_count", f"WITH {DETECTIONS}, n AS (SELECT class_name, count(*) AS n, min(det_id) AS first FROM detections GROUP BY 1) SELECT class_name, n, row_number() OVER (ORDER BY n DESC, first) AS turn FROM n")
def classes_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent first; of equal ones the first seen. One row a class is ordered, not the detections."""
    by = detections(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("n"), F.min("det_id").alias("first"))
    return by.select("class_name", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("turn"))


@register("o3_first_of_an_order", f"WITH {PARENTS} SELECT parent_id, batch FROM parents ORDER BY sha256('show:' || parent_id), parent_id LIMIT 50")
def first_of_an_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit after a total order, which makes a sample that reruns give again."""
    return parents(spark, sf_dir).orderBy(F.sha2(F.concat(F.lit("show:"), c("parent_id").cast("string")).cast("binary"), 256), "parent_id").limit(50).select("parent_id", "batch")


@register("o5_heaviest_first", f"WITH {PARENTS} SELECT parent_id, batch, row_number() OVER (PARTITION BY batch ORDER BY weight DESC, sha256('42:' || parent_id), parent_id) AS turn FROM parents")
def heaviest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which units are dealt out: heaviest first, equal ones by a seeded hash."""
    order = [F.desc("weight"), F.asc("lot"), F.asc("parent_id")]
    rows = parents(spark, sf_dir).withColumn("lot", F.sha2(F.concat(F.lit("42:"), c("parent_id").cast("string")).cast("binary"), 256))
    return running(in_parts(rows.select("parent_id", "batch", "weight", "lot"), ["batch"], order, Scratch(spark, "heaviest")), ["batch"], order, {}).select("parent_id", "batch", c("rn").alias("turn"))


# sets


@register("u5_common_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def common_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@register("u6_orphan_differences", "(SELECT doc_id AS id, 'no image' AS what FROM labels EXCEPT SELECT doc_id, 'no image' FROM documents) UNION ALL (SELECT doc_id, 'no label' FROM documents EXCEPT SELECT doc_id, 'no label' FROM labels)")
def orphan_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table(spark, sf_dir, t).select(c("doc_id").alias("id")) for t in ("labels", "documents"))
    return a.subtract(b).withColumn("what", F.lit("no image")).union(b.subtract(a).withColumn("what", F.lit("no label")))


@register("u8_pending", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 48")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What earlier runs left to be purged, and what this one adds: each once."""
    o = table(spark, sf_dir, "orders")
    more = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select("l_orderkey")
    return o.filter("o_orderstatus = 'P'").select("o_orderkey").union(o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey")).union(more).distinct()


# keys

PATHS = "paths AS (SELECT c_custkey AS k, 'SB ' || c_nationkey || '/images/train/' || c_name || ' ' || c_custkey % 7 || '.v2.jpg' AS path FROM customer)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer")
    return t.select(c("c_custkey").alias("k"), F.concat(F.lit("SB "), "c_nationkey", F.lit("/images/train/"), "c_name", F.lit(" "), (c("c_custkey") % 7).cast("string"), F.lit(".v2.jpg")).alias("path"))


@register("f3_parent_ids", f"WITH {PATHS} SELECT k, translate(regexp_replace(path, '\\.[^./\\\\]*$', ''), '/\\ ', '___') AS parent_id FROM paths")
def parent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("k", keys.parent_id(c("path")).alias("parent_id"))


@register(
    "f4_parents_of_tiles",
    "WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, 'p_' || l_orderkey || CASE WHEN l_linenumber % 3 = 0 THEN '_x' ELSE '_' || l_linenumber * 384 || '_' || l_partkey END AS name FROM lineitem) SELECT k, n, CASE WHEN regexp_matches(name, '^.*_\\d+_\\d+$') THEN regexp_extract(name, '^(.*)_\\d+_\\d+$', 1) ELSE name END AS parent FROM t",
)
def parents_of_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    tail = F.when(c("l_linenumber") % 3 == 0, F.lit("_x")).otherwise(F.concat(F.lit("_"), (c("l_linenumber") * 384).cast("string"), F.lit("_"), c("l_partkey").cast("string")))
    return l.select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), keys.parent_of_tile(F.concat(F.lit("p_"), c("l_orderkey").cast("string"), tail)).alias("parent"))


@register(
    "f5_tile_origins",
    "WITH t AS (SELECT p_partkey AS k, p_brand || CASE WHEN p_size % 4 = 0 THEN '_whole' ELSE '_y' || p_size * 100 || '_x' || p_size * 7 END AS name FROM part) SELECT k, TRY_CAST(nullif(regexp_extract(name, '_y(\\d+)_x(\\d+)', 1), '') AS INTEGER) AS y, TRY_CAST(nullif(regexp_extract(name, '_y(\\d+)_x(\\d+)', 2), '') AS INTEGER) AS x FROM t",
)
def tile_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat("p_brand", F.when(c("p_size") % 4 == 0, F.lit("_whole")).otherwise(F.concat(F.lit("_y"), (c("p_size") * 100).cast("string"), F.lit("_x"), (c("p_size") * 7).cast("string"))))
    return p.select(c("p_partkey").alias("k"), keys.tile_origin(name).alias("o")).select("k", "o.y", "o.x")


@register("f7_guessed_batches", f"WITH {PATHS}, n AS (SELECT k, translate(path, '/ ', '__') AS name FROM paths) SELECT k, replace(CASE WHEN k % 5 = 0 THEN regexp_replace(split_part(name, '_images_', 2), '\\.[^.]*$', '') ELSE split_part(name, '_images_', 1) END, '_', ' ') AS batch FROM n")
def guessed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For display: what stands before ``_images_``, or the name without its suffix; every fifth name here has no such part."""
    name = F.translate("path", "/ ", "__")
    name = F.when(c("k") % 5 == 0, F.split_part(name, F.lit("_images_"), F.lit(2))).otherwise(name)
    return paths(spark, sf_dir).select("k", keys.guessed_batch(name).alias("batch"))


@register("f8_anchored_paths", f"WITH {PATHS}, w AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'E:\\data\\raw\\' || replace(path, '/', '\\') WHEN k % 3 = 1 THEN '/mnt/raw/' || path ELSE path END AS path FROM paths) SELECT k, regexp_replace(replace(path, '\\', '/'), '^.*/raw/', '') AS path FROM w")
def anchored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of other machines from the marker folder on."""
    return foreign_paths(spark, sf_dir).select("k", keys.anchored(c("path"), "raw").alias("path"))


def foreign_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = F.concat(F.lit("E:\\data\\raw\\"), F.translate("path", "/", "\\"))
    return paths(spark, sf_dir).select("k", F.when(c("k") % 3 == 0, windows).when(c("k") % 3 == 1, F.concat(F.lit("/mnt/raw/"), "path")).otherwise(c("path")).alias("path"))


@register(
    "f9_known_parents",
    f"""WITH {PATHS}, w AS (SELECT k, CASE WHEN k % 4 = 0 THEN upper(path) ELSE path END AS path FROM paths), asked AS (SELECT k, translate(regexp_replace(path, '\\.[^./\\\\]*$', ''), '/\\ ', '___') AS id FROM w),
    known AS (SELECT translate(regexp_replace(path, '\\.[^./\\\\]*$', ''), '/\\ ', '___') AS id FROM paths WHERE k % 6 <> 1), folded AS (SELECT lower(id) AS low, min(id) AS id FROM known GROUP BY 1)
    SELECT k, coalesce(e.id, f.id) AS parent_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN f.id IS NOT NULL THEN 'case' ELSE 'unknown' END AS found FROM asked a LEFT JOIN (SELECT DISTINCT id FROM known) e ON e.id = a.id LEFT JOIN folded f ON f.low = lower(a.id)""",
)
def known_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as they were typed, to known parents: exactly, else whatever the case, else unknown."""
    asked = foreign_paths(spark, sf_dir).select("k", keys.parent_id(keys.anchored(F.when(c("k") % 4 == 0, F.concat(F.lit("/raw/"), F.upper(keys.anchored(c("path"), "raw")))).otherwise(c("path")), "raw")).alias("id"))
    known = paths(spark, sf_dir).filter("k % 6 <> 1").select(keys.parent_id(c("path")).alias("known")).distinct()
    folded = known.groupBy(F.lower("known").alias("low")).agg(F.min("known").alias("near"))
    met = asked.join(known, c("id") == c("known"), "left").join(folded, F.lower("id") == c("low"), "left")
    how = F.when(c("known").isNotNull(), "exact").when(c("near").isNotNull(), "case").otherwise("unknown")
    return met.select("k", F.coalesce("known", "near").alias("parent_id"), how.alias("found"))


@register("f10_safe_labels", "SELECT p_partkey, regexp_replace(p_name || ' (' || p_brand || ')', '[^A-Za-z0-9]+', '_', 'g') AS label FROM part")
def safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", keys.safe_label(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("label"))


HASHED = "h AS (SELECT c_custkey AS k, ('0x' || substring(sha256('42:' || c_name), 1, 15))::BIGINT AS r FROM customer)"


@register("f11_stable_units", f"WITH {HASHED} SELECT k, round(r / pow(16.0::DOUBLE, 15), 12) AS u FROM h")
def stable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), F.round(keys.stable_unit(F.concat(F.lit("42:"), "c_name")), 12).alias("u"))


@register("f12_stable_ranks", f"WITH {HASHED} SELECT k, r FROM h")
def stable_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), keys.stable_rank(F.concat(F.lit("42:"), "c_name")).alias("r"))


@register("f13_fingerprints", """SELECT c_custkey AS k, substring(sha256('{"a": ' || c_nationkey || ', "b": "' || c_name || '"}'), 1, 16) AS fingerprint FROM customer""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of settings as text with its keys in order."""
    t = table(spark, sf_dir, "customer")
    return t.select(c("c_custkey").alias("k"), keys.fingerprint(F.concat(F.lit('{"a": '), c("c_nationkey").cast("string"), F.lit(', "b": "'), "c_name", F.lit('"}'))).alias("fingerprint"))


# scales, rings, weights


@register("f15_ground_samples", f"WITH {PHOTOS} SELECT photo_idx, round(alt * sensor_mm / (focal_mm * width), 9) AS gsd FROM photos")
def ground_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).select("photo_idx", F.round(geodesy.ground_sample(c("alt"), c("sensor_mm"), c("focal_mm"), c("width")), 9).alias("gsd"))


@register(
    "f19_projected_footprints",
    f"""WITH {PHOTOS}, g AS (SELECT photo_idx, alt * sensor_mm / (focal_mm * width) AS gsd, radians(coalesce(yaw, 0)) AS turn FROM photos WHERE sensor_mm IS NOT NULL), k AS (SELECT unnest(range(0, 4)) AS corner),
    o AS (SELECT photo_idx, corner, turn, CASE WHEN corner IN (1, 2) THEN 2736 ELSE -2736 END * gsd AS r, CASE WHEN corner < 2 THEN 1824 ELSE -1824 END * gsd AS u FROM g CROSS JOIN k)
    SELECT photo_idx, corner::INTEGER AS corner, round(r * cos(turn) + u * sin(turn), 4) AS x, round(u * cos(turn) - r * sin(turn), 4) AS y FROM o""",
)
def projected_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of a photo on the ground, from its middle."""
    p = photos(spark, sf_dir).filter("sensor_mm is not null").withColumn("gsd", geodesy.ground_sample(c("alt"), c("sensor_mm"), c("focal_mm"), c("width"))).withColumn("yaw", F.coalesce("yaw", F.lit(0.0)))
    corners = F.array(*[F.struct(F.lit(x).alias("px"), F.lit(y).alias("py")) for x, y in ((0, 0), (5472, 0), (5472, 3648), (0, 3648))])
    each = p.select("*", F.posexplode(corners).alias("corner", "at"))
    x, y = geodesy.pixel_to_local(c("at.px"), c("at.py"), c("width"), c("height"), c("gsd"), c("yaw"), F.lit(0.0), F.lit(0.0))
    return each.select("photo_idx", "corner", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@register("f20_utm_zones", f"WITH {PHOTOS} SELECT photo_idx, trunc((lon + 180) / 6)::INTEGER + 1 + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS epsg FROM photos WHERE lon IS NOT NULL")
def utm_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).filter("lon is not null").select("photo_idx", geodesy.utm_epsg(c("lon"), c("lat")).alias("epsg"))


@register("f23_pixels_to_degrees", f"WITH {BOXES} SELECT det_id, round(46.4 + (x0 + x1) / 2 * 1.5e-6, 9) AS lon, round(-9.4 - (y0 + y1) / 2 * 1.25e-6, 9) AS lat FROM boxes")
def pixels_to_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middles of boxes by an affine transform of a geographic raster."""
    lon, lat = geodesy.affine((c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2, (46.4, 1.5e-6, 0.0, -9.4, 0.0, -1.25e-6))
    return boxes(spark, sf_dir).select("det_id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@register("f24_pixel_areas", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN round(abs((p_size * 0.001::DOUBLE) * (p_size * 0.001::DOUBLE) - 0.0001::DOUBLE * 0.0002::DOUBLE), 12) END AS area_m2 FROM part")
def pixel_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground of a pixel by its affine transform; unknown for a geographic system."""
    size = c("p_size") * 0.001
    return table(spark, sf_dir, "part").select("p_partkey", F.when(c("p_size") % 5 != 0, F.round(geodesy.pixel_area(size, F.lit(0.0001), F.lit(0.0002), size), 12)).alias("area_m2"))


@register("f33_normalised_boxes", f"WITH {BOXES} SELECT det_id, round(greatest(0, least(1, (x0 - 100) / 19000)), 9) AS u, round(greatest(0, least(1, (y1 - 50) / 1800)), 9) AS v FROM boxes")
def normalised_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return boxes(spark, sf_dir).select("det_id", F.round(unit((c("x0") - 100) / 19000), 9).alias("u"), F.round(unit((c("y1") - 50) / 1800), 9).alias("v"))


@register("f34_weight_ranges", f"WITH {WEIGHED} SELECT det_id, round(weight_low, 6) AS low, round(weight_mid, 6) AS mid, round(weight_high, 6) AS high FROM weighed")
def weight_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighed(spark, sf_dir).select("det_id", *[F.round(f"weight_{k}", 6).alias(k) for k in ("low", "mid", "high")])


@register("f35_weight_families", f"WITH {DETECTIONS}, {DENSITY_ROWS} SELECT class_name, coalesce(CASE WHEN max(high) > 5 THEN 'heavy' WHEN max(high) IS NOT NULL THEN 'light' END, 'unknown') AS family, count(*) AS n FROM detections LEFT JOIN densities USING (class_name) GROUP BY 1")
def weight_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.coalesce(F.when(F.max("high") > 5, "heavy").when(F.max("high").isNotNull(), "light"), F.lit("unknown"))
    return detections(spark, sf_dir).join(F.broadcast(densities(spark)), "class_name", "left").groupBy("class_name").agg(family.alias("family"), F.count("*").alias("n"))


@register(
    "f36_cosines",
    "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL",
)
def cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each embedding and the next one."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", c("embedding").cast("array<double>").alias("v"))
    pairs = e.join(e.select((c("vec_id") - 1).alias("vec_id"), c("v").alias("w")), "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("vec_id", F.round(dot("v", "w") / F.sqrt(dot("v", "v") * dot("w", "w")), 5).alias("cosine"))


@register("f37_variation", f"WITH {DETECTIONS} SELECT photo_idx, count(*) AS n, CASE WHEN count(*) < 2 OR avg(k) = 0 THEN 0 ELSE round(stddev_samp(k) / avg(k), 6) END::DOUBLE AS cv FROM detections GROUP BY 1")
def variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient of variation; 0 for fewer than two values or a mean of 0."""
    cv = F.when((F.count("*") < 2) | (F.avg("k") == 0), 0.0).otherwise(F.round(F.stddev_samp("k") / F.avg("k"), 6))
    return detections(spark, sf_dir).groupBy("photo_idx").agg(F.count("*").alias("n"), cv.alias("cv"))


@register("f38_f1", "SELECT c_custkey, round(2 * p * r / (p + r + 1e-9), 9) AS f1 FROM (SELECT c_custkey, (c_custkey % 11) / 10 AS p, (c_custkey % 7) / 6 AS r FROM customer)")
def f1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = c("c_custkey") % 11 / 10, c("c_custkey") % 7 / 6
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(2 * p * r / (p + r + 1e-9), 9).alias("f1"))


@register("f45_learning_rates", "SELECT p_type AS run, round(0.002 * 5 / (4 + count(DISTINCT p_brand)), 6) AS rate FROM part GROUP BY 1")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of a run by its number of classes."""
    return table(spark, sf_dir, "part").groupBy(c("p_type").alias("run")).agg(F.round(0.002 * 5 / (4 + F.countDistinct("p_brand")), 6).alias("rate"))
