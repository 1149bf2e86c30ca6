"""Reviews, surveys over several photos and models, and smaller audits (rest of J*, A*, G*, M*, U*, O* of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.geodesy import from_dms, to_local
from tidemark.operators.cluster import connected_components
from tidemark.operators.spatial_join import iou, meeting_pairs, overlap, self_pairs
from tidemark.operators.running import in_parts, ranked, running
from tidemark.plans.registry import register, table
from tidemark.plans.spatial import CELL, INTER, IOU, MEET, OWNED, FOOTPRINTS, footprints, owned_cells
from tidemark.plans.surveys import BOXES, DETECTIONS, PARENTS, boxes, detections, parents
from tidemark.scratch import Scratch


@register(
    "j12_owned_windows",
    f"WITH {OWNED}, w AS (SELECT DISTINCT (x.unnest * 384)::BIGINT AS x0, (y.unnest * 384)::BIGINT AS y0 FROM f, unnest(range(floor((f.x0 - 660) / 384)::BIGINT, floor((f.x1 + 20) / 384)::BIGINT + 1)) x, unnest(range(floor((f.y0 - 660) / 384)::BIGINT, floor((f.y1 + 20) / 384)::BIGINT + 1)) y) SELECT x0, y0 FROM w WHERE EXISTS (SELECT 1 FROM owned WHERE gx * 100 + 50 BETWEEN x0 - 20 AND x0 + 660 AND gy * 100 + 50 BETWEEN y0 - 20 AND y0 + 660)",
)
def owned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join: windows with an owned cell inside, 20 m of margin counted."""
    cells = owned_cells(spark, sf_dir).select((F.col("gx") * 100.0 + 50).alias("x0"), (F.col("gy") * 100.0 + 50).alias("y0")).selectExpr("x0", "y0", "x0 AS x1", "y0 AS y1")
    near = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) - 660) / 384), F.floor((F.col(high) + 20) / 384)))
    around = footprints(spark, sf_dir).withColumn("tx", near("x0", "x1")).withColumn("ty", near("y0", "y1"))
    grid = around.select((F.col("tx") * 384.0).alias("x0"), (F.col("ty") * 384.0).alias("y0")).distinct()
    tiles = grid.select("x0", "y0", (F.col("x0") + 640).alias("x1"), (F.col("y0") + 640).alias("y1"))
    return meeting_pairs(tiles, cells, 512.0, distance=20.0).select(F.col("a_x0").cast("long").alias("x0"), F.col("a_y0").cast("long").alias("y0")).distinct()


@register(
    "j16_cell_overlap_pairs",
    f"""WITH {BOXES}, {FOOTPRINTS}, c AS (SELECT id, gx.unnest AS gx, gy.unnest AS gy FROM f, unnest(range(floor(x0 / 50)::BIGINT, floor(x1 / 50)::BIGINT + 1)) gx, unnest(range(floor(y0 / 50)::BIGINT, floor(y1 / 50)::BIGINT + 1)) gy),
    n AS (SELECT id, count(*) AS n FROM c GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM c a JOIN c b ON a.gx = b.gx AND a.gy = b.gy AND a.id < b.id GROUP BY 1, 2)
    SELECT a, b, common, round(common / least(x.n, y.n), 6) AS share FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE common / least(x.n, y.n) >= 0.3""",
)
def cell_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the rasterised overlap that they have of the smaller: common cells, counted."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 50), F.floor(F.col(b) / 50)))
    c = footprints(spark, sf_dir).withColumn("gx", cells("x0", "x1")).withColumn("gy", cells("y0", "y1")).select("id", "gx", "gy")
    n = c.groupBy("id").agg(F.count("*").alias("n"))
    p = c.withColumnRenamed("id", "a").join(c.withColumnRenamed("id", "b"), ["gx", "gy"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    p = p.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").withColumn("share", F.col("common") / F.least("na", "nb"))
    return p.filter("share >= 0.3").select("a", "b", "common", F.round("share", 6).alias("share"))


@register(
    "j15_touching_groups",
    f"""WITH RECURSIVE {BOXES}, {FOOTPRINTS}, near AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.id <> b.id AND a.id // 100 = b.id // 100 AND a.x0 - 5 <= b.x0 + 150 AND b.x0 <= a.x0 + 155 AND a.y0 - 5 <= b.y0 + 130 AND b.y0 <= a.y0 + 135),
    reach(node, other) AS (SELECT a, a FROM near UNION SELECT r.node, n.b FROM reach r JOIN near n ON n.a = r.other) SELECT node AS id, min(other) AS label FROM reach GROUP BY node""",
)
def touching_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range self-join within a site, 5 m apart at most, and the groups that result."""
    scratch = Scratch(spark, "touching")
    small = footprints(spark, sf_dir).select("id", F.floor(F.col("id") / 100).alias("site"), "x0", "y0", (F.col("x0") + 150).alias("x1"), (F.col("y0") + 130).alias("y1"))
    near = self_pairs(small, CELL, ("site",), "id", distance=5.0).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return connected_components(scratch.keep(near), scratch).select(F.col("node").alias("id"), "label")


@register(
    "c5_overlap_or_similarity",
    """WITH RECURSIVE e AS (SELECT vec_id, label, embedding, (vec_id * 7 % 40)::DOUBLE AS x, (vec_id * 11 % 40)::DOUBLE AS y FROM embeddings),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND abs(a.x - b.x) <= 8 AND abs(a.y - b.y) <= 8
        WHERE (abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1) OR (pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 64 AND round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) >= 0.25)),
    reach(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.other) SELECT node AS vec_id, min(other) AS label FROM reach GROUP BY node""",
)
def overlap_or_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by overlap, or by nearness and similar embeddings; without an embedding overlap alone counts."""
    scratch = Scratch(spark, "visual")
    at = lambda k: (F.col("vec_id") * k % 40).cast("double")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), at(7).alias("x0"), at(11).alias("y0"), at(7).alias("x1"), at(11).alias("y1"))
    near = self_pairs(e, 8.0, ("label",), "vec_id", distance=8.0)
    dx, dy = F.abs(F.col("a_x0") - F.col("b_x0")), F.abs(F.col("a_y0") - F.col("b_y0"))
    dot = F.aggregate(F.zip_with("a_v", "b_v", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    links = near.filter(((dx <= 1) & (dy <= 1)) | ((dx * dx + dy * dy <= 64) & (F.round(dot, 6) >= 0.25))).select(F.col("a_vec_id").alias("a"), F.col("b_vec_id").alias("b"))
    return connected_components(scratch.keep(links), scratch).select(F.col("node").alias("vec_id"), "label")


@register(
    "c9_available_views",
    f"""WITH {BOXES}, {FOOTPRINTS} SELECT det_id, count(id) AS views FROM boxes b LEFT JOIN f a ON (b.x0 + b.x1) / 2 BETWEEN a.x0 + 40 AND a.x1 - 40 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 + 40 AND a.y1 - 40 GROUP BY det_id""",
)
def available_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many photos could see a point, 40 pixels inside their border."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    points = boxes(spark, sf_dir).select("det_id", x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))
    inner = footprints(spark, sf_dir).selectExpr("id", "x0 + 40 AS x0", "y0 + 40 AS y0", "x1 - 40 AS x1", "y1 - 40 AS y1")
    seen = meeting_pairs(inner, points, 256.0).groupBy(F.col("b_det_id").alias("det_id")).agg(F.count("*").alias("views"))
    return points.select("det_id").join(seen, "det_id", "left").fillna(0)


@register(
    "j29_seen_by_no_model",
    f"WITH {BOXES}, hit AS (SELECT DISTINCT a.det_id FROM cells a JOIN cells b ON a.cx = b.cx AND a.cy = b.cy AND a.det_id % 2 = 0 AND b.det_id % 2 = 1 AND {MEET} WHERE {IOU} >= 0.3) SELECT class_name, count(*) AS missed FROM boxes WHERE det_id % 2 = 0 AND det_id NOT IN (FROM hit) GROUP BY 1",
)
def seen_by_no_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes(spark, sf_dir)
    truth = found.filter("det_id % 2 = 0")
    hit = meeting_pairs(truth, found.filter("det_id % 2 = 1"), CELL).filter(iou() >= 0.3).select(F.col("a_det_id").alias("det_id")).distinct()
    return truth.join(hit, "det_id", "left_anti").groupBy("class_name").agg(F.count("*").alias("missed"))


@register(
    "p13_outside_ignore_zones",
    f"WITH {BOXES}, {FOOTPRINTS}, z AS (SELECT * FROM f WHERE id % 7 = 0) SELECT class_name, count(*) AS n FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM z a WHERE {MEET} AND {INTER} >= 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0)) GROUP BY 1",
)
def outside_ignore_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial anti join: predictions of which less than half lies in an ignored zone."""
    found = boxes(spark, sf_dir)
    size = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    inside = meeting_pairs(footprints(spark, sf_dir).filter("id % 7 = 0"), found, 256.0).filter(overlap() >= 0.5 * size).select(F.col("b_det_id").alias("det_id")).distinct()
    return found.join(inside, "det_id", "left_anti").groupBy("class_name").agg(F.count("*").alias("n"))


@register(
    "p5_border_views",
    f"WITH {BOXES} SELECT class_name, count(*) FILTER (x0 % 500 <= 3 OR y0 % 500 <= 3 OR x1 % 500 >= 497 OR y1 % 500 >= 497) AS near_border, count(*) FILTER (x0 % 500 <= 2 OR x1 % 500 >= 497) AS flagged, count(*) AS n FROM boxes GROUP BY 1",
)
def border_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two border rules that differ in their margins."""
    c = F.col
    near = (c("x0") % 500 <= 3) | (c("y0") % 500 <= 3) | (c("x1") % 500 >= 497) | (c("y1") % 500 >= 497)
    return boxes(spark, sf_dir).groupBy("class_name").agg(F.count_if(near).alias("near_border"), F.count_if((c("x0") % 500 <= 2) | (c("x1") % 500 >= 497)).alias("flagged"), F.count("*").alias("n"))


@register(
    "a38_triage_buckets",
    f"""WITH {BOXES}, m AS (SELECT a.det_id, max({IOU}) AS best FROM cells a JOIN cells b ON a.cx = b.cx AND a.cy = b.cy AND a.class_name = b.class_name AND a.det_id % 2 = 1 AND b.det_id % 2 = 0 AND {MEET} GROUP BY 1)
    SELECT CASE WHEN best IS NULL OR round(best, 9) < 0.1 THEN CASE WHEN confidence >= 0.6 THEN 'missing' ELSE 'weak' END WHEN round(best, 9) < 0.5 THEN 'mask' ELSE 'fine' END AS bucket, count(*) AS n FROM boxes LEFT JOIN m USING (det_id) WHERE det_id % 2 = 1 GROUP BY 1""",
)
def triage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions without truth (confident: probably missing), with a poor mask, or fine."""
    found = boxes(spark, sf_dir)
    guess = found.filter("det_id % 2 = 1")
    best = meeting_pairs(guess, found.filter("det_id % 2 = 0"), CELL, ("class_name",)).groupBy(F.col("a_det_id").alias("det_id")).agg(F.round(F.max(iou()), 9).alias("best"))
    bucket = F.when(F.coalesce("best", F.lit(0.0)) < 0.1, F.when(F.col("confidence") >= 0.6, "missing").otherwise("weak")).when(F.col("best") < 0.5, "mask").otherwise("fine")
    return guess.join(best, "det_id", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@register(
    "a21_tile_origins",
    f"WITH {PARENTS}, t AS (SELECT parent_id, count(*) AS tiles, count(*) FILTER (l_returnflag = 'R') AS empty FROM parents JOIN lineitem ON l_orderkey = parent_id GROUP BY 1) SELECT CASE WHEN empty = tiles THEN 'background' WHEN empty > 0 THEN 'partly empty' ELSE 'objects' END AS origin, count(*) AS parents, sum(tiles)::BIGINT AS tiles FROM t GROUP BY 1",
)
def tile_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = parents(spark, sf_dir).select("parent_id").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_id"), "l_returnflag"), "parent_id")
    t = t.groupBy("parent_id").agg(F.count("*").alias("tiles"), F.count_if(F.col("l_returnflag") == "R").alias("empty"))
    origin = F.when(F.col("empty") == F.col("tiles"), "background").when(F.col("empty") > 0, "partly empty").otherwise("objects")
    return t.groupBy(origin.alias("origin")).agg(F.count("*").alias("parents"), F.sum("tiles").alias("tiles"))


@register(
    "a43_transect_pivot",
    f"WITH {DETECTIONS} SELECT photo_idx, count(*) FILTER (class_name = 'click') AS click, count(*) FILTER (class_name = 'error') AS error, count(*) FILTER (class_name = 'purchase') AS purchase, count(*) FILTER (class_name = 'signup') AS signup, count(*) FILTER (class_name = 'view') AS view FROM detections GROUP BY 1",
)
def transect_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("photo_idx").pivot("class_name", ["click", "error", "purchase", "signup", "view"]).count().fillna(0)


@register(
    "m1_placeholder_ids",
    "WITH p AS (SELECT p_brand AS batch, p_partkey AS local_id, p_type AS target FROM part) SELECT batch, target, min(local_id) AS placeholder, count(*) AS spellings FROM p GROUP BY 1, 2",
)
def placeholder_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("batch"), F.col("p_type").alias("target")).agg(F.min("p_partkey").alias("placeholder"), F.count("*").alias("spellings"))


@register(
    "m5_resolve_or_allocate",
    "WITH known AS (SELECT p_brand AS batch, p_type AS name, min(p_partkey) AS id FROM part WHERE p_size < 10 GROUP BY ALL), wanted AS (SELECT DISTINCT p_brand AS batch, p_type AS name FROM part), top AS (SELECT batch, max(id) AS top FROM known GROUP BY 1) SELECT w.batch, w.name, coalesce(id, coalesce(top, -1) + row_number() OVER (PARTITION BY w.batch, id IS NULL ORDER BY w.name)) AS id, id IS NULL AS fresh FROM wanted w LEFT JOIN known USING (batch, name) LEFT JOIN top ON top.batch = w.batch",
)
def resolve_or_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names keep their local id; unknown ones get the next free ones of their batch."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("batch"), F.col("p_type").alias("name"), "p_partkey", "p_size")
    known = p.filter("p_size < 10").groupBy("batch", "name").agg(F.min("p_partkey").alias("id"))
    top = known.groupBy("batch").agg(F.max("id").alias("top"))
    j = p.select("batch", "name").distinct().join(known, ["batch", "name"], "left").join(top, "batch", "left").withColumn("fresh", F.col("id").isNull())
    turn = F.row_number().over(Window.partitionBy("batch", "fresh").orderBy("name"))
    return j.select("batch", "name", F.coalesce("id", F.coalesce("top", F.lit(-1)) + turn).alias("id"), "fresh")


@register(
    "m7_subset_composition",
    f"WITH {DETECTIONS}, classes AS (SELECT DISTINCT class_name FROM detections), s AS (SELECT class_name, count(*) AS n FROM detections WHERE photo_idx % 50 = 3 AND confidence > 0.3 GROUP BY 1) SELECT class_name, coalesce(n, 0) AS n, coalesce(n, 0) < 5 AS low_sample FROM classes LEFT JOIN s USING (class_name)",
)
def subset_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared class, rows of 0 kept, with a mark on small samples."""
    d = detections(spark, sf_dir)
    s = d.filter("photo_idx % 50 = 3 and confidence > 0.3").groupBy("class_name").agg(F.count("*").alias("n"))
    return d.select("class_name").distinct().join(s, "class_name", "left").fillna(0).withColumn("low_sample", F.col("n") < 5)


@register(
    "m18_already_present",
    "WITH done AS (SELECT DISTINCT 'id_' || (doc_id % 400) AS parent FROM documents WHERE doc_id % 3 = 0) SELECT doc_id FROM documents WHERE 'id_' || (doc_id % 400) NOT IN (FROM done)",
)
def already_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("id_"), (F.col("doc_id") % 400).cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", name.alias("parent"))
    return d.join(d.filter("doc_id % 3 = 0").select("parent").distinct(), "parent", "left_anti").select("doc_id")


@register(
    "m28_unlabelled_positives",
    f"WITH {BOXES}, hit AS (SELECT DISTINCT a.det_id FROM cells a JOIN cells b ON a.cx = b.cx AND a.cy = b.cy AND a.det_id % 2 = 1 AND b.det_id % 2 = 0 AND {MEET} WHERE {IOU} > 0.1) SELECT det_id, class_name FROM boxes WHERE det_id % 2 = 1 AND confidence >= 0.8 AND det_id NOT IN (FROM hit)",
)
def unlabelled_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident predictions that overlap no truth of any class."""
    found = boxes(spark, sf_dir)
    guess = found.filter("det_id % 2 = 1 and confidence >= 0.8")
    hit = meeting_pairs(guess, found.filter("det_id % 2 = 0"), CELL).filter(iou() > 0.1).select(F.col("a_det_id").alias("det_id")).distinct()
    return guess.join(hit, "det_id", "left_anti").select("det_id", "class_name")


@register(
    "o2_review_order",
    f"WITH {DETECTIONS} SELECT det_id, class_name, row_number() OVER (PARTITION BY class_name ORDER BY k % 4 DESC, confidence DESC, coalesce(area_m2, 0) DESC, det_id) AS turn FROM detections WHERE confidence >= 0.5",
)
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each kind: most models first, then confidence, then size."""
    order = [(F.col("k") % 4).desc(), F.desc("confidence"), F.coalesce("area_m2", F.lit(0.0)).desc(), F.asc("det_id")]
    rows = detections(spark, sf_dir).filter("confidence >= 0.5").select("det_id", "class_name", "k", "confidence", "area_m2")
    return ranked(rows, ["class_name"], order, Scratch(spark, "order")).select("det_id", "class_name", F.col("rn").alias("turn"))


@register(
    "g7_background_cap",
    "WITH t AS (SELECT o_orderkey, o_orderstatus AS split, o_orderpriority = '5-LOW' AS empty FROM orders), c AS (SELECT split, count(*) FILTER (NOT empty) AS fg FROM t GROUP BY 1), r AS (SELECT o_orderkey, split, row_number() OVER (PARTITION BY split ORDER BY sha256('cap:' || o_orderkey), o_orderkey) AS rn FROM t WHERE empty) SELECT o_orderkey, split FROM r JOIN c USING (split) WHERE rn <= floor(fg * 10 / 90.0::DOUBLE)",
)
def background_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: empty tiles by hash order, up to a tenth of each split."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split"), (F.col("o_orderpriority") == "5-LOW").alias("empty"))
    c = t.groupBy("split").agg(F.count_if(~F.col("empty")).alias("fg"))
    lot = F.sha2(F.concat(F.lit("cap:"), F.col("o_orderkey").cast("string")).cast("binary"), 256)
    order = [F.asc("lot"), F.asc("o_orderkey")]
    parts = in_parts(t.filter("empty").withColumn("lot", lot), ["split"], order, Scratch(spark, "background"))
    ranked = running(parts, ["split"], order, {})
    return ranked.join(c, "split").filter(F.col("rn") <= F.floor(F.col("fg") * 10 / 90)).select("o_orderkey", "split")


@register(
    "u2_distinct_windows",
    "WITH w AS (SELECT p_size % 9 * 100 AS x0, p_size % 5 * 100 AS y0, p_partkey FROM part) SELECT x0, y0, min(p_partkey) AS first, count(*) AS times FROM w GROUP BY 1, 2",
)
def distinct_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows once, by first appearance."""
    return table(spark, sf_dir, "part").groupBy((F.col("p_size") % 9 * 100).alias("x0"), (F.col("p_size") % 5 * 100).alias("y0")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("times"))


@register(
    "f14_degrees_minutes_seconds",
    "SELECT c_custkey, round(((c_custkey % 90) + (c_custkey % 60) / 60 + (c_custkey % 37) / 3600) * CASE WHEN c_nationkey % 2 = 0 THEN -1 ELSE 1 END, 7) + 0.0::DOUBLE AS lat FROM customer",
)
def decimal_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    south = F.when(F.col("c_nationkey") % 2 == 0, "S").otherwise("N")
    return table(spark, sf_dir, "customer").select("c_custkey", (F.round(from_dms(k % 90, k % 60, k % 37, south), 7) + 0.0).alias("lat"))


@register(
    "f16_local_metres",
    "SELECT c_custkey, round((c_custkey % 100) / 1000 * 111320 * cos(radians(-9.4::DOUBLE)), 4) AS x, round((c_custkey % 77) / 1000 * 110540, 4) AS y FROM customer",
)
def local_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = to_local(46.4 + k % 100 / 1000, -9.4 + k % 77 / 1000, F.lit(46.4), F.lit(-9.4))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))
