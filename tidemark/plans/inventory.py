"""Smaller operators of the inventory: predicates, keys, lookups, run records, edits (P*, S*, K*, F*, G*, M*, U*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.spatial_join import iou, overlap, self_pairs
from tidemark.operators.freeze import freeze_bench, freeze_stratified
from tidemark.operators.order_stats import quantiles, with_quantiles
from tidemark.operators.validation import validate_labels
from tidemark.plans.evaluation import EVAL, predictions
from tidemark.plans.registry import register, table
from tidemark.plans.spatial import CELL, CELL_OF_BOX, PAIRS
from tidemark.plans.surveys import BOXES, DETECTIONS, PARENTS, PHOTOS, boxes, detections, parents, photos
from tidemark.scratch import Scratch


@register(
    "j22_duplicate_annotations",
    f"WITH {BOXES}, {PAIRS} SELECT a_photo AS photo_idx, class_name, count(*) AS pairs, round(max(iou), 6) AS worst FROM pairs WHERE a_photo = b_photo AND iou >= 0.2 GROUP BY 1, 2",
)
def duplicate_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within one image and class that overlap too much."""
    p = self_pairs(boxes(spark, sf_dir), CELL, ("photo_idx", "class_name"), "det_id").withColumn("iou", iou()).filter("iou >= 0.2")
    return p.groupBy(F.col("a_photo_idx").alias("photo_idx"), F.col("a_class_name").alias("class_name")).agg(F.count("*").alias("pairs"), F.round(F.max("iou"), 6).alias("worst"))


@register(
    "j7_same_object_pairs",
    f"WITH {BOXES}, {PAIRS} SELECT a, b FROM pairs JOIN boxes x ON x.det_id = a JOIN boxes y ON y.det_id = b WHERE a_photo <> b_photo AND (iou >= 0.25 OR inter / least((x.x1 - x.x0) * (x.y1 - x.y0), (y.x1 - y.x0) * (y.y1 - y.y0)) >= 0.6)",
)
def same_object_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of different photos that may be one object: overlap, or most of the smaller covered."""
    p = self_pairs(boxes(spark, sf_dir), CELL_OF_BOX, ("class_name",), "det_id").filter("a_photo_idx <> b_photo_idx")
    size = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    return p.filter((iou() >= 0.25) | (overlap() / F.least(size("a"), size("b")) >= 0.6)).select(F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"))


@register(
    "j20_tiles_of_parent",
    "SELECT o_orderkey AS parent_id, count(l_linenumber) AS tiles, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS listed FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1",
)
def tiles_of_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents without tiles keep an empty list."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_id"), "l_linenumber").distinct()
    t = t.groupBy("parent_id").agg(F.count("*").alias("tiles"), F.array_join(F.sort_array(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("listed"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent_id")).join(t, "parent_id", "left").fillna({"tiles": 0, "listed": ""})


@register(
    "a1_best_in_photo",
    f"WITH {BOXES} SELECT photo_idx, class_name, max_by(det_id, [confidence, -det_id]) AS best, max_by(det_id, [round(confidence - CASE WHEN x0 % 500 <= 2 THEN 0.3 ELSE 0 END, 6), -det_id]) AS representative FROM boxes GROUP BY 1, 2",
)
def best_in_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best detection of a photo and class, and the one that represents it (a border costs 0.3)."""
    shown = F.round(F.col("confidence") - F.when(F.col("x0") % 500 <= 2, 0.3).otherwise(0.0), 6)
    return boxes(spark, sf_dir).groupBy("photo_idx", "class_name").agg(F.max_by("det_id", F.struct("confidence", -F.col("det_id"))).alias("best"), F.max_by("det_id", F.struct(shown, -F.col("det_id"))).alias("representative"))


@register("a14_canonical_classes", "SELECT lower(trim(regexp_replace(p_name, '[_ ]+', ' ', 'g'))) AS name_key, count(*) AS n, count(DISTINCT p_brand) AS batches, min(p_partkey) AS first FROM part GROUP BY 1")
def canonical_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lower(F.trim(F.regexp_replace("p_name", "[_ ]+", " ")))
    return table(spark, sf_dir, "part").groupBy(key.alias("name_key")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("batches"), F.min("p_partkey").alias("first"))


@register(
    "a15_splits_in_order",
    f"WITH {PARENTS}, s AS (SELECT CASE WHEN parent_id % 10 < 7 THEN 'train' WHEN parent_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, weight FROM parents) SELECT split, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS turn, count(*) AS images, round(avg(weight), 4) AS mean_weight FROM s GROUP BY split",
)
def splits_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("parent_id") % 10
    s = parents(spark, sf_dir).groupBy(F.when(p < 7, "train").when(p < 9, "val").otherwise("test").alias("split")).agg(F.count("*").alias("images"), F.round(F.avg("weight"), 4).alias("mean_weight"))
    place = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return s.select("split", F.row_number().over(Window.orderBy(place)).alias("turn"), "images", "mean_weight")


@register(
    "a18_batch_audit",
    "WITH c AS (SELECT o_orderstatus AS batch, o_orderkey, count(l_orderkey) AS objects FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT batch, count(*) AS images, count(*) FILTER (objects > 0) AS with_objects, count(*) FILTER (objects = 0) AS background, sum(objects)::BIGINT AS objects FROM c GROUP BY 1",
)
def batch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("objects"))
    c = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("batch"), "o_orderkey").join(per, "o_orderkey", "left").fillna(0)
    return c.groupBy("batch").agg(F.count("*").alias("images"), F.count_if(F.col("objects") > 0).alias("with_objects"), F.count_if(F.col("objects") == 0).alias("background"), F.sum("objects").alias("objects"))


@register("a29_false_by_zone", f"WITH {EVAL} SELECT class_name, CASE WHEN parent_id % 3 = 0 THEN 'nodata' WHEN parent_id % 3 = 1 THEN 'ignore' ELSE 'free' END AS zone, count(*) AS n FROM preds WHERE tp = 0 AND confidence >= 0.25 GROUP BY 1, 2")
def false_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("parent_id") % 3
    return predictions(spark, sf_dir).filter("tp = 0 and confidence >= 0.25").groupBy("class_name", F.when(p == 0, "nodata").when(p == 1, "ignore").otherwise("free").alias("zone")).agg(F.count("*").alias("n"))


@register(
    "a41_archive_statistics",
    f"WITH {DETECTIONS}, g AS (SELECT class_name, count(*) AS n, sum(coalesce(area_m2, 0)) AS area, median(area_m2) AS mid, avg(area_m2) AS mean FROM detections GROUP BY 1) SELECT class_name, n, round(area, 4) AS area, round(mid, 5) AS median, round(mean, 5) AS mean, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS percent_n, round(100 * area / sum(area) OVER (), 4) AS percent_area FROM g",
)
def archive_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections(spark, sf_dir)
    g = rows.groupBy("class_name").agg(F.count("*").alias("n"), F.sum(F.coalesce("area_m2", F.lit(0.0))).alias("a"), F.avg("area_m2").alias("m"))
    g = with_quantiles(g, rows, ["class_name"], {"mid": ("area_m2", 0.5)}, Scratch(spark, "medians"))
    all_ = Window.partitionBy()
    return g.select("class_name", "n", F.round("a", 4).alias("area"), F.round("mid", 5).alias("median"), F.round("m", 5).alias("mean"), F.round(100.0 * F.col("n") / F.sum("n").over(all_), 4).alias("percent_n"), F.round(100 * F.col("a") / F.sum("a").over(all_), 4).alias("percent_area"))


@register(
    "k7_wide_runs",
    "SELECT o_custkey AS run, count(*) FILTER (o_orderstatus = 'F') AS F_n, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F_total, count(*) FILTER (o_orderstatus = 'O') AS O_n, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O_total FROM orders GROUP BY 1",
)
def wide_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run, columns for each class."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "run")
    return o.groupBy("run").pivot("o_orderstatus", ["F", "O"]).agg(F.count("o_orderkey").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).fillna(0, ["F_n", "O_n"])


@register(
    "k12_pending_edits",
    f"WITH {DETECTIONS}, d AS (SELECT photo_idx, k, max_by(class_name, det_id) AS decision, max(det_id) AS seq FROM detections GROUP BY 1, 2), applied AS (SELECT DISTINCT photo_idx, k FROM detections WHERE det_id % 5 = 0) SELECT photo_idx, k, decision, seq FROM d WHERE NOT EXISTS (SELECT 1 FROM applied a WHERE a.photo_idx = d.photo_idx AND a.k = d.k)",
)
def pending_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last decision of each item, without those already applied: applying twice changes nothing."""
    d = detections(spark, sf_dir)
    last = d.groupBy("photo_idx", "k").agg(F.max_by("class_name", "det_id").alias("decision"), F.max("det_id").alias("seq"))
    return last.join(d.filter("det_id % 5 = 0").select("photo_idx", "k").distinct(), ["photo_idx", "k"], "left_anti")


@register(
    "g9_yaw_bias",
    "WITH a AS (SELECT c_nationkey AS site, (c_custkey * 37 % 360) - (c_custkey * 31 % 360) AS d FROM customer), w AS (SELECT site, ((d + 180) % 360 + 360) % 360 - 180 AS d FROM a) SELECT site, count(*) AS pairs, median(d)::DOUBLE AS bias FROM w GROUP BY 1 HAVING count(*) >= 10",
)
def yaw_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of wrapped angle differences, where there are at least ten."""
    k = F.col("c_custkey")
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), (F.pmod((k * 37 % 360) - (k * 31 % 360) + 180, F.lit(360)) - 180).alias("d"))
    by = a.groupBy("site").agg(F.count("*").alias("pairs")).filter("pairs >= 10")
    return with_quantiles(by, a, ["site"], {"bias": ("d", 0.5)}, Scratch(spark, "medians"))


@register(
    "m31_pair_residuals",
    "WITH p AS (SELECT l_suppkey AS pair, l_extendedprice / 1000 AS r FROM lineitem), m AS (SELECT pair, count(*) AS n, median(r) AS mid, quantile_cont(r, 0.9) AS p90, max(r) AS top FROM p GROUP BY 1) SELECT pair, n, round(mid, 3) AS median, round(p90, 3) AS p90, round(top, 3) AS top, mid > 3 * median(mid) OVER () AS rejected FROM m",
)
def pair_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals by pair; a pair far beyond the typical one is rejected."""
    scratch = Scratch(spark, "medians")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pair"), (F.col("l_extendedprice") / 1000).alias("r"))
    m = rows.groupBy("pair").agg(F.count("*").alias("n"), F.max("r").alias("t"))
    m = scratch.keep(with_quantiles(m, rows, ["pair"], {"mid": ("r", 0.5), "p": ("r", 0.9)}, scratch))
    typical = quantiles(m, [], {"typical": ("mid", 0.5)}, scratch)  # one row
    return m.join(F.broadcast(typical)).select("pair", "n", F.round("mid", 3).alias("median"), F.round("p", 3).alias("p90"), F.round("t", 3).alias("top"), (F.col("mid") > 3 * F.col("typical")).alias("rejected"))


@register("m15_latest_result", "SELECT o_custkey AS run, arg_max(o_orderkey, [CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END, epoch(o_orderdate)::BIGINT, o_orderkey]) AS result FROM orders GROUP BY 1")
def latest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred kind first, then the newest."""
    prefer = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.max_by("o_orderkey", F.struct(prefer, "o_orderdate", "o_orderkey")).alias("result"))


@register(
    "m4_taxonomy_differences",
    "WITH a AS (SELECT p_type AS name, min(p_size) AS target FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT p_type AS name, min(p_size) AS target FROM part WHERE p_partkey % 3 = 0 AND p_type <> 'ECONOMY' GROUP BY 1) SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'only second' WHEN b.name IS NULL THEN 'only first' WHEN a.target <> b.target THEN 'differs' ELSE 'same' END AS state FROM a FULL JOIN b ON a.name = b.name",
)
def taxonomy_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    side = lambda rows, c: rows.groupBy(F.col("p_type").alias("name")).agg(F.min("p_size").alias(c))
    both = side(p.filter("p_partkey % 2 = 0"), "a").join(side(p.filter("p_partkey % 3 = 0 and p_type <> 'ECONOMY'"), "b"), "name", "full_outer")
    state = F.when(F.col("a").isNull(), "only second").when(F.col("b").isNull(), "only first").when(F.col("a") != F.col("b"), "differs").otherwise("same")
    return both.select("name", state.alias("state"))


@register(
    "p11_unseen_parents",
    f"WITH {PARENTS}, seen AS (SELECT parent_id FROM parents WHERE parent_id % 4 = 0 UNION SELECT parent_id + 1 FROM parents WHERE parent_id % 12 = 0) SELECT site, count(*) AS n FROM parents WHERE parent_id NOT IN (FROM seen) GROUP BY 1",
)
def unseen_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images a run has not seen, ids that were renamed counted as seen."""
    p = parents(spark, sf_dir)
    seen = p.filter("parent_id % 4 = 0").select("parent_id").union(p.filter("parent_id % 12 = 0").select(F.col("parent_id") + 1)).distinct()
    return p.join(seen, "parent_id", "left_anti").groupBy("site").agg(F.count("*").alias("n"))


@register(
    "p10_site_filters",
    f"WITH {PARENTS} SELECT batch, count(*) AS n, count(*) FILTER (site = 'DE') AS exact, count(*) FILTER (contains(lower(batch), 'src1')) AS by_part FROM parents GROUP BY 1 HAVING contains(lower(batch), 'e')",
)
def site_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact site codes against substrings, which match too much."""
    p = parents(spark, sf_dir).filter(F.contains(F.lower("batch"), F.lit("e")))
    return p.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("site") == "DE").alias("exact"), F.count_if(F.contains(F.lower("batch"), F.lit("src1"))).alias("by_part"))


@register(
    "s22_sensor_lookup",
    f"WITH {PHOTOS}, sensors(site, label) AS (VALUES ('S1', 'one'), ('S2', 'two'), ('S3', 'three')) SELECT photo_idx, coalesce(label, 'unknown ' || site) AS sensor FROM photos LEFT JOIN sensors USING (site)",
)
def sensor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensors = spark.sql("SELECT * FROM VALUES ('S1', 'one'), ('S2', 'two'), ('S3', 'three') AS s(site, label)")
    return photos(spark, sf_dir).join(F.broadcast(sensors), "site", "left").select("photo_idx", F.coalesce("label", F.concat(F.lit("unknown "), "site")).alias("sensor"))


@register(
    "f41_bounds",
    f"WITH {PHOTOS}, b AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM photos), m AS (SELECT *, greatest(e - w, 0.001) * 0.15 AS dx, greatest(n - s, 0.001) * 0.15 AS dy FROM b) SELECT round(w - dx, 6) AS west, round(e + dx, 6) AS east, round(s - dy, 6) AS south, round(n + dy, 6) AS north FROM m",
)
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds with a margin of 15 %."""
    c = F.col
    b = photos(spark, sf_dir).agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    dx, dy = (F.greatest(c(hi) - c(lo), F.lit(0.001)) * 0.15 for lo, hi in (("w", "e"), ("s", "n")))
    return b.select(F.round(c("w") - dx, 6).alias("west"), F.round(c("e") + dx, 6).alias("east"), F.round(c("s") - dy, 6).alias("south"), F.round(c("n") + dy, 6).alias("north"))


@register(
    "f43_formatting",
    f"WITH {DETECTIONS} SELECT photo_idx, coalesce(printf('%.1f %%', floor(1000 * avg(area_m2) + 1e-6) / 10), 'NA') AS share, strftime(min(ts), '%Y-%m-%d %H:%M') AS taken, round(0.002 * 5 / (4 + count(DISTINCT class_name)), 6) AS rate FROM detections GROUP BY 1",
)
def formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).groupBy("photo_idx").agg(F.avg("area_m2").alias("a"), F.min("ts").alias("t"), F.countDistinct("class_name").alias("nc"))
    share = F.when(F.col("a").isNotNull(), F.format_string("%.1f %%", F.floor(1000 * F.col("a") + 1e-6) / 10)).otherwise("NA")
    return d.select("photo_idx", share.alias("share"), F.date_format("t", "yyyy-MM-dd HH:mm").alias("taken"), F.round(0.002 * 5 / (4 + F.col("nc")), 6).alias("rate"))


@register("f47_json_with_default", "SELECT event_id, coalesce(nullif(regexp_extract(props, '\"k\": ([0-9]+)', 1), '')::INTEGER, -1) AS k, 'none' AS missing FROM events")
def json_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(read, F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("none")).alias("missing"))


@register("u7_names_in_order", f"WITH {DETECTIONS}, f AS (SELECT class_name, min(det_id) AS first FROM detections GROUP BY 1) SELECT class_name, row_number() OVER (ORDER BY first) AS turn FROM f")
def names_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = detections(spark, sf_dir).groupBy("class_name").agg(F.min("det_id").alias("first"))
    return f.select("class_name", F.row_number().over(Window.orderBy("first")).alias("turn"))


@register("g4_frozen_bench")
def frozen_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test bench of images (orders, as in a18) chosen in each batch so that its class shares come near the batch's own."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("class_name")).agg(F.count("*").alias("n"))
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("batch"))
    counts = per.join(images, "l_orderkey").select("batch", F.col("l_orderkey").cast("string").alias("unit"), "class_name", "n")
    return freeze_bench(counts, share=0.2)


@register("g4_stratified_bench")
def stratified_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of photos that make up a test bench of 15 % of objects, images and classes of each batch."""
    d, k = detections(spark, sf_dir), F.col("parent_id")
    images = d.select(F.col("photo_idx").alias("parent_id")).distinct()
    split = F.when(k % 10 == 0, "test").when(k % 10 == 1, "val").otherwise("train")
    images = images.select(F.concat(F.lit("B"), (k % 6).cast("string")).alias("batch"), "parent_id", F.concat(F.lit("G"), F.floor(k / 12).cast("string")).alias("unit"), split.alias("split"))
    objects = d.groupBy(F.col("photo_idx").alias("parent_id"), "class_name").agg(F.count("*").alias("n"))
    return freeze_stratified(images, objects, 0.15, Scratch(spark, "bench")).select("batch", "unit", "turn", F.round("gap", 6).alias("gap"))


#: Label lines of an image as annotators left them, with faults of every kind; what each batch calls its classes.
LINES = """lines AS (SELECT event_id AS line_no, 'B' || user_id % 7 AS batch, user_id AS image, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, event_id % 6 AS local_id, (event_id % 50) / 100 AS x FROM events),
    names(batch, local_id, name) AS (SELECT 'B' || b.unnest, i.unnest, CASE WHEN i.unnest = 3 AND b.unnest % 2 = 0 THEN 'Unheard Of' ELSE ['Rope', 'bottle', 'Net_piece', 'buoy', 'filet'][i.unnest + 1] END FROM unnest(range(6)) b, unnest(range(5)) i),
    known(key) AS (VALUES ('rope'), ('bottle'), ('net piece'), ('buoy'), ('filet'))"""


def label_lines_of_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(batch, image, line_no, line) and (batch, local_id, name); the last batch names no classes."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("B"), (F.col("user_id") % 7).cast("string")).alias("batch"), F.col("user_id").alias("image"), F.col("event_id").alias("line_no"), k.alias("k"), (F.col("event_id") % 6).alias("id"), (F.col("event_id") % 50 / 100).alias("x"))
    ring = F.format_string("%.2f %.2f %.2f %.2f %.2f %.2f", F.col("x"), F.lit(0.1), F.col("x") + 0.2, F.lit(0.1), F.col("x"), F.lit(0.4))
    body = F.when(F.col("k") % 31 == 3, "0.1 zero 0.2 0.2 0.3 0.3").when(F.col("k") % 31 == 5, "0.1 0.1 0.2 0.2").when(F.col("k") % 31 == 7, F.concat(ring, F.lit(" 0.5"))).when(F.col("k") % 31 == 9, F.concat(ring, F.lit(" 1.02 0.5"))).when(F.col("k") % 31 == 11, "").otherwise(ring)
    lines = e.select("batch", "image", "line_no", F.concat_ws(" ", F.when(F.col("k") % 31 != 11, F.col("id").cast("string")), body).alias("line"))
    batches = table(spark, sf_dir, "events").select(F.concat(F.lit("B"), (F.col("user_id") % 7).cast("string")).alias("batch")).distinct().filter("batch <> 'B6'")
    label = F.array(*map(F.lit, ("Rope", "bottle", "Net_piece", "buoy", "filet")))
    names = batches.withColumn("local_id", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("name", F.when((F.col("local_id") == 3) & (F.substring("batch", 2, 1).cast("int") % 2 == 0), "Unheard Of").otherwise(F.get(label, F.col("local_id"))))
    return lines, names


@register(
    "g15_raw_validation",
    f"""WITH {LINES}, read AS (SELECT *, CASE k % 31 WHEN 3 THEN 'no number' WHEN 5 THEN 'too few points' WHEN 7 THEN 'odd number' WHEN 9 THEN 'out of bounds' END AS fault FROM lines WHERE k % 31 <> 11),
    good AS (SELECT r.*, n.name FROM read r LEFT JOIN names n USING (batch, local_id) WHERE fault IS NULL OR fault = 'out of bounds'),
    found AS (SELECT DISTINCT batch, 'no class names' AS problem, batch AS what FROM read WHERE batch NOT IN (SELECT batch FROM names)
        UNION ALL SELECT batch, fault, image || ':' || line_no FROM read WHERE fault IS NOT NULL AND batch IN (SELECT batch FROM names)
        UNION ALL SELECT DISTINCT batch, 'unknown id', local_id::VARCHAR FROM good WHERE name IS NULL AND batch IN (SELECT batch FROM names)
        UNION ALL SELECT DISTINCT batch, 'unresolved name', name FROM good WHERE lower(replace(name, '_', ' ')) NOT IN (SELECT key FROM known)
        UNION ALL SELECT batch, 'repeated object', a || '~' || b FROM (SELECT a.batch, a.line_no AS a, b.line_no AS b FROM good a JOIN good b ON a.batch = b.batch AND a.image = b.image AND a.local_id = b.local_id AND a.line_no < b.line_no AND a.fault IS NULL AND b.fault IS NULL
            AND a.name IS NOT NULL AND lower(replace(a.name, '_', ' ')) IN (SELECT key FROM known) AND abs(a.x - b.x) < 0.035))
    SELECT batch, problem, count(*) AS n, min(what) AS first FROM found GROUP BY 1, 2""",
)
def raw_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the label lines of each batch: format, bounds, ids and names; objects of an image that are drawn twice."""
    lines, names = label_lines_of_batches(spark, sf_dir)
    known = spark.sql("SELECT * FROM VALUES ('rope'), ('bottle'), ('net piece'), ('buoy'), ('filet') AS k(key)")
    return validate_labels(lines, names, known, 16.0).groupBy("batch", "problem").agg(F.count("*").alias("n"), F.min("what").alias("first"))
