"""More of the inventory: predicates, coordinates, names and paths, lookups and manifests of runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import geodesy
from tidemark.functions.geometry import convex_hull
from tidemark.operators import matching
from tidemark.operators.spatial_join import area, iou, meeting_pairs, overlap, self_pairs
from tidemark.operators.running import ranked
from tidemark.plans.registry import register, table
from tidemark.plans.spatial import CELL, FOOTPRINTS, IOU, MEET, footprints
from tidemark.plans.surveys import BOXES, DETECTIONS, PARENTS, PHOTOS, WEIGHED, boxes, detections, parents, photos, sightings, weighed
from tidemark.scratch import Scratch

c = lambda name: F.col(name)


@register(
    "p2_filtered_summary",
    f"WITH {WEIGHED} SELECT class_name, count(*) AS n, round(sum(weight_mid), 3) AS weight_kg, round(min(confidence), 4) AS low FROM weighed WHERE confidence >= 0.4 AND class_name IN ('view', 'click', 'error') GROUP BY 1",
)
def filtered_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold and class filter after fusion, as a map's sliders apply them."""
    return weighed(spark, sf_dir).filter((c("confidence") >= 0.4) & c("class_name").isin("view", "click", "error")).groupBy("class_name").agg(F.count("*").alias("n"), F.round(F.sum("weight_mid"), 3).alias("weight_kg"), F.round(F.min("confidence"), 4).alias("low"))


@register(
    "p4_nadir_and_resolution",
    f"WITH {PHOTOS}, g AS (SELECT *, alt * 13.1328::DOUBLE / (8.38::DOUBLE * 5472) AS gsd FROM photos) SELECT photo_idx, abs(pitch + 90) <= 8 AS nadir, gsd NOT BETWEEN 0.85 * 0.01 AND 1.15 * 0.03 AS out_of_range, coalesce(yaw, 0) AS yaw FROM g WHERE alt > 0",
)
def nadir_and_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    gsd = geodesy.ground_sample(c("alt"), F.lit(13.1328), F.lit(8.38), F.lit(5472))
    return photos(spark, sf_dir).filter("alt > 0").select("photo_idx", (F.abs(c("pitch") + 90) <= 8).alias("nadir"), (~gsd.between(0.85 * 0.01, 1.15 * 0.03)).alias("out_of_range"), F.coalesce("yaw", F.lit(0.0)).alias("yaw"))


@register(
    "p8_scope_and_order",
    f"WITH {PARENTS}, s AS (SELECT *, CASE WHEN parent_id % 10 < 7 THEN 'train' WHEN parent_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM parents) SELECT parent_id, batch, row_number() OVER (PARTITION BY batch ORDER BY parent_id) AS turn FROM s WHERE split IN ('val', 'test') AND contains(lower(batch), 'en')",
)
def scope_and_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = c("parent_id") % 10
    split = F.when(last < 7, "train").when(last < 9, "val").otherwise("test")
    rows = parents(spark, sf_dir).withColumn("split", split).filter(c("split").isin("val", "test") & F.contains(F.lower("batch"), F.lit("en")))
    return ranked(rows.select("parent_id", "batch"), ["batch"], [F.asc("parent_id")], Scratch(spark, "order")).select("parent_id", "batch", F.col("rn").alias("turn"))


@register(
    "p14_nodata_tiles",
    "SELECT l_linenumber AS tile, count(*) AS n, count(*) FILTER (l_discount * 10 < 0.5) AS usable, count(*) FILTER (l_tax <= 0.02) AS enough FROM lineitem GROUP BY 1",
)
def nodata_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions (P12) and tiles (P14) with too much nodata don't count."""
    return table(spark, sf_dir, "lineitem").groupBy(c("l_linenumber").alias("tile")).agg(F.count("*").alias("n"), F.count_if(c("l_discount") * 10 < 0.5).alias("usable"), F.count_if(c("l_tax") <= 0.02).alias("enough"))


@register(
    "j14_buffered_ground",
    f"WITH {BOXES}, {FOOTPRINTS}, s AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM f) SELECT a.id AS test, count(*) AS neighbours FROM s a JOIN s b ON a.split = 'test' AND b.split = 'train' AND a.id % 10 = b.id % 10 AND a.x0 - 5 <= b.x1 AND b.x0 <= a.x1 + 5 AND a.y0 - 5 <= b.y1 AND b.y0 <= a.y1 + 5 GROUP BY 1",
)
def buffered_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test footprints with training ground within 5 m, by site."""
    f = footprints(spark, sf_dir).withColumn("site", c("id") % 10)
    met = meeting_pairs(f.filter("id % 4 = 0"), f.filter("id % 4 <> 0"), 512.0, ("site",), distance=5.0)
    return met.groupBy(c("a_id").alias("test")).agg(F.count("*").alias("neighbours"))


@register(
    "j24_leaked_tests",
    f"WITH {PARENTS}, seen AS (SELECT DISTINCT ground FROM parents WHERE parent_id % 5 <> 0), t AS (SELECT site, ground IN (FROM seen) AS leaked FROM parents WHERE parent_id % 5 = 0) SELECT site, count(*) AS tests, count(*) FILTER (leaked) AS leaked FROM t GROUP BY 1",
)
def leaked_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parents(spark, sf_dir)
    seen = p.filter("parent_id % 5 <> 0").select("ground").distinct().withColumn("seen", F.lit(True))
    t = p.filter("parent_id % 5 = 0").join(seen, "ground", "left")
    return t.groupBy("site").agg(F.count("*").alias("tests"), F.count("seen").alias("leaked"))


@register(
    "j25_paired_records",
    f"WITH {DETECTIONS}, a AS (SELECT photo_idx, sum(confidence) AS s FROM detections WHERE det_id % 2 = 0 GROUP BY 1), b AS (SELECT photo_idx, sum(confidence) AS s FROM detections WHERE det_id % 3 = 0 GROUP BY 1) SELECT photo_idx, round(a.s, 4) AS first, round(b.s, 4) AS second, round(b.s - a.s, 4) AS gain FROM a JOIN b USING (photo_idx)",
)
def paired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    side = lambda k, name: d.filter(f"det_id % {k} = 0").groupBy("photo_idx").agg(F.sum("confidence").alias(name))
    j = side(2, "a").join(side(3, "b"), "photo_idx")
    return j.select("photo_idx", F.round("a", 4).alias("first"), F.round("b", 4).alias("second"), F.round(c("b") - c("a"), 4).alias("gain"))


@register("j27_cross_model_clusters")
def cross_model_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three models that lie on no annotation, clustered within each photo, every one with its cluster."""
    scratch = Scratch(spark, "model-clusters")
    all_ = scratch.keep(sightings(spark, sf_dir).drop("ring").withColumn("model", c("det_id") % 3))
    truth, found = all_.filter("det_id % 5 = 0"), all_.filter("det_id % 5 <> 0")
    on = meeting_pairs(found, truth, 16.0, ("photo_idx",)).filter((iou() >= 0.3) | (overlap() / area("a") >= 0.3)).select(c("a_det_id").alias("det_id")).distinct()
    free = scratch.keep(found.join(on, "det_id", "left_anti"))
    near = self_pairs(free, 16.0, ("photo_idx",), "det_id").filter((iou() >= matching.JOIN_IOU) | (overlap() / F.least(area("a"), area("b")) >= matching.JOIN_COVER))
    return matching.model_clusters(free, near.select(c("a_det_id").alias("a"), c("b_det_id").alias("b")), scratch)


@register(
    "a17_raw_audit",
    f"WITH {DETECTIONS} SELECT class_name, count(*) AS objects, count(DISTINCT photo_idx) AS images, count(*) FILTER (area_m2 IS NULL) AS without_area, round(min(area_m2), 4) AS low, round(max(area_m2), 4) AS high FROM detections GROUP BY 1",
)
def raw_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("objects"), F.countDistinct("photo_idx").alias("images"), F.count_if(c("area_m2").isNull()).alias("without_area"), F.round(F.min("area_m2"), 4).alias("low"), F.round(F.max("area_m2"), 4).alias("high"))


@register("a44_site_hulls")
def site_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex hull of each class's ground: hulls of pieces first, so that no task holds a whole class."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"class_name": pdf.class_name.iloc[0], "x": hull[:, 0], "y": hull[:, 1]})

    points = boxes(spark, sf_dir).select("class_name", c("x0").alias("x"), c("y0").alias("y"), F.pmod(F.xxhash64("det_id"), F.lit(64)).alias("piece"))
    part = points.groupBy("class_name", "piece").applyInPandas(run, "class_name string, x double, y double")
    return part.groupBy("class_name").applyInPandas(run, "class_name string, x double, y double")


@register(
    "f6_transect_names",
    "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)/(en|de)/[0-9]+') THEN upper(regexp_extract(url, '(?i)/(en|de)/([0-9]+)', 1)) || '-' || regexp_extract(url, '(?i)/(en|de)/([0-9]+)', 2) WHEN contains(url, '?') THEN 'query' ELSE split_part(url, '/', 4) END AS transect, replace(split_part(split_part(url, '//', 2), '.', 1), '_', ' ') AS batch FROM pages",
)
def transect_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by pattern with fallbacks (F6), batch from a name (F7), what follows a marker (F8)."""
    u, pattern = c("url"), r"(?i)/(en|de)/([0-9]+)"
    name = F.when(u.rlike(r"(?i)/(en|de)/[0-9]+"), F.concat(F.upper(F.regexp_extract(u, pattern, 1)), F.lit("-"), F.regexp_extract(u, pattern, 2)))
    name = name.when(F.contains(u, F.lit("?")), "query").otherwise(F.split_part(u, F.lit("/"), F.lit(4)))
    batch = F.replace(F.split_part(F.split_part(u, F.lit("//"), F.lit(2)), F.lit("."), F.lit(1)), F.lit("_"), F.lit(" "))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("transect"), batch.alias("batch"))


@register(
    "f17_pixel_to_ground",
    f"WITH {PHOTOS}, g AS (SELECT photo_idx, alt * 13.1328::DOUBLE / (8.38::DOUBLE * 5472) AS g, radians(coalesce(yaw, 0)) AS t FROM photos), p AS (SELECT photo_idx, (100 - 2736.0::DOUBLE) * g AS r, (1824.0::DOUBLE - 200) * g AS u, t FROM g) SELECT photo_idx, round(r * cos(t) + u * sin(t), 5) AS x, round(-r * sin(t) + u * cos(t), 5) AS y FROM p",
)
def pixel_to_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    gsd = geodesy.ground_sample(c("alt"), F.lit(13.1328), F.lit(8.38), F.lit(5472))
    x, y = geodesy.pixel_to_local(F.lit(100), F.lit(200), F.lit(5472), F.lit(3648), gsd, F.coalesce("yaw", F.lit(0.0)), F.lit(0.0), F.lit(0.0))
    return photos(spark, sf_dir).select("photo_idx", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


UNDISTORTED = f"WITH {BOXES}, s0 AS (SELECT det_id, x0 / 20000 AS x, y0 / 20000 AS y, x0 / 20000 AS u, y0 / 20000 AS v FROM boxes)" + "".join(
    f", s{k + 1} AS (SELECT det_id, x, y, x / (1 + 0.05 * (u * u + v * v)) AS u, y / (1 + 0.05 * (u * u + v * v)) AS v FROM s{k})" for k in range(4)
)


@register("f18_undistorted", f"{UNDISTORTED} SELECT det_id, round(u, 8) AS u, round(v, 8) AS v, round(abs(u * (1 + 0.05 * (u * u + v * v)) - x), 6) AS off FROM s4")
def undistorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radial distortion taken off by four fixed-point steps; put on again it gives the point back."""
    u, v = geodesy.undistort(c("x0") / 20000, c("y0") / 20000, F.lit(0.05))
    b = boxes(spark, sf_dir).select("det_id", u.alias("u"), v.alias("v"), (c("x0") / 20000).alias("x"))
    return b.select("det_id", F.round("u", 8).alias("u"), F.round("v", 8).alias("v"), F.round(F.abs(c("u") * (1 + 0.05 * (c("u") * c("u") + c("v") * c("v"))) - c("x")), 6).alias("off"))


@register(
    "f21_tile_bounds",
    "WITH t AS (SELECT p_partkey, p_size AS z, p_partkey % 7 AS x, p_partkey % 5 AS y FROM part), s AS (SELECT *, 2 * 20037508.342789244 / pow(2, z) AS w FROM t) SELECT p_partkey, round(x * w - 20037508.342789244, 3) AS west, round(20037508.342789244 - (y + 1) * w, 3) AS south, round((x + 1) * w - 20037508.342789244, 3) AS east, round(20037508.342789244 - y * w, 3) AS north FROM s",
)
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = geodesy.tile_bounds(c("p_partkey") % 7, c("p_partkey") % 5, c("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(s, 3).alias(n) for s, n in zip(sides, ("west", "south", "east", "north"))])


@register(
    "f28_centring",
    f"WITH {BOXES} SELECT det_id, round(sqrt(pow((x0 + x1) / 2 % 100 - 50, 2) + pow((y0 + y1) / 2 % 100 - 50, 2)) / sqrt(pow(50, 2) + pow(50, 2)), 6) AS off, round(greatest(0, least(1, x0 / 20000)), 6) AS nx, round(greatest(0, least(1, y1 / 2000)), 6) AS ny FROM boxes",
)
def centring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from the middle over half the diagonal (F28); coordinates normalised and clamped."""
    away = lambda a, b: F.pow((c(a) + c(b)) / 2 % 100 - 50, F.lit(2.0))
    unit = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 6)
    return boxes(spark, sf_dir).select("det_id", F.round(F.sqrt(away("x0", "x1") + away("y0", "y1")) / F.sqrt(F.lit(5000.0)), 6).alias("off"), unit(c("x0") / 20000).alias("nx"), unit(c("y1") / 2000).alias("ny"))


@register(
    "f39_background_allowance",
    "SELECT o_orderstatus AS split, p AS percent, count(*) AS fg, floor(count(*) * p / (100 - p))::BIGINT AS allowed FROM orders CROSS JOIN (VALUES (5), (10), (20)) v(p) GROUP BY 1, 2",
)
def background_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy(c("o_orderstatus").alias("split")).agg(F.count("*").alias("fg")).withColumn("percent", F.explode(F.array(*map(F.lit, (5, 10, 20)))))
    return by.select("split", "percent", "fg", F.floor(c("fg") * c("percent") / (100 - c("percent"))).alias("allowed"))


@register(
    "f42_duration_estimate",
    f"WITH {PHOTOS} SELECT site, count(*) AS photos, round(2.6::DOUBLE * count(*) + 30, 1) AS seconds, string_agg(photo_idx::VARCHAR, ',' ORDER BY photo_idx) AS listed FROM photos GROUP BY 1",
)
def duration_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_join(F.sort_array(F.collect_list("photo_idx")).cast("array<string>"), ",")
    return photos(spark, sf_dir).groupBy("site").agg(F.count("*").alias("photos"), F.round(2.6 * F.count("*") + 30, 1).alias("seconds"), listed.alias("listed"))


@register("f46_list_parameters", "SELECT page_id, list_sort(list_transform(string_split(split_part(url, '?', 2), '&'), lambda x: trim(split_part(x, '=', 1)))) AS names FROM pages WHERE contains(url, '?')")
def list_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.split_part("url", F.lit("?"), F.lit(2)), "&")
    return table(spark, sf_dir, "pages").filter(F.contains("url", F.lit("?"))).select("page_id", F.sort_array(F.transform(parts, lambda x: F.trim(F.split_part(x, F.lit("="), F.lit(1))))).alias("names"))


@register(
    "g11_downstream_purge",
    "WITH changed AS (SELECT 'B_' || p_brand || '_' || p_partkey AS parent FROM part WHERE p_partkey % 9 = 0), tiles AS (SELECT 'B_' || p_brand || '_' || p_partkey || '_' || (p_size * 384) || '_0' AS tile FROM part) SELECT tile FROM tiles WHERE regexp_extract(tile, '^(.*)_[0-9]+_[0-9]+$', 1) IN (FROM changed)",
)
def downstream_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of changed parents: a semi join on the parent in the tile's name."""
    from tidemark.functions.keys import parent_of_tile

    name = F.concat(F.lit("B_"), "p_brand", F.lit("_"), c("p_partkey").cast("string"))
    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("parent"), F.concat(name, F.lit("_"), (c("p_size") * 384).cast("string"), F.lit("_0")).alias("tile"))
    changed = p.filter("p_partkey % 9 = 0").select(c("parent").alias("gone"))
    return p.select("tile", parent_of_tile(c("tile")).alias("of")).join(changed, c("of") == c("gone"), "left_semi").select("tile")


@register(
    "m6_missing_annotations",
    f"WITH {BOXES}, hit AS (SELECT DISTINCT b.det_id FROM cells a JOIN cells b ON a.cx = b.cx AND a.cy = b.cy AND a.class_name = b.class_name AND a.det_id % 2 = 0 AND b.det_id % 2 = 1 AND {MEET} WHERE {IOU} >= 0.1) SELECT photo_idx, count(*) AS candidates, max(confidence) AS top FROM boxes WHERE det_id % 2 = 1 AND confidence >= 0.6 AND det_id NOT IN (FROM hit) GROUP BY 1",
)
def missing_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes(spark, sf_dir)
    guess = found.filter("det_id % 2 = 1")
    hit = meeting_pairs(guess, found.filter("det_id % 2 = 0"), CELL, ("class_name",)).filter(iou() >= 0.1).select(c("a_det_id").alias("det_id")).distinct()
    return guess.filter("confidence >= 0.6").join(hit, "det_id", "left_anti").groupBy("photo_idx").agg(F.count("*").alias("candidates"), F.max("confidence").alias("top"))


@register(
    "m9_declared_classes",
    f"WITH {DETECTIONS}, declared(class_name, turn) AS (VALUES ('view', 0), ('click', 1), ('purchase', 2), ('signup', 3), ('error', 4), ('never', 5)) SELECT turn, class_name, count(det_id) AS n, round(avg(confidence), 5) AS mean FROM declared LEFT JOIN detections USING (class_name) GROUP BY 1, 2",
)
def declared_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for every declared class, without instances too."""
    names = spark.sql("SELECT * FROM VALUES ('view', 0), ('click', 1), ('purchase', 2), ('signup', 3), ('error', 4), ('never', 5) AS d(class_name, turn)")
    d = detections(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 5).alias("mean"))
    return names.join(d, "class_name", "left").fillna({"n": 0}).select("turn", "class_name", "n", "mean")


@register(
    "m12_run_comparison",
    f"WITH {DETECTIONS} SELECT class_name, round(avg(confidence) FILTER (photo_idx % 3 = 0), 5) AS run0, round(avg(confidence) FILTER (photo_idx % 3 = 1), 5) AS run1, round(avg(confidence) FILTER (photo_idx % 3 = 2), 5) AS run2 FROM detections GROUP BY 1",
)
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("run", F.concat(F.lit("run"), c("photo_idx") % 3))
    return d.groupBy("class_name").pivot("run", ["run0", "run1", "run2"]).agg(F.round(F.avg("confidence"), 5))


@register("m16_newest_matching", "SELECT o_orderpriority AS tag, arg_max(o_orderkey, [epoch(o_orderdate)::BIGINT, o_orderkey]) AS newest FROM orders WHERE regexp_matches(o_orderpriority, '^[1-3]-') AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def newest_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(c("o_orderpriority").rlike("^[1-3]-") & (c("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")))
    return o.groupBy(c("o_orderpriority").alias("tag")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@register(
    "m17_weighted_progress",
    "SELECT o_custkey AS job, round(sum(CASE WHEN o_orderstatus = 'F' THEN w ELSE 0 END) / sum(w), 6) AS progress FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM orders) GROUP BY 1",
)
def weighted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("w", F.when(c("o_orderpriority") == "1-URGENT", 5.0).otherwise(1.0))
    return o.groupBy(c("o_custkey").alias("job")).agg(F.round(F.sum(F.when(c("o_orderstatus") == "F", c("w")).otherwise(0.0)) / F.sum("w"), 6).alias("progress"))


@register(
    "m23_counts_for_bench",
    "WITH t AS (SELECT l_orderkey AS parent, p_type AS target FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'ECONOMY'), r AS (SELECT l_orderkey AS parent, count(*) AS raw FROM lineitem GROUP BY 1) SELECT parent, raw, count(target) AS resolved, count(DISTINCT target) AS targets FROM r LEFT JOIN t USING (parent) GROUP BY 1, 2",
)
def counts_for_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (M24) and resolved counts of a label, excluded classes left out."""
    l = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("parent"), "l_partkey")
    p = table(spark, sf_dir, "part").filter("p_type <> 'ECONOMY'").select(c("p_partkey").alias("l_partkey"), c("p_type").alias("target"))
    return l.join(p, "l_partkey", "left").groupBy("parent").agg(F.count("*").alias("raw"), F.count("target").alias("resolved"), F.countDistinct("target").alias("targets"))


@register(
    "m30_auto_write",
    f"WITH {DETECTIONS} SELECT photo_idx, string_agg(class_name || ' ' || printf('%.2f', floor(100 * confidence) / 100), '|' ORDER BY confidence DESC, det_id) AS lines FROM detections WHERE confidence >= 0.95 GROUP BY 1",
)
def auto_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is confident enough, most confident first, as the lines of a label file."""
    line = F.concat("class_name", F.lit(" "), F.format_string("%.2f", F.floor(100 * c("confidence")) / 100))
    d = detections(spark, sf_dir).filter("confidence >= 0.95").select("photo_idx", F.struct((-c("confidence")).alias("s"), "det_id", line.alias("line")).alias("x"))
    return d.groupBy("photo_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "|").alias("lines"))


@register(
    "u1_union_of_photos",
    f"WITH {DETECTIONS}, u AS (SELECT photo_idx, det_id FROM detections WHERE k < 30 UNION ALL SELECT photo_idx, det_id FROM detections WHERE k >= 20), d AS (SELECT DISTINCT photo_idx FROM u WHERE det_id % 2 = 0 INTERSECT SELECT DISTINCT photo_idx FROM u WHERE det_id % 3 = 0) SELECT photo_idx, count(*) AS rows, count(DISTINCT det_id) AS ids FROM u WHERE photo_idx IN (FROM d) GROUP BY 1",
)
def union_of_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).select("photo_idx", "det_id", "k")
    u = d.filter("k < 30").unionByName(d.filter("k >= 20"))
    both = u.filter("det_id % 2 = 0").select("photo_idx").intersect(u.filter("det_id % 3 = 0").select("photo_idx"))
    return u.join(both, "photo_idx", "left_semi").groupBy("photo_idx").agg(F.count("*").alias("rows"), F.countDistinct("det_id").alias("ids"))


@register(
    "g5_rescue_windows",
    f"""WITH {BOXES}, o AS (SELECT det_id, photo_idx, x0 % 1400 AS x0, y0 % 1000 AS y0, x0 % 1400 + (x1 - x0) AS x1, y0 % 1000 + (y1 - y0) AS y1 FROM boxes),
    w(wx, wy) AS (SELECT * FROM (VALUES (0), (640), (860)) a(x), (VALUES (0), (460)) b(y)),
    f AS (SELECT o.*, max(greatest(0, least(x1, wx + 640) - greatest(x0, wx)) * greatest(0, least(y1, wy + 640) - greatest(y0, wy)) / ((x1 - x0) * (y1 - y0))) AS best FROM o CROSS JOIN w GROUP BY ALL)
    SELECT photo_idx, greatest(0, least(860, floor((x0 + x1) / 2) - 320))::BIGINT AS wx, greatest(0, least(460, floor((y0 + y1) / 2) - 320))::BIGINT AS wy, count(*) AS objects FROM f WHERE round(best, 9) < 0.8 GROUP BY 1, 2, 3""",
)
def rescue_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows added around objects of which no regular window holds 0.8; an image is 1500 x 1100, a window 640."""
    from tidemark.operators.tiling import windows

    w, h = c("x1") - c("x0"), c("y1") - c("y0")
    o = boxes(spark, sf_dir).select("det_id", "photo_idx", (c("x0") % 1400).alias("x0"), (c("y0") % 1000).alias("y0"), (c("x0") % 1400 + w).alias("x1"), (c("y0") % 1000 + h).alias("y1"))
    regular = windows(spark.sql("SELECT 1500 AS w, 1100 AS h"), "w", "h", 640, 640).select("x0", "y0").distinct()
    places = F.array(*[F.struct(F.lit(r["x0"]).alias("x"), F.lit(r["y0"]).alias("y")) for r in sorted(regular.collect())])  # a handful, the same for every image
    side = lambda lo, hi, at: F.greatest(F.lit(0.0), F.least(c(hi), at + 640) - F.greatest(c(lo), at))
    best = F.array_max(F.transform(places, lambda p: side("x0", "x1", p["x"]) * side("y0", "y1", p["y"]) / ((c("x1") - c("x0")) * (c("y1") - c("y0")))))
    inside = lambda lo, hi, most: F.greatest(F.lit(0), F.least(F.lit(most), F.floor((c(lo) + c(hi)) / 2) - 320)).cast("long")
    return o.filter(F.round(best, 9) < 0.8).groupBy("photo_idx", inside("x0", "x1", 860).alias("wx"), inside("y0", "y1", 460).alias("wy")).agg(F.count("*").alias("objects"))
