"""Statistics of detections, photos and classes (A*, P*, W*, O*, K* of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import geodesy
from tidemark.operators.running import in_parts, running
from tidemark.operators.order_stats import quantiles, with_quantiles
from tidemark.plans.registry import register, table
from tidemark.plans.surveys import BOXES, DETECTIONS, PHOTOS, WEIGHED, boxes, detections, photos, weighed
from tidemark.scratch import Scratch

def n():
    return F.count("*").alias("n")


@register(
    "a6_panel_statistics",
    f"""WITH {WEIGHED}
    SELECT coalesce(class_name, '(all)') AS class_name, count(*) AS n, round(sum(area_m2), 4) AS area_m2, count(*) - count(area_m2) AS n_area_missing,
        round(CASE WHEN grouping(class_name) = 1 THEN coalesce(sum(weight_mid), 0) ELSE sum(weight_mid) END, 4) AS weight_kg, count(*) - count(weight_mid) AS n_weight_missing
    FROM weighed GROUP BY GROUPING SETS ((class_name), ())""",
)
def panel_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-aware sums: a class without any estimate has a null sum, the total weight then is 0 and total area null."""
    sums = weighed(spark, sf_dir).groupingSets([["class_name"], []], "class_name").agg(
        F.grouping("class_name").alias("is_total"), n(), F.sum("area_m2").alias("area"), F.count_if(F.col("area_m2").isNull()).alias("n_area_missing"), F.sum("weight_mid").alias("weight"), F.count_if(F.col("weight_mid").isNull()).alias("n_weight_missing")
    )
    weight = F.when(F.col("is_total") == 1, F.coalesce("weight", F.lit(0.0))).otherwise(F.col("weight"))
    return sums.select(F.coalesce("class_name", F.lit("(all)")).alias("class_name"), "n", F.round("area", 4).alias("area_m2"), "n_area_missing", F.round(weight, 4).alias("weight_kg"), "n_weight_missing")


@register(
    "a5_app_summary",
    f"""WITH {WEIGHED}
    SELECT coalesce(class_name, '(all)') AS class_name, count(*) AS n, round(sum(coalesce(area_m2, 0)), 4) AS area_m2, round(sum(coalesce(weight_low, 0)), 3) AS low_kg,
        round(sum(coalesce(weight_mid, 0)), 3) AS mid_kg, round(sum(coalesce(weight_high, 0)), 3) AS high_kg, round(count(*) / 25000.0::DOUBLE, 6) AS per_m2
    FROM weighed WHERE confidence >= 0.25 GROUP BY GROUPING SETS ((class_name), ())""",
)
def app_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here a missing weight counts as 0; density on 2.5 hectares."""
    sums = weighed(spark, sf_dir).filter("confidence >= 0.25").groupingSets([["class_name"], []], "class_name")
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    sums = sums.agg(n(), F.round(zero("area_m2"), 4).alias("area_m2"), *[F.round(zero(f"weight_{c}"), 3).alias(f"{c}_kg") for c in ("low", "mid", "high")], F.round(F.count("*") / 25000, 6).alias("per_m2"))
    return sums.withColumn("class_name", F.coalesce("class_name", F.lit("(all)")))


@register("a7_confidence_range", f"WITH {DETECTIONS} SELECT min(confidence) AS low, max(confidence) AS high, round(avg(confidence), 6) AS mean FROM detections")
def confidence_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).agg(F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.round(F.avg("confidence"), 6).alias("mean"))


@register(
    "a8_class_sheet",
    f"""WITH {WEIGHED} SELECT class_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent, round(avg(confidence), 5) AS mean_confidence, round(median(confidence), 5) AS median_confidence,
        round(avg(area_m2), 5) AS mean_area, count(weight_mid) AS n_weighed, round(sum(weight_mid), 3) AS weight_kg FROM weighed GROUP BY class_name""",
)
def class_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians are exact, as everywhere here, and no buffer holds the values of a class."""
    rows = weighed(spark, sf_dir)
    by = rows.groupBy("class_name").agg(n(), F.round(F.avg("confidence"), 5).alias("mean_confidence"), F.round(F.avg("area_m2"), 5).alias("mean_area"), F.count("weight_mid").alias("n_weighed"), F.round(F.sum("weight_mid"), 3).alias("weight_kg"))
    by = with_quantiles(by, rows, ["class_name"], {"median_confidence": ("confidence", 0.5)}, Scratch(spark, "medians")).withColumn("median_confidence", F.round("median_confidence", 5))
    return by.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


BINS = ((0.0, 0.25), (0.25, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0001))


@register(
    "a9_confidence_histogram",
    f"""WITH {DETECTIONS}, bins(lo, hi) AS (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in BINS)}), classes AS (SELECT DISTINCT class_name FROM detections)
    SELECT c.class_name, lo, hi, count(det_id) AS n FROM classes c CROSS JOIN bins LEFT JOIN detections d ON d.class_name = c.class_name AND confidence >= lo AND confidence < hi GROUP BY ALL""",
)
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins closed below, open above; every class has every bin."""
    found = detections(spark, sf_dir)
    place = sum(((F.col("confidence") >= a).cast("int") for a, _ in BINS[1:]), F.lit(0))
    counted = found.groupBy("class_name", place.alias("bin")).agg(n())
    grid = found.select("class_name").distinct().withColumn("bin", F.explode(F.array(*map(F.lit, range(len(BINS))))))
    edges = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in BINS])
    return grid.join(counted, ["class_name", "bin"], "left").select("class_name", edges[F.col("bin")]["lo"].alias("lo"), edges[F.col("bin")]["hi"].alias("hi"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@register(
    "a10_photo_sheet",
    f"""WITH {DETECTIONS}, g AS (SELECT photo_idx, class_name, count(*) AS c, max(confidence) AS top FROM detections GROUP BY ALL)
    SELECT photo_idx, sum(c)::BIGINT AS n, round(max(top), 4) AS best, string_agg(class_name || '(' || c || ')', ', ' ORDER BY c DESC, class_name) AS classes FROM g GROUP BY photo_idx""",
)
def photo_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = detections(spark, sf_dir).groupBy("photo_idx", "class_name").agg(F.count("*").alias("c"), F.max("confidence").alias("top"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "class_name"))), lambda x: F.concat(x["class_name"], F.lit("("), (-x["c"]).cast("string"), F.lit(")"))), ", ")
    return by.groupBy("photo_idx").agg(F.sum("c").alias("n"), F.round(F.max("top"), 4).alias("best"), listed.alias("classes"))


@register(
    "a11_run_summary",
    f"WITH {WEIGHED} SELECT count(*) AS n, count(DISTINCT photo_idx) AS photos, count(DISTINCT class_name) AS classes, round(avg(confidence), 5) AS mean, round(median(confidence), 5) AS median, count(weight_mid) AS weighed, round(sum(weight_mid), 3) AS weight_kg FROM weighed",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weighed(spark, sf_dir)
    one = rows.agg(n(), F.countDistinct("photo_idx").alias("photos"), F.countDistinct("class_name").alias("classes"), F.round(F.avg("confidence"), 5).alias("mean"), F.count("weight_mid").alias("weighed"), F.round(F.sum("weight_mid"), 3).alias("weight_kg"))
    return with_quantiles(one, rows, [], {"median": ("confidence", 0.5)}, Scratch(spark, "medians")).withColumn("median", F.round("median", 5))


@register(
    "a20_capped_photo_histogram",
    f"WITH {DETECTIONS}, per AS (SELECT photo_idx, count(*) AS c FROM detections WHERE confidence >= 0.5 GROUP BY 1) SELECT least(c, 11) AS objects, count(*) AS photos FROM per GROUP BY 1",
)
def capped_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = detections(spark, sf_dir).filter("confidence >= 0.5").groupBy("photo_idx").agg(F.count("*").alias("c"))
    return per.groupBy(F.least("c", F.lit(11).cast("long")).alias("objects")).agg(F.count("*").alias("photos"))


@register(
    "a22_heat_grid",
    f"WITH {BOXES} SELECT floor((x0 + x1) / 2 / 500)::BIGINT AS gx, floor((y0 + y1) / 2 / 500)::BIGINT AS gy, count(*) AS n, round(sum(0.4 + 0.6 * confidence), 3) AS heat FROM boxes GROUP BY 1, 2",
)
def heat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / 500)
    return boxes(spark, sf_dir).groupBy(centre("x0", "x1").alias("gx"), centre("y0", "y1").alias("gy")).agg(n(), F.round(F.sum(0.4 + 0.6 * F.col("confidence")), 3).alias("heat"))


@register(
    "a36_prediction_statistics",
    f"WITH {DETECTIONS} SELECT class_name, count(*) AS n, min(confidence) AS low, round(median(confidence), 5) AS median, round(avg(confidence), 5) AS mean, max(confidence) AS high, round(quantile_cont(confidence, 0.9), 5) AS p90 FROM detections GROUP BY class_name",
)
def prediction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections(spark, sf_dir)
    by = rows.groupBy("class_name").agg(n(), F.min("confidence").alias("low"), F.round(F.avg("confidence"), 5).alias("mean"), F.max("confidence").alias("high"))
    by = with_quantiles(by, rows, ["class_name"], {"median": ("confidence", 0.5), "p90": ("confidence", 0.9)}, Scratch(spark, "medians"))
    return by.withColumns({k: F.round(k, 5) for k in ("median", "p90")})


@register(
    "a2_two_best_views",
    f"""WITH {DETECTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY class_name, photo_idx ORDER BY confidence DESC, det_id) AS rn FROM detections),
    best AS (SELECT class_name, k, confidence, row_number() OVER (PARTITION BY class_name, k ORDER BY confidence DESC, det_id) AS nth FROM r WHERE rn = 1)
    SELECT class_name, k, count(*) AS views, round(CASE WHEN count(*) >= 2 THEN sum(CASE WHEN nth <= 2 THEN confidence END) / 2 ELSE max(confidence) / 2 END, 5) AS score FROM best GROUP BY 1, 2""",
)
def two_best_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best detection of each photo; the score of a group is the mean of its two best views, a single one halved."""
    first = F.row_number().over(Window.partitionBy("class_name", "photo_idx").orderBy(F.desc("confidence"), "det_id"))
    best = detections(spark, sf_dir).withColumn("rn", first).filter("rn = 1")
    top = F.slice(F.sort_array(F.collect_list("confidence"), asc=False), 1, 2)
    by = best.groupBy("class_name", "k").agg(F.count("*").alias("views"), top.alias("top"))
    return by.select("class_name", "k", "views", F.round(F.aggregate("top", F.lit(0.0), lambda a, v: a + v) / 2, 5).alias("score"))


@register(
    "a4_class_vote",
    f"""WITH {DETECTIONS}, votes AS (SELECT photo_idx, k, class_name, sum(confidence) AS total, min(det_id) AS first FROM detections GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY photo_idx, k ORDER BY round(total, 9) DESC, first) AS rn, count(*) OVER (PARTITION BY photo_idx, k) AS candidates FROM votes)
    SELECT photo_idx, k, class_name, round(total, 5) AS total, candidates FROM r WHERE rn = 1""",
)
def class_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence-weighted vote; a tie goes to the class seen first."""
    votes = detections(spark, sf_dir).groupBy("photo_idx", "k", "class_name").agg(F.sum("confidence").alias("total"), F.min("det_id").alias("first"))
    won = votes.groupBy("photo_idx", "k").agg(F.max_by(F.struct("class_name", "total"), F.struct(F.round("total", 9), -F.col("first"))).alias("w"), F.count("*").alias("candidates"))
    return won.select("photo_idx", "k", "w.class_name", F.round("w.total", 5).alias("total"), "candidates")


@register(
    "p1_usable_photos",
    f"""WITH {PHOTOS}, flagged AS (SELECT *, list_filter([CASE WHEN lon IS NULL OR lat IS NULL THEN 'no position' END, CASE WHEN alt IS NULL OR alt <= 1 THEN 'no altitude' END, CASE WHEN yaw IS NULL THEN 'no heading' END,
        CASE WHEN sensor_mm IS NULL THEN 'unknown sensor' END, CASE WHEN abs(pitch + 90) > 8 THEN 'not nadir' END], lambda x: x IS NOT NULL) AS alerts FROM photos)
    SELECT photo_idx, array_to_string(alerts, '; ') AS alerts, len(alerts) = 0 AS usable, round(CASE WHEN len(alerts) = 0 THEN alt * sensor_mm / (focal_mm * width) END, 6) AS gsd,
        coalesce((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + CAST(trunc((lon + 180) / 6) AS INTEGER) + 1, 0) AS epsg FROM flagged""",
)
def usable_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts in place of errors; a photo is usable without any. Ground sample distance and UTM zone (0: none) follow."""
    c = F.col
    checks = [(c("lon").isNull() | c("lat").isNull(), "no position"), (c("alt").isNull() | (c("alt") <= 1), "no altitude"), (c("yaw").isNull(), "no heading"), (c("sensor_mm").isNull(), "unknown sensor"), (F.abs(c("pitch") + 90) > 8, "not nadir")]
    alerts = F.filter(F.array(*[F.when(bad, F.lit(what)) for bad, what in checks]), lambda x: x.isNotNull())
    seen = photos(spark, sf_dir).withColumn("alerts", alerts)
    gsd = F.when(F.size("alerts") == 0, geodesy.ground_sample(c("alt"), c("sensor_mm"), c("focal_mm"), c("width")))
    return seen.select("photo_idx", F.array_join("alerts", "; ").alias("alerts"), (F.size("alerts") == 0).alias("usable"), F.round(gsd, 6).alias("gsd"), F.coalesce(geodesy.utm_epsg(c("lon"), c("lat")), F.lit(0)).alias("epsg"))


@register(
    "a40_inventory_summary",
    f"WITH {PHOTOS} SELECT site, count(*) AS photos, count(lon) AS located, round(median(alt), 4) AS median_alt, round(min(alt), 4) AS low_alt, round(max(alt), 4) AS high_alt, round(avg(lat) FILTER (WHERE lat IS NOT NULL), 4) AS mean_lat FROM photos GROUP BY site",
)
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photos(spark, sf_dir)
    by = rows.groupBy("site").agg(F.count("*").alias("photos"), F.count("lon").alias("located"), F.round(F.min("alt"), 4).alias("low_alt"), F.round(F.max("alt"), 4).alias("high_alt"), F.round(F.avg("lat"), 4).alias("mean_lat"))
    return with_quantiles(by, rows, ["site"], {"median_alt": ("alt", 0.5)}, Scratch(spark, "medians")).withColumn("median_alt", F.round("median_alt", 4))


@register(
    "w12_altitude_outliers",
    f"WITH {PHOTOS}, m AS (SELECT *, median(alt) OVER (PARTITION BY site) AS mid FROM photos) SELECT photo_idx, site, round(alt / mid - 1, 5) AS deviation FROM m WHERE abs(alt - mid) > 0.3 * abs(mid)",
)
def altitude_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that deviate by more than 30 % from the median altitude of their site."""
    rows = photos(spark, sf_dir)
    m = rows.join(quantiles(rows, ["site"], {"mid": ("alt", 0.5)}, Scratch(spark, "medians")), "site")
    return m.filter("abs(alt - mid) > 0.3 * abs(mid)").select("photo_idx", "site", F.round(F.col("alt") / F.col("mid") - 1, 5).alias("deviation"))


@register(
    "a16_class_by_split",
    f"""WITH {DETECTIONS}, s AS (SELECT class_name, CASE WHEN photo_idx % 10 < 7 THEN 'train' WHEN photo_idx % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM detections),
    c AS (SELECT class_name, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM s GROUP BY 1),
    p AS (SELECT *, 100.0::DOUBLE * train / sum(train) OVER () AS ptrain, 100.0::DOUBLE * val / sum(val) OVER () AS pval, 100.0::DOUBLE * test / sum(test) OVER () AS ptest FROM c)
    SELECT class_name, train, val, test, round(ptrain, 4) AS ptrain, round(pval, 4) AS pval, round(ptest, 4) AS ptest, round(greatest(ptrain, pval, ptest) - least(ptrain, pval, ptest), 4) AS spread,
        round(100.0::DOUBLE * train / (train + val + test), 4) AS row_train, least(train, val, test) = 0 AS absent FROM p""",
)
def class_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot with both normalisations, the spread of shares, and an alert for a class absent from a split."""
    split = F.when(F.col("photo_idx") % 10 < 7, "train").when(F.col("photo_idx") % 10 < 9, "val").otherwise("test")
    names = ["train", "val", "test"]
    wide = detections(spark, sf_dir).withColumn("split", split).groupBy("class_name").pivot("split", names).count().fillna(0)
    for s in names:
        wide = wide.withColumn(f"p{s}", 100.0 * F.col(s) / F.sum(s).over(Window.partitionBy()))
    shares = [F.col(f"p{s}") for s in names]
    return wide.select("class_name", *names, *[F.round(f"p{s}", 4).alias(f"p{s}") for s in names], F.round(F.greatest(*shares) - F.least(*shares), 4).alias("spread"), F.round(100.0 * F.col("train") / sum((F.col(s) for s in names), F.lit(0)), 4).alias("row_train"), (F.least(*map(F.col, names)) == 0).alias("absent"))


@register(
    "a42_share_within_transect",
    f"""WITH {DETECTIONS}, g AS (SELECT photo_idx, class_name, count(*) AS c, sum(coalesce(area_m2, 0)) AS area FROM detections GROUP BY ALL)
    SELECT photo_idx, class_name, c, round(100.0::DOUBLE * c / sum(c) OVER w, 4) AS percent, round(100 * area / nullif(sum(area) OVER w, 0), 3) AS area_percent FROM g WINDOW w AS (PARTITION BY photo_idx)""",
)
def share_within_transect(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = detections(spark, sf_dir).groupBy("photo_idx", "class_name").agg(F.count("*").alias("c"), F.sum(F.coalesce("area_m2", F.lit(0.0))).alias("area"))
    w = Window.partitionBy("photo_idx")
    return g.select("photo_idx", "class_name", "c", F.round(100.0 * F.col("c") / F.sum("c").over(w), 4).alias("percent"), F.round(100 * F.col("area") / F.nullif(F.sum("area").over(w), F.lit(0.0)), 3).alias("area_percent"))


@register(
    "a45_weighted_density",
    f"WITH {WEIGHED} SELECT class_name, round(sum(area_m2 * mid) / sum(area_m2), 6) AS mid, round(sum(area_m2 * low) / sum(area_m2), 6) AS low FROM weighed JOIN densities USING (class_name) WHERE area_m2 IS NOT NULL GROUP BY class_name",
)
def weighted_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weighed(spark, sf_dir).filter("weight_mid is not null")
    return w.groupBy("class_name").agg(F.round(F.sum("weight_mid") / F.sum("area_m2"), 6).alias("mid"), F.round(F.sum("weight_low") / F.sum("area_m2"), 6).alias("low"))


@register(
    "o4_top_resolutions",
    "WITH c AS (SELECT l_quantity::INTEGER AS size, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, size) AS rn FROM c) SELECT CASE WHEN rn <= 4 THEN size::VARCHAR ELSE 'others' END AS resolution, sum(n)::BIGINT AS n FROM r GROUP BY 1",
)
def top_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four most frequent, and all others together."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("size")).count()
    top = c.orderBy(F.desc("count"), "size").limit(4).select("size", F.lit(True).alias("top"))
    return c.join(F.broadcast(top), "size", "left").groupBy(F.when(F.col("top"), F.col("size").cast("string")).otherwise("others").alias("resolution")).agg(F.sum("count").alias("n"))


@register(
    "w9_prefix_sums",
    f"""WITH {DETECTIONS}, g AS (SELECT photo_idx AS gx, k AS gy, count(*) AS c FROM detections GROUP BY ALL), dense AS (SELECT x.gx, y.unnest AS gy, coalesce(c, 0) AS c, c IS NOT NULL AS there FROM (SELECT DISTINCT gx FROM g) x CROSS JOIN unnest(range(0, (SELECT max(gy) + 1 FROM g))) y LEFT JOIN g ON g.gx = x.gx AND g.gy = y.unnest),
    a AS (SELECT *, sum(c) OVER (PARTITION BY gx ORDER BY gy) AS along FROM dense), b AS (SELECT *, sum(along) OVER (PARTITION BY gy ORDER BY gx) AS upto FROM a)
    SELECT gx, gy::INTEGER AS gy, along::BIGINT AS along, upto::BIGINT AS upto FROM b WHERE there""",
)
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed-area table at every cell that holds something: running sums along one axis, then along the other over the dense grid."""
    g = detections(spark, sf_dir).groupBy(F.col("photo_idx").alias("gx"), F.col("k").alias("gy")).agg(F.count("*").alias("c"))
    most = g.agg(F.coalesce(F.max("gy"), F.lit(0)).alias("most"))  # one row
    dense = g.select("gx").distinct().crossJoin(F.broadcast(most)).select("gx", F.explode(F.sequence(F.lit(0), "most")).alias("gy")).join(g, ["gx", "gy"], "left")
    along = dense.withColumn("along", F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("gx").orderBy("gy")))
    order = [F.asc("gx")]
    parts = in_parts(along, ["gy"], order, Scratch(spark, "prefix-sums"))
    return running(parts, ["gy"], order, {"upto": F.col("along")}).filter("c is not null").select("gx", "gy", "along", "upto")


@register(
    "w10_three_each_cell",
    f"WITH {DETECTIONS}, r AS (SELECT det_id, photo_idx, k // 13 AS cell, row_number() OVER (PARTITION BY photo_idx, k // 13 ORDER BY sha256('7:' || det_id), det_id) AS rn FROM detections) SELECT det_id, photo_idx, cell FROM r WHERE rn <= 3",
)
def three_each_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three points in each cell, by a seeded hash order."""
    d = detections(spark, sf_dir).withColumn("cell", F.floor(F.col("k") / 13).cast("int"))
    rank = F.row_number().over(Window.partitionBy("photo_idx", "cell").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("det_id").cast("string")).cast("binary"), 256), "det_id"))
    return d.withColumn("rn", rank).filter("rn <= 3").select("det_id", "photo_idx", "cell")


@register(
    "w11_group_letters",
    "WITH g AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1) SELECT p_brand, chr((64 + dense_rank() OVER (ORDER BY first))::INTEGER) AS letter FROM g",
)
def group_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters by first appearance."""
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    return g.select("p_brand", F.chr(64 + F.dense_rank().over(Window.orderBy("first"))).alias("letter"))
