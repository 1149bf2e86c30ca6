"""Sheets of a dataset with positions, and models against sites with what each has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.order_stats import with_quantiles
from tidemark.plans.registry import register
from tidemark.plans.surveys import DETECTIONS, PHOTOS, detections, photos
from tidemark.scratch import Scratch

ITEMS = f"""{DETECTIONS}, {PHOTOS}, items AS (SELECT d.*, 'B' || d.photo_idx % 5 AS batch, lat, lon, lat IS NOT NULL AND lon IS NOT NULL AS placed FROM detections d LEFT JOIN photos USING (photo_idx))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the batch and place of their photo; some photos have no place."""
    at = photos(spark, sf_dir).select("photo_idx", "lat", "lon")
    joined = detections(spark, sf_dir).join(at, "photo_idx", "left")
    return joined.withColumns({"batch": F.concat(F.lit("B"), (F.col("photo_idx") % 5).cast("string")), "placed": F.col("lat").isNotNull() & F.col("lon").isNotNull()})


@register(
    "a12_placed_by_class",
    f"""WITH {ITEMS} SELECT class_name, count(*) AS n, count(DISTINCT photo_idx) AS images, count(DISTINCT batch) AS batches, round(median(area_m2), 4) AS median_area, round(avg(area_m2), 4) AS mean_area,
        round(CASE WHEN count(area_m2) < 2 OR avg(area_m2) = 0 THEN 0 ELSE stddev_samp(area_m2) / avg(area_m2) END, 4) AS cv, count(*) FILTER (placed) AS placed, round(avg(area_m2) FILTER (placed), 4) AS placed_mean_area FROM items GROUP BY 1""",
)
def placed_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each class, all objects and those with a place."""
    rows, c = items(spark, sf_dir), F.col
    cv = F.when((F.count("area_m2") < 2) | (F.avg("area_m2") == 0), 0.0).otherwise(F.stddev_samp("area_m2") / F.avg("area_m2"))
    by = rows.groupBy("class_name").agg(
        F.count("*").alias("n"), F.countDistinct("photo_idx").alias("images"), F.countDistinct("batch").alias("batches"), F.round(F.avg("area_m2"), 4).alias("mean_area"), F.round(cv, 4).alias("cv"),
        F.count_if("placed").alias("placed"), F.round(F.avg(F.when(c("placed"), c("area_m2"))), 4).alias("placed_mean_area"),
    )
    return with_quantiles(by, rows, ["class_name"], {"median_area": ("area_m2", 0.5)}, Scratch(spark, "medians")).withColumn("median_area", F.round("median_area", 4))


@register(
    "a13_batch_positions",
    f"""WITH {ITEMS} SELECT batch, count(*) AS n, count(DISTINCT photo_idx) AS images, count(DISTINCT class_name) AS classes, round(100.0::DOUBLE * count(*) FILTER (placed) / count(*), 1) AS percent_placed,
        round(avg(lat) FILTER (placed), 6) AS lat_mean, min(lat) FILTER (placed) AS lat_min, max(lat) FILTER (placed) AS lat_max, round(avg(lon) FILTER (placed), 6) AS lon_mean, min(lon) FILTER (placed) AS lon_min, max(lon) FILTER (placed) AS lon_max,
        round(sum(area_m2) FILTER (placed), 2) AS placed_area FROM items GROUP BY 1""",
)
def batch_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each batch, where its objects lie, from those with a place; null where none has."""
    placed = lambda name: F.when(F.col("placed"), F.col(name))
    spans = [f(placed(a)).alias(f"{a}_{n}") for a in ("lat", "lon") for n, f in (("mean", lambda v: F.round(F.avg(v), 6)), ("min", F.min), ("max", F.max))]
    return items(spark, sf_dir).groupBy("batch").agg(
        F.count("*").alias("n"), F.countDistinct("photo_idx").alias("images"), F.countDistinct("class_name").alias("classes"), F.round(100.0 * F.count_if("placed") / F.count("*"), 1).alias("percent_placed"),
        *spans, F.round(F.sum(placed("area_m2")), 2).alias("placed_area"),
    )


#: Three models: the first has a report of its training, the second only the manifest of today, the third neither.
SEEN = f"""{DETECTIONS}, images AS (SELECT DISTINCT photo_idx AS parent_id FROM detections),
    manifest AS (SELECT parent_id, CASE WHEN parent_id % 4 < 2 THEN 'train' WHEN parent_id % 4 = 2 THEN 'val' ELSE 'test' END AS split FROM images),
    report AS (SELECT parent_id, CASE WHEN parent_id % 9 = 0 THEN 'train' WHEN parent_id % 9 = 1 THEN 'test' WHEN parent_id % 4 < 2 THEN 'train' WHEN parent_id % 4 = 2 THEN 'val' ELSE 'test' END AS split FROM images WHERE parent_id % 11 <> 5),
    seen AS (SELECT 0 AS model, parent_id, 'report' AS source FROM report WHERE split IN ('train', 'val') UNION ALL SELECT 1, parent_id, 'manifest' FROM manifest WHERE split IN ('train', 'val'))"""


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The manifest of today, and the one that a model's training wrote down: parent_id, split."""
    k = F.col("parent_id")
    images = detections(spark, sf_dir).select(F.col("photo_idx").alias("parent_id")).distinct()
    now = F.when(k % 4 < 2, "train").when(k % 4 == 2, "val").otherwise("test")
    return images.withColumn("split", now), images.filter(k % 11 != 5).withColumn("split", F.when(k % 9 == 0, "train").when(k % 9 == 1, "test").otherwise(now))


def seen_by_models(models: DataFrame, reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """model, parent_id, source: images that a model was trained or tuned on.

    models: model, has_manifest; reports: model, parent_id, split. A model's own report decides; only a model without one
    goes by the manifest, if its dataset still has one. A model with neither has no rows: what it saw isn't known.
    """
    used = F.col("split").isin("train", "val")
    reported = reports.select("model").distinct()
    own = reports.filter(used).select("model", "parent_id", F.lit("report").alias("source"))
    others = models.filter("has_manifest").select("model").join(reported, "model", "left_anti")
    return own.union(others.crossJoin(manifest.filter(used).select("parent_id")).select("model", "parent_id", F.lit("manifest").alias("source")))  # a handful of models


def models_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, report = manifests(spark, sf_dir)
    models = spark.sql("SELECT * FROM VALUES (0, true), (1, true), (2, false) AS m(model, has_manifest)")
    return seen_by_models(models, report.select(F.lit(0).alias("model"), "parent_id", "split"), manifest)


@register("m14_seen_by_run", f"WITH {SEEN} SELECT model, source, parent_id, coalesce(m.split, '?') AS split_today FROM seen LEFT JOIN manifest m USING (parent_id)")
def seen_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each model has seen, from where that is known, beside the split that the image is in today."""
    today = manifests(spark, sf_dir)[0].withColumnRenamed("split", "split_today")
    return models_seen(spark, sf_dir).join(today, "parent_id", "left").select("model", "source", "parent_id", F.coalesce("split_today", F.lit("?")).alias("split_today"))


@register(
    "a33_matrix_with_leaks",
    f"""WITH {SEEN}, tests AS (SELECT parent_id, 's' || parent_id % 3 AS site FROM manifest WHERE split = 'test'), m(model) AS (VALUES (0), (1), (2)),
    gt AS (SELECT site, class_name, count(*) AS n_gt FROM detections d JOIN tests t ON t.parent_id = d.photo_idx WHERE det_id % 2 = 0 GROUP BY 1, 2),
    pr AS (SELECT model, site, class_name, count(*) AS n, sum((det_id * 7 % 10 < 6 + model)::INTEGER) AS tp FROM detections d JOIN tests t ON t.parent_id = d.photo_idx CROSS JOIN m WHERE (det_id + model) % 4 <> 0 AND confidence >= 0.25 GROUP BY 1, 2, 3),
    f AS (SELECT m.model, gt.site, 2.0::DOUBLE * coalesce(tp, 0) / (coalesce(n, 0) + n_gt) AS f1 FROM gt CROSS JOIN m LEFT JOIN pr ON pr.model = m.model AND pr.site = gt.site AND pr.class_name = gt.class_name),
    cells AS (SELECT model, site, avg(f1) AS f1 FROM f GROUP BY 1, 2), t AS (SELECT site, count(*) AS n_test FROM tests GROUP BY 1),
    leaks AS (SELECT model, site, count(*) AS leaked FROM seen JOIN tests USING (parent_id) GROUP BY 1, 2)
    SELECT c.model, c.site, round(f1, 6) AS macro_f1, n_test, CASE WHEN c.model IN (SELECT model FROM seen) THEN coalesce(leaked, 0) END AS leaked, CASE WHEN c.model NOT IN (SELECT model FROM seen) THEN '?' WHEN leaked > 0 THEN '!' ELSE '' END AS mark
    FROM cells c JOIN t USING (site) LEFT JOIN leaks l ON l.model = c.model AND l.site = c.site""",
)
def matrix_with_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 of each model on each site's test images, with how many of these it has seen; ? where that isn't known."""
    c = F.col
    tests = manifests(spark, sf_dir)[0].filter("split = 'test'").select("parent_id", F.concat(F.lit("s"), (c("parent_id") % 3).cast("string")).alias("site"))
    on = detections(spark, sf_dir).join(tests, c("photo_idx") == c("parent_id"))
    models = spark.range(3).select(c("id").cast("int").alias("model"))
    each = on.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(2))))
    truth = on.filter("det_id % 2 = 0").groupBy("site", "class_name").agg(F.count("*").alias("n_gt")).crossJoin(F.broadcast(models))
    found = each.filter("(det_id + model) % 4 <> 0 AND confidence >= 0.25").groupBy("model", "site", "class_name").agg(F.count("*").alias("n"), F.sum((c("det_id") * 7 % 10 < 6 + c("model")).cast("int")).alias("tp"))
    f1 = 2.0 * F.coalesce("tp", F.lit(0)) / (F.coalesce("n", F.lit(0)) + c("n_gt"))
    cells = truth.join(found, ["model", "site", "class_name"], "left").groupBy("model", "site").agg(F.avg(f1).alias("f1"))
    seen = models_seen(spark, sf_dir)
    leaks = seen.join(tests, "parent_id").groupBy("model", "site").agg(F.count("*").alias("leaked"))
    known = seen.select("model", F.lit(True).alias("known")).distinct()
    whole = cells.join(tests.groupBy("site").agg(F.count("*").alias("n_test")), "site").join(leaks, ["model", "site"], "left").join(known, "model", "left")
    leaked = F.when(c("known"), F.coalesce("leaked", F.lit(0).cast("long")))
    return whole.select("model", "site", F.round("f1", 6).alias("macro_f1"), "n_test", leaked.alias("leaked"), F.when(leaked.isNull(), "?").when(leaked > 0, "!").otherwise("").alias("mark"))
