"""Evaluation of detectors: precision and recall, thresholds, bootstraps, comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import stable_unit
from tidemark.operators.bootstrap import resampled_sums
from tidemark.operators.running import best_from_here, in_parts, running
from tidemark.plans.registry import register, table
from tidemark.plans.surveys import DETECTIONS, detections
from tidemark.scratch import Scratch

#: What keeps F1 from dividing by nought, and the edges of size classes.
EPSILON = 1e-9
SIZE_EDGES = (0, 25, 50, 100)

EVAL = f"""{DETECTIONS},
    preds AS (SELECT det_id AS seq, class_name, photo_idx AS parent_id, confidence, (det_id * 7 % 10 < 6)::INTEGER AS tp, coalesce(area_m2, 0) AS area FROM detections WHERE det_id % 4 <> 0),
    truth AS (SELECT det_id, class_name, photo_idx AS parent_id, k AS size, CASE WHEN det_id * 7 % 10 < 6 THEN confidence ELSE -1 END AS matched FROM detections WHERE det_id % 2 = 0)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).filter("det_id % 4 <> 0")
    return d.select(F.col("det_id").alias("seq"), "class_name", F.col("photo_idx").alias("parent_id"), "confidence", (F.col("det_id") * 7 % 10 < 6).cast("int").alias("tp"), F.coalesce("area_m2", F.lit(0.0)).alias("area"))


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).filter("det_id % 2 = 0")
    matched = F.when(F.col("det_id") * 7 % 10 < 6, F.col("confidence")).otherwise(F.lit(-1.0))
    return d.select("det_id", "class_name", F.col("photo_idx").alias("parent_id"), F.col("k").alias("size"), matched.alias("matched"))


def curve(preds: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall after each prediction, most confident first, and the envelope of precision behind it.

    A key with truth and no prediction has no rows; one without truth is left out. Ranks, hits and the envelope run
    over parts of a key, as a key may hold any share of the rows.
    """
    scratch = Scratch(preds.sparkSession, "curve")
    total = truth.groupBy(*keys).agg(F.count("*").alias("n_gt"))
    order = [F.desc("confidence"), F.asc("seq")]
    run = running(in_parts(preds.join(total, keys), keys, order, scratch), keys, order, {"hits": F.col("tp")})
    run = run.withColumn("precision", F.col("hits") / F.col("rn")).withColumn("recall", F.col("hits") / F.col("n_gt"))
    return best_from_here(scratch.keep(run), keys, [F.asc("confidence"), F.desc("seq")], "precision", "envelope")


def class_metrics(preds: DataFrame, truth: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """keys, n_gt, p, r, f1 at the threshold, ap50 (every-point interpolation), f1_max; zeros without predictions."""
    run = curve(preds, truth, keys)
    gain = F.col("tp") / F.col("n_gt")  # of recall
    run = run.withColumn("step", F.col("envelope") * gain).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPSILON))
    at = F.max_by(F.when(F.col("confidence") >= threshold, F.struct("precision", "recall", "f1")), F.when(F.col("confidence") >= threshold, F.col("rn")))
    done = run.groupBy(*keys).agg(at.alias("at"), F.sum("step").alias("ap50"), F.max("f1").alias("f1_max"))
    whole = truth.groupBy(*keys).agg(F.count("*").alias("n_gt")).join(done, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return whole.select(*keys, "n_gt", zero(F.col("at.precision")).alias("p"), zero(F.col("at.recall")).alias("r"), zero(F.col("at.f1")).alias("f1"), zero(F.col("ap50")).alias("ap50"), zero(F.col("f1_max")).alias("f1_max"))


METRICS = """n AS (SELECT class_name, count(*) AS n_gt FROM truth GROUP BY 1),
    r AS (SELECT p.*, n_gt, row_number() OVER w AS rn, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM preds p JOIN n USING (class_name) WINDOW w AS (PARTITION BY class_name ORDER BY confidence DESC, seq)),
    q AS (SELECT *, hits / rn AS prec, hits / n_gt AS rec FROM r),
    e AS (SELECT *, max(prec) OVER (PARTITION BY class_name ORDER BY confidence DESC, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, rec - lag(rec, 1, 0) OVER (PARTITION BY class_name ORDER BY confidence DESC, seq) AS gain, 2 * prec * rec / (prec + rec + 1e-9) AS f FROM q),
    m AS (SELECT class_name, max(n_gt) AS n_gt, coalesce(max_by(prec, rn) FILTER (confidence >= 0.25), 0) AS p, coalesce(max_by(rec, rn) FILTER (confidence >= 0.25), 0) AS r, coalesce(max_by(f, rn) FILTER (confidence >= 0.25), 0) AS f1, sum(env * gain) AS ap50, max(f) AS f1_max FROM e GROUP BY 1)"""


@register("a24_class_metrics", f"WITH {EVAL}, {METRICS} SELECT class_name, n_gt, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1, round(ap50, 6) AS ap50, round(f1_max, 6) AS f1_max FROM m")
def class_metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = class_metrics(predictions(spark, sf_dir), truths(spark, sf_dir), ["class_name"], 0.25)
    return m.select("class_name", "n_gt", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1", "ap50", "f1_max")])


@register("a26_macro_f1", f"WITH {EVAL}, {METRICS} SELECT count(*) AS classes, round(avg(f1), 6) AS macro_f1, round(avg(ap50), 6) AS map50 FROM m")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the classes' F1, not F1 of the means."""
    m = class_metrics(predictions(spark, sf_dir), truths(spark, sf_dir), ["class_name"], 0.25)
    return m.agg(F.count("*").alias("classes"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.avg("ap50"), 6).alias("map50"))


@register(
    "a25_micro_rates",
    f"WITH {EVAL}, {METRICS} SELECT round(sum(n_gt * r) / sum(n_gt), 6) AS recall, round(sum(n_gt * r) / sum(n_gt * r + n_gt * r * (1 / p - 1)), 6) AS prec FROM m WHERE p > 0",
)
def micro_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall rates rebuilt from each class's: TP = n r, FP = TP (1 / p - 1)."""
    m = class_metrics(predictions(spark, sf_dir), truths(spark, sf_dir), ["class_name"], 0.25).filter("p > 0")
    tp = F.col("n_gt") * F.col("r")
    return m.agg(F.round(F.sum(tp) / F.sum("n_gt"), 6).alias("recall"), F.round(F.sum(tp) / F.sum(tp + tp * (1 / F.col("p") - 1)), 6).alias("prec"))


@register(
    "a27_recall_by_size",
    f"WITH {EVAL}, bins(lo, hi) AS (VALUES (0, 25), (25, 50), (50, 100), (100, NULL)) SELECT lo, count(det_id) AS n, round(count(det_id) FILTER (matched >= 0.25) / nullif(count(det_id), 0), 6) AS recall FROM bins LEFT JOIN truth ON size >= lo AND (hi IS NULL OR size < hi) GROUP BY lo",
)
def recall_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins closed below; an empty bin has no recall."""
    lo = F.array_max(F.filter(F.array(*map(F.lit, SIZE_EDGES)), lambda e: F.col("size") >= e))
    by = truths(spark, sf_dir).groupBy(lo.alias("lo")).agg(F.count("*").alias("n"), F.count_if(F.col("matched") >= 0.25).alias("found"))
    bins = spark.range(1).select(F.explode(F.array(*map(F.lit, SIZE_EDGES))).alias("lo"))
    return bins.join(by, "lo", "left").select("lo", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.col("found") / F.col("n"), 6).alias("recall"))


@register(
    "a28_surface_metrics",
    f"WITH {EVAL} SELECT class_name, round(sum(area) FILTER (tp = 1) / nullif(sum(area), 0), 6) AS found_share, round(sum(area) FILTER (tp = 0) / nullif(sum(area) FILTER (tp = 1), 0), 6) AS false_ratio FROM preds WHERE confidence >= 0.1 GROUP BY 1",
)
def surface_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda v: F.sum(F.when(F.col("tp") == v, F.col("area")))
    nought = F.lit(0.0)
    return predictions(spark, sf_dir).filter("confidence >= 0.1").groupBy("class_name").agg(F.round(part(1) / F.nullif(F.sum("area"), nought), 6).alias("found_share"), F.round(part(0) / F.nullif(part(1), nought), 6).alias("false_ratio"))


@register(
    "a32_best_threshold",
    f"""WITH {EVAL}, grid AS (SELECT i / 20.0::DOUBLE AS t FROM range(1, 19) x(i)), gt AS (SELECT count(*) AS n FROM truth),
    s AS (SELECT t, count(*) AS c, sum(tp) AS tp FROM grid JOIN preds ON confidence >= t GROUP BY t), f AS (SELECT t, round(2.0::DOUBLE * tp / (c + n), 6) AS f1 FROM s CROSS JOIN gt)
    SELECT t, f1 FROM f ORDER BY f1 DESC, t DESC LIMIT 1""",
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over a grid of thresholds by running sums from above; a tie goes to the higher threshold."""
    preds = predictions(spark, sf_dir)
    steps = preds.groupBy(F.least(F.floor(F.round(F.col("confidence") * 20, 9)), F.lit(18)).alias("step")).agg(F.count("*").alias("c"), F.sum("tp").alias("tp"))
    grid = spark.range(1, 19).select(F.col("id").alias("step")).join(steps, "step", "left").fillna(0)
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    n_gt = truths(spark, sf_dir).agg(F.count("*").alias("n"))
    f1 = grid.select((F.col("step") / 20).alias("t"), F.sum("c").over(above).alias("c"), F.sum("tp").over(above).alias("tp")).join(F.broadcast(n_gt))
    return f1.select("t", F.round(2.0 * F.col("tp") / (F.col("c") + F.col("n")), 6).alias("f1")).orderBy(F.desc("f1"), F.desc("t")).limit(1)


def poisson_weight(rep, parent, seed: str):
    """How often a parent is drawn in a replicate: Poisson(1) by a stable hash, the large-sample form of drawing anew."""
    u = stable_unit(F.concat_ws(":", F.lit(seed), rep.cast("string"), parent.cast("string")))
    edges = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    return sum(((u >= e).cast("int") for e in edges), F.lit(0))


BOOT = f"""{EVAL}, per AS (SELECT parent_id, sum(tp) FILTER (confidence >= 0.25) AS tp, count(*) FILTER (confidence >= 0.25) AS c, sum(tp) FILTER (confidence >= 0.1) AS tp2, count(*) FILTER (confidence >= 0.1) AS c2 FROM preds GROUP BY 1),
    g AS (SELECT parent_id, count(*) AS n FROM truth GROUP BY 1), j AS (SELECT g.parent_id, n, coalesce(tp, 0) AS tp, coalesce(c, 0) AS c, coalesce(tp2, 0) AS tp2, coalesce(c2, 0) AS c2 FROM g LEFT JOIN per USING (parent_id)),
    u AS (SELECT rep, j.*, ('0x' || sha256('boot:' || rep || ':' || parent_id)[1:15])::BIGINT / pow(16, 15) AS u FROM j, range(200) r(rep)),
    w AS (SELECT *, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT AS k FROM u),
    f AS (SELECT rep, 2.0::DOUBLE * sum(k * tp) / (sum(k * c) + sum(k * n)) AS a, 2.0::DOUBLE * sum(k * tp2) / (sum(k * c2) + sum(k * n)) AS b FROM w GROUP BY rep)"""


def _bootstrap(spark: SparkSession, sf_dir: str, n: int = 200) -> DataFrame:
    """rep, a, b: F1 at two thresholds over images drawn anew. Statistics by image are summed once, then replicated."""
    c = F.col
    at = lambda t, v: F.sum(F.when(c("confidence") >= t, v).otherwise(0))
    per = predictions(spark, sf_dir).groupBy("parent_id").agg(at(0.25, c("tp")).alias("tp"), at(0.25, F.lit(1)).alias("c"), at(0.1, c("tp")).alias("tp2"), at(0.1, F.lit(1)).alias("c2"))
    j = truths(spark, sf_dir).groupBy("parent_id").agg(F.count("*").alias("n")).join(per, "parent_id", "left").fillna(0)
    w = j.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("k", poisson_weight(c("rep"), c("parent_id"), "boot"))
    f1 = lambda tp, cc: 2.0 * F.sum(c("k") * c(tp)) / (F.sum(c("k") * c(cc)) + F.sum(c("k") * c("n")))
    return w.groupBy("rep").agg(f1("tp", "c").alias("a"), f1("tp2", "c2").alias("b"))


@register("a30_bootstrap_interval", f"WITH {BOOT} SELECT round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high FROM f")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bootstrap(spark, sf_dir).agg(F.round(F.percentile("a", 0.025), 6).alias("low"), F.round(F.percentile("a", 0.975), 6).alias("high"))


@register("a31_paired_bootstrap", f"WITH {BOOT} SELECT round(avg(b - a), 6) AS mean_gain, round(quantile_cont(b - a, 0.025), 6) AS low, round(quantile_cont(b - a, 0.975), 6) AS high, round(avg((b > a)::INT), 4) AS p_gain FROM f")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same draws for both sides."""
    d = _bootstrap(spark, sf_dir).withColumn("d", F.col("b") - F.col("a"))
    return d.agg(F.round(F.avg("d"), 6).alias("mean_gain"), F.round(F.percentile("d", 0.025), 6).alias("low"), F.round(F.percentile("d", 0.975), 6).alias("high"), F.round(F.avg((F.col("d") > 0).cast("int")), 4).alias("p_gain"))


def _resampled(spark: SparkSession, sf_dir: str, n: int = 400) -> DataFrame:
    """rep, draws, a, b: F1 at two thresholds over as many images as there are, drawn anew."""
    c = F.col
    at = lambda t, v: F.sum(F.when(c("confidence") >= t, v).otherwise(0))
    per = predictions(spark, sf_dir).groupBy("parent_id").agg(at(0.25, c("tp")).alias("tp"), at(0.25, F.lit(1)).alias("c"), at(0.1, c("tp")).alias("tp2"), at(0.1, F.lit(1)).alias("c2"))
    images = truths(spark, sf_dir).groupBy("parent_id").agg(F.count("*").alias("n")).join(per, "parent_id", "left")
    sums = resampled_sums(images, "parent_id", ["n", "tp", "c", "tp2", "c2"], n, Scratch(spark, "bootstrap"))
    return sums.select("rep", "draws", (2 * c("tp") / (c("c") + c("n"))).alias("a"), (2 * c("tp2") / (c("c2") + c("n"))).alias("b"))


@register("a30_resampled_interval")
def resampled_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of F1 by true resampling of images; draws: of each replicate, as many as images."""
    return _resampled(spark, sf_dir).agg(F.min("draws").alias("draws"), F.round(F.percentile("a", 0.025), 6).alias("low"), F.round(F.percentile("a", 0.975), 6).alias("high"))  # of as many rows as replicates


@register("a31_resampled_gain")
def resampled_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same resampled images for both thresholds."""
    d = _resampled(spark, sf_dir).withColumn("d", F.col("b") - F.col("a"))
    return d.agg(F.round(F.avg("d"), 6).alias("mean_gain"), F.round(F.percentile("d", 0.025), 6).alias("low"), F.round(F.percentile("d", 0.975), 6).alias("high"), F.round(F.avg((F.col("d") > 0).cast("int")), 4).alias("p_gain"))


@register(
    "a33_evaluation_matrix",
    f"""WITH {EVAL}, m AS (SELECT class_name, parent_id % 3 AS site, 2.0::DOUBLE * sum(tp) / (count(*) + 100) AS f1, bool_or(seq % 97 = 0) AS leak FROM preds GROUP BY 1, 2), t AS (SELECT class_name, site, printf('%.3f', f1) || CASE WHEN leak THEN '!' ELSE '' END AS cell FROM m)
    SELECT class_name, max(cell) FILTER (site = 0) AS s0, max(cell) FILTER (site = 1) AS s1, max(cell) FILTER (site = 2) AS s2 FROM t GROUP BY 1""",
)
def evaluation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on x evaluated on, a mark on cells whose test data were seen."""
    m = predictions(spark, sf_dir).groupBy("class_name", F.concat(F.lit("s"), F.col("parent_id") % 3).alias("site")).agg((2.0 * F.sum("tp") / (F.count("*") + 100)).alias("f1"), F.bool_or(F.col("seq") % 97 == 0).alias("leak"))
    cell = F.concat(F.format_string("%.3f", "f1"), F.when(F.col("leak"), "!").otherwise(""))
    return m.withColumn("cell", cell).groupBy("class_name").pivot("site", ["s0", "s1", "s2"]).agg(F.first("cell"))


@register(
    "a34_cells_by_site",
    f"WITH {EVAL} SELECT class_name, coalesce((parent_id % 3)::VARCHAR, 'all') AS site, count(*) AS n, sum(tp)::BIGINT AS tp, round(avg(tp), 6) AS prec FROM preds GROUP BY GROUPING SETS ((class_name), (class_name, parent_id % 3))",
)
def cells_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("site", F.col("parent_id") % 3)
    cells = p.groupingSets([["class_name"], ["class_name", "site"]], "class_name", "site").agg(F.count("*").alias("n"), F.sum("tp").alias("tp"), F.round(F.avg("tp"), 6).alias("prec"))
    return cells.withColumn("site", F.coalesce(F.col("site").cast("string"), F.lit("all")))


@register("a37_outcome_counts", f"WITH {EVAL} SELECT class_name, CASE WHEN tp = 1 AND confidence >= 0.5 THEN 'strong' WHEN tp = 1 THEN 'weak' ELSE 'false' END AS outcome, count(*) AS n FROM preds GROUP BY 1, 2")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when((F.col("tp") == 1) & (F.col("confidence") >= 0.5), "strong").when(F.col("tp") == 1, "weak").otherwise("false")
    return predictions(spark, sf_dir).groupBy("class_name", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@register("a35_best_epoch", "SELECT o_custkey AS run, max_by(o_orderkey, round(o_totalprice, 2) - o_orderkey * 1e-9) AS epoch, round(max(o_totalprice), 2) AS metric FROM orders GROUP BY 1")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row at the best metric, the earlier one on a tie."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("run")).agg(F.max_by("o_orderkey", F.struct(F.round("o_totalprice", 2), -F.col("o_orderkey"))).alias("epoch"), F.round(F.max("o_totalprice"), 2).alias("metric"))


@register(
    "m8_confusion_matrix",
    f"WITH {DETECTIONS} SELECT class_name, count(*) FILTER (k % 5 = 0) AS c0, count(*) FILTER (k % 5 = 1) AS c1, count(*) FILTER (k % 5 = 2) AS c2, count(*) FILTER (k % 5 = 3) AS c3, count(*) FILTER (k % 5 = 4) AS c4 FROM detections GROUP BY 1",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("truth", F.concat(F.lit("c"), F.col("k") % 5))
    return d.groupBy("class_name").pivot("truth", [f"c{i}" for i in range(5)]).count().fillna(0)


@register(
    "m10_threshold_alerts",
    f"WITH {EVAL}, {METRICS.replace('0.25', '0.6')} SELECT class_name, unnest(list_filter([CASE WHEN r < 0.5 THEN 'low recall' END, CASE WHEN p < 0.5 THEN 'low precision' END, CASE WHEN ap50 < 0.5 THEN 'low ap' END], lambda x: x IS NOT NULL)) AS alert FROM m",
)
def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What falls short of one half at a confidence of 0.6."""
    m = class_metrics(predictions(spark, sf_dir), truths(spark, sf_dir), ["class_name"], 0.6)
    found = F.array(*[F.when(F.col(c) < 0.5, F.lit(what)) for c, what in (("r", "low recall"), ("p", "low precision"), ("ap50", "low ap"))])
    return m.select("class_name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("alert"))


ENVELOPE = f"""WITH {EVAL}, {METRICS[: METRICS.index("m AS (")].rstrip().rstrip(",")}"""


@register("w1_running_hits", f"{ENVELOPE} SELECT class_name, seq, rn, hits::BIGINT AS hits, (rn - hits)::BIGINT AS misses FROM r")
def running_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and false alarms up to each prediction, most confident first."""
    run = curve(predictions(spark, sf_dir), truths(spark, sf_dir), ["class_name"])
    return run.select("class_name", "seq", "rn", "hits", (F.col("rn") - F.col("hits")).alias("misses"))


@register("w2_precision_envelope", f"{ENVELOPE} SELECT class_name, seq, round(prec, 6) AS precision, round(env, 6) AS envelope FROM e")
def precision_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best precision from each prediction on."""
    run = curve(predictions(spark, sf_dir), truths(spark, sf_dir), ["class_name"])
    return run.select("class_name", "seq", F.round("precision", 6).alias("precision"), F.round("envelope", 6).alias("envelope"))


@register(
    "w3_values_at_thresholds",
    f"""{ENVELOPE}, t AS (SELECT unnest([0.25, 0.5, 0.75, 0.999]) AS threshold) SELECT class_name, threshold::DOUBLE AS threshold, round(coalesce(max_by(prec, rn) FILTER (confidence >= threshold), 0), 6) AS p,
    round(coalesce(max_by(rec, rn) FILTER (confidence >= threshold), 0), 6) AS r FROM e CROSS JOIN t GROUP BY ALL""",
)
def values_at_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at the last prediction that reaches each threshold; 0 if none does."""
    run = curve(predictions(spark, sf_dir), truths(spark, sf_dir), ["class_name"])
    at = lambda c, t: F.coalesce(F.max_by(F.when(F.col("confidence") >= t, F.col(c)), F.when(F.col("confidence") >= t, F.col("rn"))), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(at("precision", t), 6).alias("p"), F.round(at("recall", t), 6).alias("r")) for t in (0.25, 0.5, 0.75, 0.999)])
    return run.groupBy("class_name").agg(each.alias("each")).select("class_name", F.inline("each"))
