"""Sources and sinks: files derived from the given tables, written to the shared folder and read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry, keys
from tidemark.operators.running import ranked
from tidemark.plans.registry import register, table
from tidemark.plans.singles import PATHS, paths
from tidemark.plans.spatial import BOXES, OWNED, footprints, owned_cells
from tidemark.plans.surveys import DETECTIONS, WEIGHED, boxes, detections, weighed
from tidemark.scratch import Scratch
from tidemark.sources import labels, photos
from tidemark.sources.exif import written_heads

c = F.col

#: Label lines of customers, in a file for each nation: good ones, and of every fifth kind one that is malformed.
LABELS = """lines AS (SELECT c_custkey AS k, c_nationkey AS batch, CASE c_custkey % 10 WHEN 3 THEN 'x 0.1 0.2 0.3 0.4 0.5 0.6' WHEN 7 THEN (c_custkey % 6)::VARCHAR || ' 0.1 0.2 0.3' ELSE
    (c_custkey % 6)::VARCHAR || ' 0.1 0.2 ' || (c_custkey % 9 + 3) || '.5 0.2 0.4 0.75' END AS line FROM customer)"""


def label_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Writes the label lines, a folder of text files for each batch, and gives the path."""
    k = c("c_custkey")
    number = (k % 6).cast("string")
    line = F.when(k % 10 == 3, "x 0.1 0.2 0.3 0.4 0.5 0.6").when(k % 10 == 7, F.concat(number, F.lit(" 0.1 0.2 0.3"))).otherwise(F.concat(number, F.lit(" 0.1 0.2 "), (k % 9 + 3).cast("string"), F.lit(".5 0.2 0.4 0.75")))
    path = Scratch(spark, name).path("labels")
    table(spark, sf_dir, "customer").select(c("c_nationkey").alias("batch"), line.alias("value")).write.partitionBy("batch").text(path)
    return path


def read_labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """batch, local_id, ring: of the lines that are well-formed."""
    return labels.label_lines(spark.read.text(label_folder(spark, sf_dir, name)), "value").select("batch", "local_id", "ring")


GOOD = f"{LABELS}, good AS (SELECT k, batch, k % 6 AS local_id FROM lines WHERE k % 10 NOT IN (3, 7))"


@register("s9_tolerant_labels", f"WITH {GOOD} SELECT batch::INTEGER AS batch, local_id::INTEGER AS local_id, count(*) AS n, 3 * count(*) AS points, round(sum(k % 9 + 3.5 + 0.5), 6) AS x FROM good GROUP BY 1, 2")
def tolerant_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files read back: a malformed line is left out, the rest of its file stays."""
    r = read_labels(spark, sf_dir, "tolerant")
    x = F.aggregate("ring", F.lit(0.0), lambda a, p: a + p["x"])
    return r.groupBy("batch", "local_id").agg(F.count("*").alias("n"), F.sum(F.size("ring")).alias("points"), F.round(F.sum(x), 6).alias("x"))


#: Targets of local ids: two are merged, one is excluded, one isn't known.
TAXONOMY = ((0, "net", False), (1, "rope", False), (2, "net", False), (3, "stone", True), (4, "float", False))
TAXONOMY_SQL = "tax(local_id, target, excluded) AS (VALUES " + ", ".join(f"({i}, '{t}', {str(e).lower()})" for i, t, e in TAXONOMY) + ")"


def taxonomy(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(TAXONOMY, "local_id int, target string, excluded boolean"))


@register("s12_ground_truth", f"WITH {GOOD}, {TAXONOMY_SQL} SELECT batch::INTEGER AS batch, target, count(*) AS n FROM good JOIN tax USING (local_id) WHERE NOT excluded GROUP BY 1, 2")
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their targets; excluded and unknown classes are dropped."""
    return read_labels(spark, sf_dir, "truth").join(taxonomy(spark), "local_id").filter("not excluded").groupBy("batch", "target").agg(F.count("*").alias("n"))


@register("s13_ignore_zones", f"WITH {GOOD}, {TAXONOMY_SQL} SELECT batch::INTEGER AS batch, target, count(*) AS n FROM good JOIN tax USING (local_id) WHERE excluded GROUP BY 1, 2")
def ignore_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of excluded classes only."""
    return read_labels(spark, sf_dir, "zones").join(taxonomy(spark), "local_id").filter("excluded").groupBy("batch", "target").agg(F.count("*").alias("n"))


@register("s14_local_names", "SELECT n_nationkey AS batch, i.unnest::INTEGER AS local_id, n_name || ' ' || (i.unnest + n_nationkey % 2) AS name FROM nation, unnest(range(0, 3)) i")
def local_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names of each batch from settings that hold them as a list or as a map from ids; both are written as JSON and read back."""
    n = table(spark, sf_dir, "nation")
    name = lambda i: F.concat("n_name", F.lit(" "), (F.lit(i) + c("n_nationkey") % 2).cast("string"))
    listed = F.to_json(F.struct(F.array(name(0), name(1), name(2)).alias("names")))
    mapped = F.to_json(F.struct(F.create_map(F.lit("0"), name(0), F.lit("1"), name(1), F.lit("2"), name(2)).alias("names")))
    path = Scratch(spark, "names").path("settings")
    n.select(c("n_nationkey").alias("batch"), F.when(c("n_nationkey") % 3 == 0, mapped).otherwise(listed).alias("value")).write.partitionBy("batch").text(path)
    return spark.read.text(path).select("batch", F.explode(labels.class_names(c("value"))).alias("e")).select(c("batch").cast("long").alias("batch"), "e.local_id", "e.name")


@register(
    "s15_taxonomy_checks",
    """WITH named AS (SELECT DISTINCT lower(p_type) AS name FROM part), alias_(name, target) AS (VALUES ('economy', 'a'), ('promo', 'b'), ('standard', 'gone'), ('old word', 'a')), targets(target) AS (VALUES ('a'), ('b'), ('c'))
    SELECT 'dangling alias' AS problem, name FROM alias_ WHERE target NOT IN (FROM targets) UNION ALL SELECT 'unreached target', target FROM targets WHERE target NOT IN (SELECT target FROM alias_) UNION ALL SELECT 'unknown name', name FROM named WHERE name NOT IN (SELECT name FROM alias_)""",
)
def taxonomy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases without a target, targets that nothing reaches, and names that no alias has."""
    alias = spark.createDataFrame([("economy", "a"), ("promo", "b"), ("standard", "gone"), ("old word", "a")], "name string, target string")
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "target string")
    named = table(spark, sf_dir, "part").select(F.lower("p_type").alias("name")).distinct()
    rows = lambda what, frame: frame.select(F.lit(what).alias("problem"), c(frame.columns[0]).alias("name"))
    return rows("dangling alias", alias.join(targets, "target", "left_anti").select("name")).union(rows("unreached target", targets.join(alias, "target", "left_anti"))).union(rows("unknown name", named.join(alias, "name", "left_anti")))


# photos

#: Photos of suppliers: some hidden, some of another kind, some without a tag, in heads as cameras write them.
HEADS = """heads AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 4 THEN '/in/.cache/' ELSE '/in/flight ' || s_nationkey || '/' END || 'DJI_' || s_suppkey || CASE WHEN s_suppkey % 8 = 5 THEN '.png' WHEN s_suppkey % 8 = 6 THEN '.JPEG' ELSE '.jpg' END AS path,
    CASE WHEN s_suppkey % 7 <> 1 THEN round(s_acctbal / 100 + 101, 2) END AS alt, CASE WHEN s_suppkey % 11 <> 2 THEN (s_suppkey * 37 % 360)::DOUBLE END AS yaw, CASE WHEN s_suppkey % 6 = 0 THEN -70.0::DOUBLE ELSE -90.0::DOUBLE END AS pitch FROM supplier),
    shown AS (SELECT * FROM heads WHERE k % 9 <> 4 AND k % 8 <> 5)"""


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content as a reader of binary files gives them."""
    s, k = table(spark, sf_dir, "supplier"), c("s_suppkey")
    folder = F.when(k % 9 == 4, "/in/.cache/").otherwise(F.concat(F.lit("/in/flight "), c("s_nationkey").cast("string"), F.lit("/")))
    suffix = F.when(k % 8 == 5, ".png").when(k % 8 == 6, ".JPEG").otherwise(".jpg")
    tag = lambda name, value, there: F.when(there, F.concat(F.lit(f' drone-dji:{name}="'), value, F.lit('"'))).otherwise("")
    xmp = F.concat(
        F.lit("\u00ff\u00d8 junk <rdf:Description"), tag("RelativeAltitude", F.format_string("%+.2f", c("s_acctbal") / 100 + 101), k % 7 != 1), tag("GimbalYawDegree", (k * 37 % 360).cast("string"), k % 11 != 2),
        tag("GimbalPitchDegree", F.when(k % 6 == 0, "-70.0").otherwise("-90.0"), F.lit(True)), tag("GpsLatitude", (c("s_nationkey") / 4).cast("string"), F.lit(True)), tag("GpsLongitude", (c("s_nationkey") / 2).cast("string"), k % 5 != 3), F.lit("/> more"),
    )
    return s.select(F.concat(folder, F.lit("DJI_"), k.cast("string"), suffix).alias("path"), xmp.cast("binary").alias("content"))


@register("s1_photo_scan", f"WITH {HEADS} SELECT path, split_part(path, '/', 4) AS name, row_number() OVER (PARTITION BY split_part(path, '/', 3) ORDER BY path) AS turn FROM shown")
def photo_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos below a folder: JPEG only, nothing hidden, in order within each folder."""
    shown = photos.shown(heads(spark, sf_dir)).select("path", F.split_part("path", F.lit("/"), F.lit(3)).alias("folder"))
    turned = ranked(shown, ["folder"], [F.asc("path")], Scratch(spark, "order"))
    return turned.select("path", photos.file_name(c("path")).alias("name"), F.col("rn").alias("turn"))


REASON = "CASE WHEN alt IS NULL THEN 'no altitude' WHEN yaw IS NULL THEN 'no heading' WHEN k % 5 = 3 THEN 'no position' WHEN abs(pitch + 90) > 15 THEN 'not vertical' END"


@register("s2_rejects_report", f"WITH {HEADS} SELECT path, {REASON} AS reason FROM shown WHERE {REASON} IS NOT NULL")
def rejects_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every photo that can't be used, with the first reason."""
    return photos.strict(photos.shown(heads(spark, sf_dir))).filter("reason is not null").select("path", "reason")


@register("s3_lenient_reader", f"WITH {HEADS} SELECT path, alt, yaw, pitch, list_filter([CASE WHEN alt IS NULL THEN 'no altitude' END, CASE WHEN yaw IS NULL THEN 'no heading' END, CASE WHEN k % 5 = 3 THEN 'no position' END, CASE WHEN abs(pitch + 90) > 15 THEN 'not vertical' END], lambda x: x IS NOT NULL) AS alerts FROM shown")
def lenient_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a photo's head tells, and an alert for all that it doesn't."""
    return photos.lenient(photos.shown(heads(spark, sf_dir))).select("path", "alt", "yaw", "pitch", "alerts")


@register("s4_strict_reader", f"WITH {HEADS} SELECT path, alt, yaw, pitch FROM shown WHERE {REASON} IS NULL")
def strict_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with all that is needed, by the adapter of their make."""
    return photos.strict(photos.shown(heads(spark, sf_dir))).filter("reason is null").select("path", "alt", "yaw", "pitch")


@register(
    "s5_positions",
    "WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey + c_custkey % 60 / 60 END AS exif, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey + c_custkey % 60 / 60 + CASE WHEN c_custkey % 5 = 0 THEN 0.01 ELSE 0.0001 END END AS xmp FROM customer) SELECT k, round(coalesce(exif, xmp), 7) AS lat, coalesce(abs(exif - xmp) > 0.001, false) AS differ FROM p WHERE exif IS NOT NULL OR xmp IS NOT NULL",
)
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions: the camera's own (degrees and minutes) before those of the attributes, with a warning where they differ."""
    k = c("c_custkey")
    t = table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 3 != 0, c("c_nationkey")).alias("degrees"), (k % 60).alias("minutes"), F.when(k % 4 != 0, c("c_nationkey") + k % 60 / 60 + F.when(k % 5 == 0, 0.01).otherwise(0.0001)).alias("xmp"))
    lat, differ = photos.preferred(photos.dms(c("degrees"), c("minutes"), F.lit(0), F.lit("N")), c("xmp"))
    return t.select("k", F.round(lat, 7).alias("lat"), differ.alias("differ")).filter("lat is not null")


@register("s6_attributes", f"WITH {HEADS} SELECT path, 2 + (alt IS NOT NULL)::INTEGER + (yaw IS NOT NULL)::INTEGER + (k % 5 <> 3)::INTEGER AS attributes, pitch FROM shown")
def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attributes of a head as a map."""
    m = photos.shown(heads(spark, sf_dir)).select("path", labels.xmp_attributes(photos.head(c("content"))).alias("m"))
    return m.select("path", F.size("m").alias("attributes"), F.try_element_at("m", F.lit("drone-dji:GimbalPitchDegree")).try_cast("double").alias("pitch"))


@register("s7_parents_of_batches", f"WITH {PATHS} SELECT split_part(path, '/', 1) AS batch, translate(regexp_replace(path, '\\.[^./\\\\]*$', ''), '/\\ ', '___') AS parent_id FROM paths")
def parents_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first folder of an annotated image is its batch."""
    return paths(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("batch"), keys.parent_id(c("path")).alias("parent_id"))


@register(
    "s8_label_companions",
    f"WITH {PATHS}, b AS (SELECT k, path, regexp_replace(path, '\\.[^./]*$', '.txt') AS beside FROM paths), m AS (SELECT *, replace(beside, '/images/', '/labels/') AS mirrored FROM b) SELECT k, CASE WHEN k % 4 = 0 THEN beside WHEN k % 4 <> 3 THEN mirrored END AS label FROM m",
)
def label_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label file of an image: beside it, else in the mirrored folder, else none."""
    p = paths(spark, sf_dir).withColumn("beside", labels.beside(c("path"))).withColumn("mirrored", labels.mirrored(c("path")))
    there = p.filter("k % 4 = 0").select(c("beside").alias("file")).union(p.filter("k % 4 <> 3").select("mirrored")).distinct()
    a, b = there.select(c("file").alias("beside"), F.lit(True).alias("first")), there.select(c("file").alias("mirrored"), F.lit(True).alias("second"))
    return p.join(a, "beside", "left").join(b, "mirrored", "left").select("k", F.when(c("first"), c("beside")).when(c("second"), c("mirrored")).alias("label"))


# detections

SOME = f"{DETECTIONS}, sized AS (SELECT *, photo_idx % 4 AS lot FROM detections)"


def detection_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """GeoJSON features of detections, a folder for each of four lots; those of even lots name their photo."""
    d = detections(spark, sf_dir).withColumn("lot", c("photo_idx") % 4)
    at = lambda x, y: F.struct((c("k") + x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    d = d.select("lot", "det_id", "class_name", "confidence", "area_m2", F.when(c("lot") % 2 == 0, c("photo_idx")).alias("source_photo"), F.array(at(0, 0), at(1, 0), at(1, 1)).alias("ring"))
    path = Scratch(spark, name).path("found")
    labels.write_geojson_lines(d, path, by="lot")
    return path


@register("s16_geojson_reader", f"WITH {SOME} SELECT lot::INTEGER AS lot, CASE WHEN lot % 2 = 0 THEN 'batch' ELSE 'ortho' END AS mode, class_name, count(*) AS n, round(sum(confidence), 4) AS confidence FROM sized GROUP BY 1, 2, 3")
def geojson_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections read back, by lot; a lot is a batch if any feature names its photo."""
    r = labels.geojson_lines(spark, detection_folder(spark, sf_dir, "geojson"), by="lot")
    return r.groupBy("lot", "mode", "class_name").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@register("s17_strict_geojson", f"WITH {SOME} SELECT class_name, count(*) AS n, round(sum(area_m2), 4) AS area FROM sized GROUP BY 1")
def strict_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict reader: a feature that is no polygon would be an error."""
    r = labels.geojson_lines(spark, detection_folder(spark, sf_dir, "strict"), strict=True, by="lot")
    return r.groupBy("class_name").agg(F.count("*").alias("n"), F.round(F.sum("area_m2"), 4).alias("area"))


@register(
    "s18_run_reports",
    "SELECT o_custkey AS run, max(o_totalprice) AS best, arg_max(o_orderkey, [o_totalprice, -o_orderkey::DOUBLE]) AS epoch, 'm' || o_custkey % 3 AS model FROM orders GROUP BY o_custkey",
)
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of runs as CSV and their settings as JSON, written and read back, joined by run."""
    scratch, o = Scratch(spark, "runs"), table(spark, sf_dir, "orders")
    labels.write_sheet(o.select(c("o_custkey").alias("run"), c("o_orderkey").alias("epoch"), c("o_totalprice").alias("metric")), scratch.path("results"))
    o.select(c("o_custkey").alias("run"), F.concat(F.lit("m"), (c("o_custkey") % 3).cast("string")).alias("model")).distinct().write.json(scratch.path("settings"))
    results = spark.read.option("header", True).option("sep", ";").schema("run long, epoch long, metric double").csv(scratch.path("results"))
    best = results.groupBy("run").agg(F.max("metric").alias("best"), F.max_by("epoch", F.struct("metric", -c("epoch"))).alias("epoch"))
    return best.join(spark.read.schema("run long, model string").json(scratch.path("settings")), "run").select("run", "best", "epoch", "model")


@register("s19_run_discovery", "SELECT c_custkey AS run, count(o_orderkey) AS results, count(o_orderkey) > 0 AS reported FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def run_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs, with or without a report: none is dropped."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("run")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("run")).join(done, "run", "left").select("run", n.alias("results"), (n > 0).alias("reported"))


@register("s23_model_registry", "WITH r(kind, model, active) AS (VALUES ('ECONOMY', 'nano', true), ('PROMO', 'small', true), ('STANDARD', 'old', false)) SELECT p_partkey, coalesce(model, 'default') AS model FROM part LEFT JOIN r ON kind = p_type AND active")
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operational model of each kind; what has none takes the default."""
    r = spark.createDataFrame([("ECONOMY", "nano", True), ("PROMO", "small", True), ("STANDARD", "old", False)], "p_type string, model string, active boolean").filter("active")
    return table(spark, sf_dir, "part").join(F.broadcast(r), "p_type", "left").select("p_partkey", F.coalesce("model", F.lit("default")).alias("model"))


# sinks


@register(
    "k1_survey_export",
    f"WITH {SOME} SELECT 'features' AS file, count(*) AS n, round(sum(confidence), 3) AS total FROM sized UNION ALL SELECT 'sheet', count(*), round(sum(confidence), 3) FROM detections UNION ALL SELECT 'summary', count(DISTINCT class_name), round(sum(confidence), 3) FROM detections UNION ALL SELECT 'parameters', 2, 0.85",
)
def survey_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, a sheet, a summary and the parameters of a survey, written and read back."""
    scratch, d = Scratch(spark, "export"), detections(spark, sf_dir)
    features = detection_folder(spark, sf_dir, "export-features")
    labels.write_sheet(d.select("det_id", "class_name", "confidence"), scratch.path("sheet"))
    d.groupBy("class_name").agg(F.count("*").alias("n"), F.sum("confidence").alias("total")).write.json(scratch.path("summary"))
    spark.createDataFrame([("iou", 0.25), ("confidence", 0.6)], "name string, value double").write.json(scratch.path("parameters"))
    count = lambda name, rows, value: rows.agg(F.count("*").alias("n"), F.round(F.sum(value), 3).alias("total")).select(F.lit(name).alias("file"), "n", "total")
    sheet = spark.read.option("header", True).option("sep", ";").schema("det_id long, class_name string, confidence double").csv(scratch.path("sheet"))
    return (
        count("features", labels.geojson_lines(spark, features, by="lot"), "confidence").union(count("sheet", sheet, "confidence"))
        .union(count("summary", spark.read.schema("class_name string, n long, total double").json(scratch.path("summary")), "total")).union(count("parameters", spark.read.schema("name string, value double").json(scratch.path("parameters")), "value"))
    )


@register("k2_footprint_export", f"WITH {OWNED} SELECT f.id, count(gx) * 10000.0::DOUBLE AS area FROM f LEFT JOIN owned o ON o.id = f.id GROUP BY 1")
def footprint_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints with the ground they own, as GeoJSON, read back."""
    path = Scratch(spark, "footprints").path("features")
    cells = owned_cells(spark, sf_dir).groupBy("id").agg((F.count("*") * 10000.0).alias("area_m2"))
    p = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    f = footprints(spark, sf_dir).join(cells, "id", "left").select("id", F.coalesce("area_m2", F.lit(0.0)).alias("area_m2"), F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")).alias("ring"))
    labels.write_geojson_lines(f, path)
    return labels.geojson_lines(spark, path).select(c("properties")["id"].try_cast("long").alias("id"), c("area_m2").alias("area"))


@register("k3_light_export", f"WITH {BOXES} SELECT det_id AS id, 4 AS points, round((x1 - x0) * (y1 - y0), 3) AS area, 2 AS keys FROM boxes")
def light_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A light copy for display: simplified outlines and two properties only."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, x1, y0, y1 = c("x0"), c("x1"), c("y0"), c("y1")
    b = boxes(spark, sf_dir).withColumn("ring", F.array(p(x0, y0), p((x0 + x1) / 2, y0), p(x1, y0), p(x1, y1), p((x0 + x1) / 2, y1 + 1e-9), p(x0, y1)))
    path = Scratch(spark, "light").path("features")
    labels.write_geojson_lines(b.select("det_id", "confidence", geometry.simplify(c("ring"), 1e-6).alias("ring")), path)
    r = labels.geojson_lines(spark, path)
    return r.select(c("properties")["det_id"].try_cast("long").alias("id"), F.size("ring").alias("points"), F.round(geometry.ring_area(c("ring")), 3).alias("area"), F.size("properties").alias("keys"))


@register("k4_workbook", f"WITH {WEIGHED} SELECT 'classes' AS sheet, count(DISTINCT class_name) AS n FROM weighed UNION ALL SELECT 'photos', count(DISTINCT photo_idx) FROM weighed UNION ALL SELECT 'detections', count(*) FROM weighed")
def workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook as a folder with a sheet for each table."""
    w, scratch = weighed(spark, sf_dir), Scratch(spark, "workbook")
    sheets = {"classes": w.groupBy("class_name").count(), "photos": w.groupBy("photo_idx").count(), "detections": w.select("det_id", "confidence")}
    labels.write_workbook(sheets, scratch.path("book"))
    return labels.read_workbook(spark, scratch.path("book")).groupBy("sheet").agg(F.count("*").alias("n"))


@register("k5_label_lots", f"WITH {DETECTIONS} SELECT lot::INTEGER AS lot, count(*) AS n, sum(local_id)::BIGINT AS ids FROM (SELECT (photo_idx % 5)::INTEGER AS lot, k % 6 AS local_id FROM detections) GROUP BY 1")
def label_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels dealt to lots, a folder of label files for each, read back by the label reader."""
    d = detections(spark, sf_dir)
    line = F.concat_ws(" ", (c("k") % 6).cast("string"), F.lit("0 0 1 0 1 1"))
    path = Scratch(spark, "lots").path("labels")
    d.select((c("photo_idx") % 5).cast("int").alias("lot"), line.alias("value")).write.partitionBy("lot").text(path)
    return labels.label_lines(spark.read.text(path), "value").groupBy("lot").agg(F.count("*").alias("n"), F.sum(c("local_id").cast("long")).alias("ids"))


@register("k6_latest_snapshot", "SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version kept under its name, and the same as the latest, which replaces an earlier one."""
    scratch, o = Scratch(spark, "snapshots"), table(spark, sf_dir, "orders")
    labels.write_snapshot(o.filter("o_orderstatus = 'F'").groupBy(c("o_orderpriority").alias("k")).agg(F.count("*").alias("n")), scratch.path("history"), "first")
    labels.write_snapshot(o.groupBy(c("o_orderpriority").alias("k")).agg(F.count("*").alias("n")), scratch.path("history"), "second")
    return spark.read.option("header", True).option("sep", ";").schema("k string, n long").csv(f"{scratch.path('history')}/latest")


@register("k8_long_runs", "SELECT l_returnflag || l_linestatus AS run, 'q' AS metric, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag || l_linestatus, 'd', round(sum(l_discount), 2) FROM lineitem GROUP BY 1")
def long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows of runs as a long sheet, read back."""
    wide = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("run")).agg(F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"))
    path = Scratch(spark, "long-runs").path("sheet")
    labels.write_sheet(wide.unpivot("run", ["q", "d"], "metric", "value"), path)
    return spark.read.option("header", True).option("sep", ";").schema("run string, metric string, value double").csv(path).select("run", "metric", F.round("value", 2).alias("value"))


@register("k9_review_manifest", f"WITH {DETECTIONS} SELECT det_id, class_name, 'review/' || class_name || '/' || det_id || '.png' AS picture FROM detections WHERE confidence < 0.5")
def review_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be looked at, with the place of its picture, as a sheet that is read back."""
    d = detections(spark, sf_dir).filter("confidence < 0.5")
    path = Scratch(spark, "review").path("sheet")
    labels.write_sheet(d.select("det_id", "class_name", F.concat(F.lit("review/"), "class_name", F.lit("/"), c("det_id").cast("string"), F.lit(".png")).alias("picture")), path)
    return spark.read.option("header", True).option("sep", ";").schema("det_id long, class_name string, picture string").csv(path)


@register("k13_appended_labels", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'first' ELSE 'second' END AS written FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '5-LOW'")
def appended_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes to one folder: the second appends only what isn't there."""
    path, o = Scratch(spark, "appended").path("rows"), table(spark, sf_dir, "orders")
    o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("first").alias("written")).write.parquet(path)
    labels.append_missing(o.filter("o_orderstatus = 'F' or o_orderpriority = '5-LOW'").select("o_orderkey", F.lit("second").alias("written")), path, ["o_orderkey"])
    return spark.read.parquet(path)


#: Photos of customers, as their cameras write them: two makes and an unknown one, both byte orders, some heads damaged.
CAMERAS = """cameras AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'DJI' WHEN 1 THEN 'senseFly' ELSE CASE WHEN c_custkey % 4 = 2 THEN NULL ELSE 'Other' END END AS make, CASE WHEN c_custkey % 5 <> 4 THEN round(c_nationkey - 12.5 + c_custkey % 3600 / 3600, 6) END AS lat,
        round(c_custkey % 300 - 150.25, 6) AS lon, CASE WHEN c_custkey % 13 <> 6 THEN (8 + c_custkey % 7 / 10) END AS focal, 4000 + c_custkey % 9 AS width, 3000 + c_custkey % 8 AS height, CASE WHEN c_custkey % 17 = 8 THEN 6 ELSE 1 END AS turned,
        CASE WHEN c_custkey % 11 <> 3 THEN 40 + c_custkey % 50 END AS alt, c_custkey * 7 % 360 AS yaw, CASE c_custkey % 23 WHEN 3 THEN 'no JPEG' WHEN 7 THEN 'cut short' WHEN 9 THEN 'no Exif' WHEN 5 THEN 'damaged directory' END AS damage FROM customer)"""


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content."""
    k = c("c_custkey")
    t = table(spark, sf_dir, "customer").select(
        k.alias("k"), F.when(k % 3 == 0, "DJI").when(k % 3 == 1, "senseFly").otherwise(F.when(k % 4 != 2, "Other")).alias("make"), F.when(k % 5 != 4, F.round(c("c_nationkey") - 12.5 + k % 3600 / 3600, 6)).alias("lat"), F.round(k % 300 - 150.25, 6).alias("lon"),
        F.when(k % 13 != 6, 8 + k % 7 / 10).alias("focal"), (4000 + k % 9).alias("width"), (3000 + k % 8).alias("height"), F.when(k % 17 == 8, 6).otherwise(1).alias("turned"), F.when(k % 11 != 3, 40 + k % 50).alias("alt"), (k * 7 % 360).alias("yaw"),
    )
    tag = lambda name, value: F.coalesce(F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"')), F.lit(""))
    dji = F.concat(tag("drone-dji:RelativeAltitude", c("alt")), tag("drone-dji:GimbalYawDegree", c("yaw")), tag("drone-dji:GimbalPitchDegree", F.lit(-90)))
    camera = F.concat(tag("Camera:AboveGroundAltitude", c("alt")), tag("Camera:Yaw", c("yaw")), tag("Camera:Pitch", F.lit(5)))
    also = F.when(c("k") % 4 == 1, F.concat(tag("drone-dji:GpsLatitude", c("k") % 80), tag("drone-dji:GpsLongitude", c("k") % 90))).otherwise("")
    xmp = F.concat(F.lit("<x:xmpmeta"), F.when(c("make") == "senseFly", camera).otherwise(dji), also, F.lit("/>"))
    whole = written_heads(c("make"), F.lit("M1"), c("focal"), c("lat"), c("lon"), c("width"), c("height"), xmp, c("k") % 2 == 0, c("turned"))
    rest = F.expr("substring(whole, 1, 60)"), F.expr("concat(substring(whole, 1, 2), X'FFE00004', X'0000', X'FFD9')"), F.expr("concat(substring(whole, 1, 16), X'FFFFFFFF', substring(whole, 21, length(whole)))"), F.expr("substring(whole, 2, length(whole))")
    kind = c("k") % 23
    content = F.when(kind == 3, rest[3]).when(kind == 7, rest[0]).when(kind == 9, rest[1]).when(kind == 5, rest[2]).otherwise(c("whole"))
    return t.withColumn("whole", whole).select(F.concat(F.lit("/in/P"), c("k").cast("string"), F.lit(".jpg")).alias("path"), content.alias("content"))


@register(
    "s4_photo_heads",
    f"""WITH {CAMERAS}, placed AS (SELECT *, CASE WHEN lat IS NOT NULL THEN lat WHEN k % 4 = 1 THEN k % 80 END AS la, CASE WHEN lat IS NOT NULL THEN lon WHEN k % 4 = 1 THEN k % 90 END AS lo, make IN ('DJI', 'senseFly') AS known FROM cameras)
    SELECT '/in/P' || k || '.jpg' AS path, CASE WHEN damage IS NULL THEN make END AS make, CASE WHEN damage IS NULL THEN width END AS width, CASE WHEN damage IS NULL THEN height END AS height, CASE WHEN damage IS NULL THEN round(focal, 3) END AS focal_mm, CASE WHEN damage IS NULL THEN round(la, 6) END AS lat,
        CASE WHEN damage IS NULL THEN round(lo, 6) END AS lon, CASE WHEN damage IS NULL AND known THEN alt::DOUBLE END AS alt, CASE WHEN damage IS NULL AND known THEN yaw::DOUBLE END AS yaw, CASE WHEN damage IS NULL AND known THEN CASE make WHEN 'DJI' THEN -90.0::DOUBLE ELSE -85.0::DOUBLE END END AS pitch,
        damage IS NULL AND lat IS NOT NULL AND k % 4 = 1 AND (abs(lat - k % 80) > 0.001 OR abs(lon - k % 90) > 0.001) AS differ,
        CASE WHEN damage IS NOT NULL THEN damage WHEN turned <> 1 THEN 'turned' WHEN make IS NULL THEN 'no make or model' WHEN focal IS NULL THEN 'no focal length' WHEN la IS NULL THEN 'no position' WHEN NOT known THEN 'unknown make' WHEN alt IS NULL THEN 'no altitude' END AS reason FROM placed""",
)
def photo_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is needed to place a photo, from the bytes of its head, or why it can't be placed."""
    found = photos.from_heads(cameras(spark, sf_dir))
    return found.select("path", "make", c("width").cast("long").alias("width"), c("height").cast("long").alias("height"), *[F.round(n, k).alias(n) for n, k in (("focal_mm", 3), ("lat", 6), ("lon", 6))], "alt", "yaw", "pitch", "differ", "reason")
