"""Class lists, runs, benches and tiles: queries of single operators about records and settings (G*, M*, T*, X* of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import geodesy
from tidemark.operators import manifest, tiling
from tidemark.operators.counter_scan import counted
from tidemark.operators.order_stats import with_quantiles
from tidemark.operators.running import in_parts, running
from tidemark.plans.registry import register, table
from tidemark.plans.surveys import BOXES, DETECTIONS, PARENTS, PHOTOS, boxes, detections, parents, photos
from tidemark.scratch import Scratch

c = F.col

#: Classes in the order of their settings; one is excluded.
OPTIONS = (("view", False), ("click", False), ("error", True), ("purchase", False), ("signup", False))
OPTIONS_SQL = "options(seq, class_name, excluded) AS (VALUES " + ", ".join(f"({i}, '{n}', {str(e).lower()})" for i, (n, e) in enumerate(OPTIONS)) + ")"


def options(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(i, *o) for i, o in enumerate(OPTIONS)], "seq int, class_name string, excluded boolean"))


@register("m2_class_options", f"WITH {DETECTIONS}, {OPTIONS_SQL}, n AS (SELECT class_name, count(*) AS n FROM detections GROUP BY 1) SELECT row_number() OVER (ORDER BY seq) AS turn, class_name, coalesce(n, 0) AS n FROM options LEFT JOIN n USING (class_name) WHERE NOT excluded")
def class_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes to choose from, in their order, without excluded ones, and how often each is there."""
    n = detections(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("n"))
    rows = options(spark).filter("not excluded").join(n, "class_name", "left")
    return rows.select(F.row_number().over(Window.orderBy("seq")).alias("turn"), "class_name", F.coalesce("n", F.lit(0)).alias("n"))


@register(
    "m3_predicted_first",
    f"WITH {DETECTIONS}, {OPTIONS_SQL}, a AS (SELECT det_id, o.class_name, row_number() OVER (PARTITION BY det_id ORDER BY (o.class_name <> d.class_name), seq) AS turn FROM detections d CROSS JOIN options o WHERE confidence >= 0.9 AND NOT excluded) SELECT det_id, string_agg(class_name, ',' ORDER BY turn) AS listed FROM a GROUP BY 1",
)
def predicted_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options for each detection: its own class first, then in their order. The list is a constant of a few names."""
    names = [n for n, e in OPTIONS if not e]
    listed = F.array(*map(F.lit, names))
    first = F.when(c("class_name").isin(*names), F.array("class_name")).otherwise(F.array().cast("array<string>"))
    return detections(spark, sf_dir).filter("confidence >= 0.9").select("det_id", F.array_join(F.concat(first, F.array_remove(listed, c("class_name"))), ",").alias("listed"))


@register("m11_taxonomy_of_run", "SELECT c_custkey AS run, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'runs/' || c_custkey || '/taxonomy.yaml' END, CASE WHEN c_custkey % 2 = 0 THEN 'config/' || lower(c_mktsegment) || '.yaml' END, 'config/default.yaml') AS path FROM customer")
def taxonomy_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class settings a run was trained with: its own copy, else those its report names, else the default."""
    k = c("c_custkey")
    own, named = F.when(k % 3 == 0, F.concat(F.lit("runs/"), k.cast("string"), F.lit("/taxonomy.yaml"))), F.when(k % 2 == 0, F.concat(F.lit("config/"), F.lower("c_mktsegment"), F.lit(".yaml")))
    return table(spark, sf_dir, "customer").select(k.alias("run"), F.coalesce(own, named, F.lit("config/default.yaml")).alias("path"))


@register(
    "m13_differences_to_baseline",
    """WITH r AS (SELECT o_orderkey AS run, map {'year': year(o_orderdate)::VARCHAR, 'priority': o_orderpriority, 'status': o_orderstatus} AS p FROM orders), b AS (SELECT arg_min(p, run) AS base FROM r), k AS (SELECT unnest(['year', 'priority', 'status']) AS key)
    SELECT run, key, base[key] AS baseline, p[key] AS value FROM r CROSS JOIN b CROSS JOIN k WHERE base[key] <> p[key]""",
)
def differences_to_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each run that differ from the first run's."""
    names = {"year": F.year("o_orderdate").cast("string"), "priority": c("o_orderpriority"), "status": c("o_orderstatus")}
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("run"), F.create_map(*[x for k, v in names.items() for x in (F.lit(k), v)]).alias("p"))
    base = o.agg(F.min_by("p", "run").alias("base"))  # one row
    each = o.join(F.broadcast(base)).select("run", "base", F.explode("p").alias("key", "value"))
    return each.filter(c("base")[c("key")] != c("value")).select("run", "key", c("base")[c("key")].alias("baseline"), "value")


@register(
    "m14_seen_parents",
    f"WITH {PARENTS}, s AS (SELECT parent_id, CASE WHEN parent_id % 4 < 2 THEN 'train' WHEN parent_id % 4 = 2 THEN 'val' ELSE 'test' END AS split, parent_id % 3 = 0 AS own FROM parents) SELECT parent_id, split, CASE WHEN own THEN 'report' ELSE 'manifest' END AS source FROM s WHERE split IN ('train', 'val')",
)
def seen_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model has seen, by its report where there is one, else by the manifest."""
    k = c("parent_id")
    split = F.when(k % 4 < 2, "train").when(k % 4 == 2, "val").otherwise("test")
    p = parents(spark, sf_dir).select("parent_id", split.alias("split"))
    report = p.filter("parent_id % 3 = 0").select("parent_id", c("split").alias("reported"), F.lit("report").alias("source"))
    both = p.join(report, "parent_id", "left").withColumn("split", F.coalesce("reported", "split"))
    return both.filter(c("split").isin("train", "val")).select("parent_id", "split", F.coalesce("source", F.lit("manifest")).alias("source"))


@register("m19_missing_copies", "SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 30")
def missing_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass-through step still has to copy."""
    there = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(c("l_orderkey").alias("id")).distinct()
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id")).join(there, "id", "left_anti")


@register(
    "m20_settings_overlay",
    "WITH d AS (SELECT DISTINCT p_type AS key, 1 AS value FROM part), o AS (SELECT p_brand AS key, max(p_size) AS value FROM part GROUP BY 1 UNION ALL SELECT p_type, max(p_size) FROM part WHERE p_size < 20 GROUP BY 1) SELECT coalesce(d.key, o.key) AS key, coalesce(o.value, d.value)::INTEGER AS value, d.key IS NULL AS unknown FROM d FULL JOIN o ON o.key = d.key",
)
def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, replaced by what was given; a key that no default has is marked, for the caller to refuse."""
    p = table(spark, sf_dir, "part")
    default = p.select(c("p_type").alias("key"), F.lit(1).alias("standard")).distinct()
    given = p.groupBy(c("p_brand").alias("key")).agg(F.max("p_size").alias("given")).union(p.filter("p_size < 20").groupBy("p_type").agg(F.max("p_size")))
    return default.join(given, "key", "full").select("key", F.coalesce("given", "standard").cast("int").alias("value"), c("standard").isNull().alias("unknown"))


@register(
    "m21_bench_selection",
    f"WITH {PARENTS}, listed AS (SELECT upper(batch || '/' || parent_id) AS name FROM parents WHERE parent_id % 50 = 7 UNION SELECT 'nowhere'), byname AS (SELECT name, p.parent_id FROM listed LEFT JOIN parents p ON lower(name) = lower(p.batch || '/' || p.parent_id)), whole AS (SELECT batch || '/' || parent_id AS name, parent_id FROM parents WHERE batch = 'EN src3') SELECT parent_id, name, parent_id IS NULL AS missing FROM byname UNION SELECT parent_id, name, false FROM whole",
)
def bench_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bench by hand: listed images, whatever the case, and a whole batch; what isn't found is marked, as then nothing is frozen."""
    p = parents(spark, sf_dir).select("parent_id", "batch", F.concat("batch", F.lit("/"), c("parent_id").cast("string")).alias("full"))
    listed = p.filter("parent_id % 50 = 7").select(F.upper("full").alias("name")).union(spark.createDataFrame([("nowhere",)], "name string"))
    byname = listed.join(p.select("parent_id", F.lower("full").alias("low")), F.lower("name") == c("low"), "left").select("parent_id", "name", c("parent_id").isNull().alias("missing"))
    return byname.union(p.filter("batch = 'EN src3'").select("parent_id", c("full").alias("name"), F.lit(False))).distinct()


@register("m22_frozen_split", f"WITH {PARENTS} SELECT batch, count(*) AS n, min(parent_id) AS first FROM parents WHERE parent_id % 4 = 3 GROUP BY 1")
def frozen_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current test split as the bench, by batch."""
    return parents(spark, sf_dir).filter("parent_id % 4 = 3").groupBy("batch").agg(F.count("*").alias("n"), F.min("parent_id").alias("first"))


@register("m24_resolved_and_raw", f"WITH {DETECTIONS}, {OPTIONS_SQL} SELECT photo_idx, count(*) AS raw, count(*) FILTER (excluded = false) AS resolved FROM detections LEFT JOIN options USING (class_name) GROUP BY 1")
def resolved_and_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each image, all and those of a class that counts."""
    d = detections(spark, sf_dir).join(options(spark), "class_name", "left")
    return d.groupBy("photo_idx").agg(F.count("*").alias("raw"), F.count_if(~c("excluded")).alias("resolved"))


@register("m25_hard_negatives", f"WITH {DETECTIONS}, {OPTIONS_SQL} SELECT det_id, photo_idx FROM detections JOIN options USING (class_name) WHERE excluded")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of excluded classes, of which tiles are cut that must stay empty."""
    return detections(spark, sf_dir).join(options(spark).filter("excluded"), "class_name").select("det_id", "photo_idx")


@register(
    "m26_tile_categories",
    f"WITH {DETECTIONS}, {OPTIONS_SQL}, t AS (SELECT photo_idx, k // 10 AS tile, bool_or(NOT coalesce(excluded, true)) AS pos, bool_or(coalesce(excluded, false)) AS hard FROM detections LEFT JOIN options USING (class_name) GROUP BY 1, 2), a AS (SELECT p.photo_idx, i.unnest AS tile FROM (SELECT DISTINCT photo_idx FROM detections) p, unnest(range(0, 10)) i) SELECT CASE WHEN pos THEN 'pos' WHEN hard THEN 'hard' ELSE 'empty' END AS category, count(*) AS n FROM a LEFT JOIN t USING (photo_idx, tile) GROUP BY 1",
)
def tile_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with objects, with excluded ones only, and without any; each photo has ten."""
    d = detections(spark, sf_dir).join(options(spark), "class_name", "left").groupBy("photo_idx", F.floor(c("k") / 10).alias("tile"))
    t = d.agg(F.bool_or(~F.coalesce("excluded", F.lit(True))).alias("pos"), F.bool_or(F.coalesce("excluded", F.lit(False))).alias("hard"))
    all_ = detections(spark, sf_dir).select("photo_idx").distinct().withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    kind = F.when(c("pos"), "pos").when(c("hard"), "hard").otherwise("empty")
    return all_.join(t, ["photo_idx", "tile"], "left").groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


@register("m32_alignment_diagnostic", "SELECT l_suppkey % 10 AS block, round(median(l_extendedprice / 1000), 4) AS mid, round(quantile_cont(l_extendedprice / 1000, 0.9), 4) AS p90, round(max(l_extendedprice / 1000), 4) AS top FROM lineitem GROUP BY 1")
def alignment_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((c("l_suppkey") % 10).alias("block"), (c("l_extendedprice") / 1000).alias("r"))
    by = rows.groupBy("block").agg(F.round(F.max("r"), 4).alias("top"))
    by = with_quantiles(by, rows, ["block"], {"mid": ("r", 0.5), "p90": ("r", 0.9)}, Scratch(spark, "medians"))
    return by.withColumns({k: F.round(k, 4) for k in ("mid", "p90")})


@register(
    "g6_kept_tiles",
    """WITH t AS (SELECT l_orderkey AS parent, l_linenumber AS tile, l_quantity > 25 AS object FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity)),
    b AS (SELECT *, NOT bool_or(object) OVER (PARTITION BY parent) AS bare, coalesce(sum(object::INTEGER) OVER (PARTITION BY parent ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        row_number() OVER (PARTITION BY parent, object ORDER BY tile) AS nth FROM t)
    SELECT parent, count(*) AS tiles, sum(CASE WHEN object OR bare OR (before = 0 AND nth = 1) THEN 1 ELSE 0 END)::BIGINT AS kept FROM b GROUP BY 1""",
)
def kept_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older slicer: an empty tile is kept where the number kept so far is a multiple of ten, or its parent has no objects.

    A parent has seven tiles at most here; of its empty ones then only one before the first object is kept: the number
    kept is a multiple of ten only as long as it is 0.
    """
    t = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("parent"), c("l_linenumber").alias("tile")).agg((F.min("l_quantity") > 25).alias("object"))
    tiles = F.sort_array(F.collect_list(F.struct("tile", "object")))  # of one parent
    by = t.groupBy("parent").agg(tiles.alias("tiles"), (~F.bool_or("object")).alias("bare"))
    kept = F.aggregate("tiles", F.lit(0).cast("long"), lambda n, x: n + F.when(x["object"] | c("bare") | (n % 10 == 0), 1).otherwise(0))
    return by.select("parent", F.size("tiles").cast("long").alias("tiles"), kept.alias("kept"))


@register("g12_cache_decisions", f"WITH {PARENTS} SELECT parent_id, CASE WHEN parent_id % 5 <> 2 THEN 'reuse' WHEN parent_id % 3 = 0 THEN 'rebuild' ELSE 'refuse' END AS decision FROM parents")
def cache_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached result is used again if its fingerprint is the same, built anew if that is forced, else refused."""
    k, now = c("parent_id"), F.md5(F.concat("batch", c("weight").cast("string")).cast("binary"))
    p = parents(spark, sf_dir).select("parent_id", now.alias("now"), F.when(k % 5 == 2, F.lit("old")).otherwise(now).alias("cached"), (k % 3 == 0).alias("forced"))
    return p.select("parent_id", manifest.cache_decision(c("now"), c("cached"), c("forced")).alias("decision"))


@register(
    "x1_tile_predictor",
    """WITH s AS (SELECT p_partkey, 400 + p_size * 90 AS w, 300 + p_size * 61 AS h FROM part), x AS (SELECT DISTINCT p_partkey, greatest(0, least(i.unnest, w - 640)) AS x0 FROM s, unnest(range(0, greatest(w, 1), 384)) i), y AS (SELECT DISTINCT p_partkey, greatest(0, least(i.unnest, h - 640)) AS y0 FROM s, unnest(range(0, greatest(h, 1), 384)) i)
    SELECT p_partkey, x0::BIGINT AS x0, y0::BIGINT AS y0, 'spot' AS class_name, round(0.5 + ((x0 + y0) % 50) / 100, 2) AS confidence, 4 AS points FROM x JOIN y USING (p_partkey) WHERE (x0 + y0) % 3 = 0""",
)
def tile_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictor hook over windows: any function from windows to detections, here a fake that finds a square in every third."""
    s = table(spark, sf_dir, "part").select("p_partkey", (400 + c("p_size") * 90).alias("w"), (300 + c("p_size") * 61).alias("h"))
    tiles = tiling.windows(s, "w", "h", 640, 384).select("p_partkey", "x0", "y0").distinct()

    def fake(x0: int, y0: int):
        if (x0 + y0) % 3 == 0:
            yield "spot", round(0.5 + (x0 + y0) % 50 / 100, 2), [(x0, y0), (x0 + 9, y0), (x0 + 9, y0 + 9), (x0, y0 + 9)]

    found = tiling.predicted(tiles, "p_partkey", fake)
    return found.select("p_partkey", "x0", "y0", "class_name", "confidence", F.size("ring").alias("points"))


#: Fixed values of WGS 84 and of the transverse Mercator series.
UTM_SQL = f"""WITH {PHOTOS}, p AS (SELECT photo_idx, lat, lon, trunc((lon + 180) / 6) + 1 AS zone FROM photos WHERE lon IS NOT NULL),
    a AS (SELECT *, radians(lat) AS f, radians(lon - (zone * 6 - 183)) AS l, 1 / (2 * 298.257223563 - 1) AS n FROM p), b AS (SELECT *, 2 * sqrt(n) / (1 + n) AS e FROM a), t AS (SELECT *, sinh(atanh(sin(f)) - e * atanh(e * sin(f))) AS tt FROM b),
    x AS (SELECT *, atan2(tt, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + tt * tt)) AS et, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3, 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS r FROM t)
    SELECT photo_idx, zone::INTEGER AS zone, round(500000 + 0.9996 * r * (et + a1 * cos(2 * xi) * sinh(2 * et) + a2 * cos(4 * xi) * sinh(4 * et) + a3 * cos(6 * xi) * sinh(6 * et)), 3) AS east,
    round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + 0.9996 * r * (xi + a1 * sin(2 * xi) * cosh(2 * et) + a2 * sin(4 * xi) * cosh(4 * et) + a3 * sin(6 * xi) * cosh(6 * et)), 3) AS north FROM x"""


@register("f20_utm_coordinates", UTM_SQL)
def utm_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos in metres of their UTM zone; tests take them back to degrees."""
    p = photos(spark, sf_dir).filter("lon is not null")
    zone = geodesy.utm_zone(c("lon"))
    east, north = geodesy.to_utm(c("lon"), c("lat"), zone)
    return p.select("photo_idx", zone.alias("zone"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@register("t2_exact_grid", "WITH s AS (SELECT p_partkey, 4000 + p_size * 190 AS w, p_size % 5 + 2 AS n FROM part) SELECT p_partkey, i.unnest::INTEGER AS piece, round(w * i.unnest / n)::BIGINT AS low, round(w * (i.unnest + 1) / n)::BIGINT AS high FROM s, unnest(range(0, n)) i")
def exact_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of a side whose rounded bounds leave no gap."""
    s = table(spark, sf_dir, "part").select("p_partkey", (4000 + c("p_size") * 190).alias("w"), (c("p_size") % 5 + 2).alias("n"))
    each = s.withColumn("piece", F.explode(F.sequence(F.lit(0), c("n") - 1)))
    at = lambda k: F.round(c("w") * k / c("n")).cast("long")
    return each.select("p_partkey", "piece", at(c("piece")).alias("low"), at(c("piece") + 1).alias("high"))


@register("o6_rejected_rounds")
def rejected_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the round in which each was rejected (null: kept): each round drops the worse half of those far beyond the median."""
    pairs = table(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("pair")).agg(F.max(c("l_extendedprice") * c("l_discount")).alias("residual"))
    return manifest.rejected_by_rounds(pairs, Scratch(spark, "rounds"))


@register(
    "g6_counted_tiles",
    """WITH t AS (SELECT l_suppkey AS parent, l_orderkey, l_linenumber, l_partkey, (max(l_quantity) > 46)::INTEGER AS object FROM lineitem GROUP BY ALL),
    p AS (SELECT parent, list(object ORDER BY l_orderkey, l_linenumber, l_partkey) AS objects FROM t GROUP BY 1)
    SELECT parent, len(objects) AS tiles, list_sum(objects)::BIGINT AS objects, CASE WHEN list_sum(objects) = 0 THEN len(objects) ELSE list_reduce(list_concat([0::BIGINT], objects), lambda n, x: n + CASE WHEN x = 1 OR n % 10 = 0 THEN 1 ELSE 0 END) END AS kept FROM p""",
)
def counted_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles kept of parents of any number of tiles: an empty one where the number kept is a multiple of ten; all of a parent without objects."""
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    t = table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").alias("parent"), *order).agg((F.max("l_quantity") > 46).alias("object"))
    decided = counted(t, "parent", order, c("object"), Scratch(spark, "counted")).withColumnRenamed("kept", "counts")
    by = decided.join(t, ["parent", *order]).groupBy("parent").agg(F.count("*").alias("tiles"), F.count_if("object").alias("objects"), F.count_if("counts").alias("kept"))
    return by.withColumn("kept", F.when(c("objects") == 0, c("tiles")).otherwise(c("kept")))
