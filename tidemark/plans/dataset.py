"""Datasets of annotated images: keys, taxonomy, splits, leaks, audits, manifests (F*, G*, J13-J28, M*, U*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import manifest
from tidemark.operators.order_stats import with_quantiles
from tidemark.operators.split import deficit_split, hash_split, homed
from tidemark.plans.registry import register, table
from tidemark.plans.surveys import PARENTS, parents
from tidemark.scratch import Scratch


@register(
    "f2_text_keys",
    r"""SELECT page_id, split_part(url, '/', 3) AS host, translate(regexp_replace(url, '\.[^./\\]*$', ''), '/\ ', '___') AS parent_id, regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') AS label,
        sha256(url)[1:16] AS fingerprint, coalesce(nullif(regexp_extract(url, '/([a-z]{2})/', 1), ''), '?') AS lang FROM pages""",
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.split_part(u, F.lit("/"), F.lit(3)).alias("host"), keys.parent_id(u).alias("parent_id"), keys.safe_label(u).alias("label"), keys.fingerprint(u).alias("fingerprint"), F.coalesce(F.nullif(F.regexp_extract(u, "/([a-z]{2})/", 1), F.lit("")), F.lit("?")).alias("lang"))


@register(
    "j19_tile_parents",
    r"""WITH t AS (SELECT 'SB_' || p_brand || CASE WHEN p_partkey % 5 = 0 THEN '_x_' ELSE '_' || p_size || '_' END || (p_partkey % 640) AS tile FROM part),
    o AS (SELECT tile, CASE WHEN regexp_matches(tile, '^.*_\d+_\d+$') THEN regexp_extract(tile, '^(.*)_\d+_\d+$', 1) ELSE tile END AS parent FROM t) SELECT parent, count(*) AS tiles FROM o GROUP BY 1""",
)
def tile_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    middle = F.when(c("p_partkey") % 5 == 0, F.lit("_x_")).otherwise(F.concat(F.lit("_"), c("p_size").cast("string"), F.lit("_")))
    t = table(spark, sf_dir, "part").select(F.concat(F.lit("SB_"), c("p_brand"), middle, (c("p_partkey") % 640).cast("string")).alias("tile"))
    return t.groupBy(keys.parent_of_tile(c("tile")).alias("parent")).agg(F.count("*").alias("tiles"))


@register(
    "f1_class_keys",
    r"""SELECT trim(regexp_replace(lower(replace(strip_accents(text), '_', ' ')), '\s+', ' ', 'g')) AS name_key, count(*) AS n FROM documents GROUP BY 1""",
)
def class_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accent- and case-folded names, over whole texts of documents."""
    named = table(spark, sf_dir, "documents").select(keys.normal_name("text").alias("name_key"))
    return named.groupBy("name_key").agg(F.count("*").alias("n"))


@register(
    "g2_hash_split",
    f"""WITH {PARENTS}, u AS (SELECT parent_id, batch, ('0x' || sha256('42:' || batch || ':' || parent_id)[1:15])::BIGINT / pow(16, 15) AS u FROM parents)
    SELECT parent_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split, round(u, 9) AS u FROM u""",
)
def hash_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", F.lit("42"), "batch", F.col("parent_id").cast("string"))
    return parents(spark, sf_dir).select("parent_id", hash_split(key).alias("split"), F.round(keys.stable_unit(key), 9).alias("u"))


@register(
    "a47_split_rollup",
    f"""WITH {PARENTS}, u AS (SELECT *, ('0x' || sha256('42:' || batch || ':' || parent_id)[1:15])::BIGINT / pow(16, 15) AS u FROM parents), s AS (SELECT *, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split FROM u)
    SELECT coalesce(site, '(all)') AS site, coalesce(split, '(all)') AS split, count(*) AS images, sum(weight)::BIGINT AS weight FROM s GROUP BY GROUPING SETS ((site, split), (split), ())""",
)
def split_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", F.lit("42"), "batch", F.col("parent_id").cast("string"))
    s = parents(spark, sf_dir).withColumn("split", hash_split(key))
    by = s.groupingSets([["site", "split"], ["split"], []], "site", "split").agg(F.count("*").alias("images"), F.sum("weight").alias("weight"))
    return by.withColumns({c: F.coalesce(c, F.lit("(all)")) for c in ("site", "split")})


@register(
    "g3_homes_and_quarantine",
    f"""WITH {PARENTS} SELECT parent_id, bool_or(frozen) OVER w AS group_frozen, first_value(batch) OVER (PARTITION BY ground ORDER BY weight DESC, parent_id) AS home, bool_or(frozen) OVER w AND NOT frozen AS quarantined FROM parents WINDOW w AS (PARTITION BY ground)""",
)
def homes_and_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the same ground belong to one home; neighbours of a frozen one are quarantined."""
    return homed(parents(spark, sf_dir), "ground").select("parent_id", "group_frozen", "home", "quarantined")


@register("g1_deficit_split")
def deficit_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = parents(spark, sf_dir).select(F.col("parent_id").cast("string").alias("unit"), "batch", "weight")
    return deficit_split(units, "batch")


SPLIT = f"""{PARENTS}, s AS (SELECT *, CASE WHEN frozen THEN 'test' WHEN parent_id % 10 < 8 THEN 'train' ELSE 'val' END AS split FROM parents)"""


def split_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parents(spark, sf_dir).withColumn("split", F.when(F.col("frozen"), "test").when(F.col("parent_id") % 10 < 8, "train").otherwise("val"))


@register(
    "j13_shared_ground",
    f"""WITH {SPLIT}, g AS (SELECT ground, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'train') AS train FROM s GROUP BY 1)
    SELECT site, count(*) AS grounds, sum(test * train + test * val + val * train)::BIGINT AS pairs, sum(CASE WHEN test > 0 THEN val + train WHEN val > 0 THEN train ELSE 0 END)::BIGINT AS masked FROM g JOIN (SELECT ground, min(site) AS site FROM parents GROUP BY 1) USING (ground)
    WHERE (test > 0)::INT + (val > 0)::INT + (train > 0)::INT > 1 GROUP BY site""",
)
def shared_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground shared across splits, counted without making the pairs; the split of lower rank is masked."""
    c = F.col
    g = split_parents(spark, sf_dir).groupBy("ground").agg(F.min("site").alias("site"), *[F.count_if(c("split") == s).alias(s) for s in ("test", "val", "train")])
    several = (c("test") > 0).cast("int") + (c("val") > 0).cast("int") + (c("train") > 0).cast("int") > 1
    masked = F.when(c("test") > 0, c("val") + c("train")).when(c("val") > 0, c("train")).otherwise(0)
    return g.filter(several).groupBy("site").agg(F.count("*").alias("grounds"), F.sum(c("test") * c("train") + c("test") * c("val") + c("val") * c("train")).alias("pairs"), F.sum(masked).alias("masked"))


@register(
    "g13_leak_check",
    f"""WITH {SPLIT}, seen AS (SELECT DISTINCT ground FROM s WHERE split <> 'test')
    SELECT 'frozen outside test' AS rule, count(*) AS n FROM s WHERE frozen AND split <> 'test' UNION ALL SELECT 'test not frozen', count(*) FROM s WHERE NOT frozen AND split = 'test'
    UNION ALL SELECT 'test ground seen', count(*) FROM s WHERE split = 'test' AND ground IN (FROM seen) UNION ALL SELECT 'no annotations', count(*) FROM s WHERE weight = 0""",
)
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_parents(spark, sf_dir)
    seen = s.filter("split <> 'test'").select("ground").distinct()
    rules = [("frozen outside test", s.filter("frozen and split <> 'test'")), ("test not frozen", s.filter("not frozen and split = 'test'")), ("test ground seen", s.filter("split = 'test'").join(seen, "ground", "left_semi")), ("no annotations", s.filter("weight = 0"))]
    out = None
    for name, rows in rules:
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = part if out is None else out.union(part)
    return out


@register(
    "j18_taxonomy_resolution",
    """WITH names AS (SELECT p_partkey, lower(p_name) AS local_name, split_part(lower(p_name), ' ', 2) AS head FROM part), tax(head, target, excluded) AS (VALUES ('ring', 0, false), ('bolt', 1, false), ('gear', NULL, true))
    SELECT CASE WHEN tax.head IS NULL THEN 'unresolved' WHEN excluded THEN 'excluded' ELSE 'target ' || target END AS resolved, count(*) AS n, min(p_partkey) AS placeholder FROM names LEFT JOIN tax USING (head) GROUP BY 1""",
)
def taxonomy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local names to targets; what is excluded or unknown is told apart. placeholder: the lowest local id of each."""
    tax = spark.sql("SELECT * FROM VALUES ('ring', 0, false), ('bolt', 1, false), ('gear', NULL, true) AS t(head, target, excluded)")
    named = table(spark, sf_dir, "part").select("p_partkey", F.split_part(F.lower("p_name"), F.lit(" "), F.lit(2)).alias("head"))
    joined = named.join(F.broadcast(tax.withColumn("known", F.lit(True))), "head", "left")
    resolved = F.when(F.col("known").isNull(), "unresolved").when(F.col("excluded"), "excluded").otherwise(F.concat(F.lit("target "), F.col("target").cast("string")))
    return joined.groupBy(resolved.alias("resolved")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("placeholder"))


@register(
    "j21_orphans",
    "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'image without label' ELSE 'label without image' END AS problem FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("image"))
    both = d.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("label")), "doc_id", "full_outer")
    return both.filter("image is null or label is null").select("doc_id", F.when(F.col("label").isNull(), "image without label").otherwise("label without image").alias("problem"))


@register(
    "g10_manifest_plan",
    """WITH o AS (SELECT doc_id, n_chars, doc_id * 1.0::DOUBLE AS mtime, md5(text) AS digest FROM documents WHERE doc_id % 11 <> 0), n AS (SELECT doc_id, n_chars, doc_id + CASE WHEN doc_id % 13 = 0 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS mtime, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE md5(text) END AS digest FROM documents WHERE doc_id % 19 <> 0)
    SELECT coalesce(o.doc_id, n.doc_id) AS parent_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'stale' WHEN o.digest = n.digest AND o.n_chars = n.n_chars AND abs(o.mtime - n.mtime) <= 2 THEN 'unchanged' ELSE 'updated' END AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
)
def manifest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), F.col("n_chars").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))
    p = F.col("parent_id")
    old = d.filter(p % 11 != 0).withColumn("mtime", p.cast("double"))
    new = d.filter(p % 19 != 0).withColumn("mtime", p + F.when(p % 13 == 0, 5.0).otherwise(1.0)).withColumn("digest", F.when(p % 17 == 0, "x").otherwise(F.col("digest")))
    return manifest.plan(old, new)


@register(
    "g15_validation",
    """SELECT 'no text' AS problem, count(*) AS n FROM documents WHERE text IS NULL OR text = '' UNION ALL SELECT 'count off', count(*) FROM documents WHERE n_chars <> length(text)
    UNION ALL SELECT 'repeated id', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated text', coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM documents GROUP BY md5(text))
    UNION ALL SELECT 'unknown label', count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)""",
)
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    single = d.agg(F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("no text"), F.count_if(F.col("n_chars") != F.length("text")).alias("count off"))
    ids = d.groupBy("doc_id").count().agg(F.count_if(F.col("count") > 1).alias("n")).select(F.lit("repeated id").alias("problem"), "n")
    texts = d.groupBy(F.md5(F.col("text").cast("binary")).alias("m")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("repeated text").alias("problem"), "n")
    unknown = l.agg(F.count_if(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)).alias("n")).select(F.lit("unknown label").alias("problem"), "n")
    return single.unpivot([], ["no text", "count off"], "problem", "n").union(ids).union(texts).union(unknown)


@register("u3_last_wins", "SELECT user_id, max_by(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows repeated by id: the last one's values stay."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@register(
    "u4_set_differences",
    "WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels) SELECT 'only first' AS side, count(*) AS n FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'only second', count(*) FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM b)",
)
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count(a.subtract(b), "only first").union(count(b.subtract(a), "only second")).union(count(a.intersect(b), "both"))


@register(
    "w6_hash_rank_sample",
    f"WITH {PARENTS}, r AS (SELECT parent_id, site, row_number() OVER (PARTITION BY site ORDER BY sha256('7:' || parent_id), parent_id) AS rn FROM parents) SELECT parent_id, site FROM r WHERE rn <= 20",
)
def hash_rank_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: per site the 20 that hash lowest, whatever else there is."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("parent_id").cast("string")).cast("binary"), 256), "parent_id"))
    return parents(spark, sf_dir).withColumn("rn", rank).filter("rn <= 20").select("parent_id", "site")


@register(
    "a12_dataset_by_class",
    """SELECT source, count(*) AS images, count(DISTINCT lang) AS batches, round(median(n_chars), 3) AS median_size, round(avg(n_chars), 4) AS mean_size, round(CASE WHEN count(*) < 2 OR avg(n_chars) = 0 THEN 0 ELSE stddev_samp(n_chars) / avg(n_chars) END, 6) AS cv FROM documents GROUP BY 1""",
)
def dataset_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = F.when((F.count("*") < 2) | (F.avg("n_chars") == 0), 0.0).otherwise(F.stddev_samp("n_chars") / F.avg("n_chars"))
    rows = table(spark, sf_dir, "documents")
    by = rows.groupBy("source").agg(F.count("*").alias("images"), F.countDistinct("lang").alias("batches"), F.round(F.avg("n_chars"), 4).alias("mean_size"), F.round(cv, 6).alias("cv"))
    return with_quantiles(by, rows, ["source"], {"median_size": ("n_chars", 0.5)}, Scratch(spark, "medians")).withColumn("median_size", F.round("median_size", 3))


@register(
    "a13_dataset_by_batch",
    "SELECT d.lang, count(*) AS images, count(*) FILTER (l.doc_id IS NOT NULL) AS labelled, round(avg(n_chars) FILTER (l.quality = 1), 4) AS mean_good, min(n_chars) FILTER (l.quality = 0)::DOUBLE AS low_bad FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
)
def dataset_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("labelled")), "doc_id", "left")
    of = lambda q: F.when(F.col("quality") == q, F.col("n_chars"))
    return d.groupBy("lang").agg(F.count("*").alias("images"), F.count("labelled").alias("labelled"), F.round(F.avg(of(1)), 4).alias("mean_good"), F.min(of(0)).cast("double").alias("low_bad"))


@register(
    "a19_objects_by_tile",
    "WITH c AS (SELECT o_orderkey, count(l_orderkey) AS c FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT count(*) AS tiles, round(avg(c), 6) AS mean, median(c) AS median, max(c) AS most, round(100.0::DOUBLE * count(*) FILTER (c = 0) / count(*), 4) AS percent_empty FROM c",
)
def objects_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("c"))
    c = table(spark, sf_dir, "orders").select("o_orderkey").join(per, "o_orderkey", "left").fillna(0)
    one = c.agg(F.count("*").alias("tiles"), F.round(F.avg("c"), 6).alias("mean"), F.max("c").alias("most"), F.round(100.0 * F.count_if(F.col("c") == 0) / F.count("*"), 4).alias("percent_empty"))
    return with_quantiles(one, c, [], {"median": ("c", 0.5)}, Scratch(spark, "medians"))


@register(
    "j28_renamed_ids",
    f"""WITH {PARENTS}, old AS (SELECT parent_id, site, weight, ground FROM parents WHERE parent_id % 2 = 0), new AS (SELECT parent_id AS new_id, site, weight, ground FROM parents WHERE parent_id % 2 = 1),
    a AS (SELECT parent_id, min(new_id) AS new_id FROM old JOIN new USING (site, weight, ground) GROUP BY 1 HAVING count(*) = 1), b AS (SELECT parent_id, min(new_id) AS new_id FROM old JOIN new USING (ground) WHERE parent_id NOT IN (SELECT parent_id FROM a) GROUP BY 1 HAVING count(*) = 1)
    SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def renamed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that came back under another: by site, size and content, else by content; only where one candidate fits."""
    p = parents(spark, sf_dir).select("parent_id", "site", "weight", "ground")
    old, new = p.filter("parent_id % 2 = 0"), p.filter("parent_id % 2 = 1").withColumnRenamed("parent_id", "new_id")
    # candidates are counted on the new side first, so that many copies of one image aren't paired up
    one = lambda on: old.join(new.groupBy(*on).agg(F.min("new_id").alias("new_id"), F.count("*").alias("n")).filter("n = 1"), on).select("parent_id", "new_id")
    first = one(["site", "weight", "ground"])
    return first.union(one(["ground"]).join(first, "parent_id", "left_anti"))


@register(
    "f44_parameter_changes",
    """WITH a AS (SELECT s_nationkey AS run, 'p' || (s_suppkey % 40) AS param, max(round(s_acctbal)) AS v FROM supplier WHERE s_nationkey = 1 GROUP BY ALL), b AS (SELECT 'p' || (s_suppkey % 40) AS param, max(round(s_acctbal)) AS v FROM supplier WHERE s_nationkey = 2 GROUP BY ALL)
    SELECT coalesce(a.param, b.param) AS param, a.v AS old, b.v AS new FROM a FULL JOIN b ON a.param = b.param WHERE a.v IS DISTINCT FROM b.v""",
)
def parameter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey", F.concat(F.lit("p"), (F.col("s_suppkey") % 40).cast("string")).alias("param")).agg(F.max(F.round("s_acctbal")).alias("v"))
    a, b = (s.filter(F.col("s_nationkey") == k).select("param", F.col("v").alias(name)) for k, name in ((1, "old"), (2, "new")))
    return a.join(b, "param", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


@register(
    "j26_share_of_total",
    "SELECT r_name, n_name, count(*) AS customers, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY r_name), 4) AS percent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
)
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").count()
    named = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("r_name", "n_name", F.col("count").alias("customers"), F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("r_name")), 4).alias("percent"))
