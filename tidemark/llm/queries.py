"""The registered queries of this subpackage: each applies its operator, as configured for production, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.backoff import backoff_scores
from tidemark.llm.chat import DIGEST_SQL, digests, format_conversations
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.html_text import extract
from tidemark.llm.language import identify
from tidemark.llm.licences import scan
from tidemark.llm.mixture import mixture
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.prefix_trie import prefix_trie
from tidemark.llm.quality import classify
from tidemark.llm.shards import shard_documents
from tidemark.llm.topk import top_k
from tidemark.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op4_hypergeometric_mixture")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


@register("op5_additive_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_kd_tree_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@register("op7_tiling_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered_tokens", "item_tokens", "coverage", "n_tiles")


@register("op2_html_consensus_paths")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@register("op3_norm_bucket_topk")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: Fixed rows of op8: a conversation whose texts are another template's control strings.
CONTROL_ROWS = "(-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')"


@register("op8_typed_chat_parts", DIGEST_SQL.format(extra=CONTROL_ROWS))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(f"SELECT * FROM VALUES {CONTROL_ROWS} AS v(conv_id, turn, role, text)")
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(said.union(extra)))


@register("op10_byte_bigru_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
    SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM texts
), grams AS (
    SELECT *, lag(w) OVER d AS h, lag(w, 2) OVER d AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), one AS (SELECT w, count(*) AS c FROM words GROUP BY w),
one_own AS (SELECT doc_id, w, count(*) AS c FROM words GROUP BY doc_id, w),
two AS (SELECT h, w, count(*) AS c FROM grams WHERE h IS NOT NULL GROUP BY h, w),
two_own AS (SELECT doc_id, h, w, count(*) AS c FROM grams WHERE h IS NOT NULL GROUP BY doc_id, h, w),
three AS (SELECT g, h, w, count(*) AS c FROM grams WHERE g IS NOT NULL GROUP BY g, h, w),
three_own AS (SELECT doc_id, g, h, w, count(*) AS c FROM grams WHERE g IS NOT NULL GROUP BY doc_id, g, h, w),
total AS (SELECT count(*) AS c FROM words),
counted AS (
    SELECT p.doc_id, p.i, p.n, p.h, p.g, total.c - p.n AS rest, u.c - uo.c AS c1, coalesce(b.c - bo.c, 0) AS c2, hu.c - ho.c AS ch, coalesce(t.c - t_o.c, 0) AS c3, gb.c - gbo.c AS cgh
    FROM grams p CROSS JOIN total JOIN one u ON u.w = p.w JOIN one_own uo ON uo.doc_id = p.doc_id AND uo.w = p.w
    LEFT JOIN two b ON b.h = p.h AND b.w = p.w LEFT JOIN two_own bo ON bo.doc_id = p.doc_id AND bo.h = p.h AND bo.w = p.w
    LEFT JOIN one hu ON hu.w = p.h LEFT JOIN one_own ho ON ho.doc_id = p.doc_id AND ho.w = p.h
    LEFT JOIN three t ON t.g = p.g AND t.h = p.h AND t.w = p.w LEFT JOIN three_own t_o ON t_o.doc_id = p.doc_id AND t_o.g = p.g AND t_o.h = p.h AND t_o.w = p.w
    LEFT JOIN two gb ON gb.h = p.g AND gb.w = p.h LEFT JOIN two_own gbo ON gbo.doc_id = p.doc_id AND gbo.h = p.g AND gbo.w = p.h
), scored AS (
    SELECT doc_id, n, CASE WHEN c3 > 0 THEN ln(c3) - ln(cgh) ELSE
        (CASE WHEN g IS NULL THEN 0 ELSE ln(0.4) END) + (CASE WHEN c2 > 0 THEN ln(c2) - ln(ch) ELSE
        (CASE WHEN h IS NULL THEN 0 ELSE ln(0.4) END) + (CASE WHEN c1 > 0 THEN ln(c1) - ln(rest) ELSE -ln(rest + 1) END) END) END AS s
    FROM counted
), summed AS (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_tokens, round(coalesce(s, 0), 3) AS log_score, CASE WHEN len(t.w) > 0 THEN round(s / len(t.w), 5) END AS mean_log_score
FROM texts t LEFT JOIN summed USING (doc_id)
"""
#: N-grams of up to three words.
OP9_ORDER = 3


@register("op9_stupid_backoff", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff_scores(table(spark, sf_dir, "documents"), order=OP9_ORDER)
    return scores.select("doc_id", "n_tokens", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


@register("op11_rare_token_licences")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


@register("op12_block_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH o AS (
    SELECT conv_id, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))[1:32] AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i FROM o
), convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda s, c: xor(xor(s, c) >> 1, CASE WHEN xor(s, c) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 4 AS h -- CRC-32
    FROM (SELECT DISTINCT conv_id FROM own)
), heads AS (
    SELECT c.conv_id, o.digest, o.words, o.i FROM convs c JOIN own o ON o.conv_id = c.base AND o.i <= c.h
), rebuilt AS (
    SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d
    FROM (SELECT conv_id, digest, words, i, 0 AS part FROM heads UNION ALL SELECT o.conv_id, o.digest, o.words, o.i, 1 FROM own o JOIN convs c USING (conv_id) WHERE o.i > c.h)
), paths AS (
    SELECT conv_id, d, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), sizes AS (SELECT conv_id, max(d) AS n FROM paths GROUP BY conv_id),
nodes AS (
    SELECT key, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '') AS ends
    FROM paths JOIN sizes USING (conv_id) GROUP BY key
), linked AS (
    SELECT *, CASE WHEN depth > 0 THEN key[1:-33] END AS parent FROM nodes
), branches AS (SELECT parent AS key, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.key AS upper, b.key AS key FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.d <= b.d),
subtrees AS (
    SELECT upper AS key, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
    FROM below JOIN nodes USING (key) LEFT JOIN branches USING (key) GROUP BY upper
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(b.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM linked n LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN branches b ON b.key = n.key JOIN subtrees s ON s.key = n.key
"""


@register("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
