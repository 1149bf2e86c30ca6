"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; the last adds shard and slot. The mix repeats documents of sources that are weighed up, so an
id may come back several times from there on.

The stages run one after the other in the same executors, whose heaps have grown to their limit by then. So that what
lies outside the heaps stays small, stages that hand texts to Python first bound the session's Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import keep_clean
from tidemark.llm.mixture import mixed_documents
from tidemark.llm.near_dedup import keep_one_of_each
from tidemark.llm.quality import keep_good
from tidemark.llm.scratch import Scratch
from tidemark.llm.shards import with_shards


#: Bytes of an Arrow batch; a longer row is a batch of its own. 10 000 texts, Spark's bound, would be some 20 MB, several times over.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold about BATCH_BYTES at most."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, learnt from ``labels``, doesn't reject."""
    bound_batches(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    bound_batches(spark)
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    bound_batches(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed_documents(docs).drop("mix_shard", "mix_position")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with shard and slot."""
    return with_shards(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Model training, sketches and tilings have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written result of the one before."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
