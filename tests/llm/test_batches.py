"""From the stages that hand texts to Python on, Arrow batches are small."""

import pyarrow as pa
import pytest

import corpus_pipeline


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})


@pytest.mark.parametrize("stage", ["quality", "near_dedup", "decontamination"])
def test_batches_of_texts_are_bounded(spark, small, stage):
    texts = spark.range(0, 2500, 1, 1).selectExpr("id as doc_id", "repeat('word ', 500) as text")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        dict(corpus_pipeline.STAGES)[stage](spark, spark.read.parquet(f"{small}/documents.parquet"), small)
        found = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 2500 and max(r["size"] for r in found) < 1_200_000
    finally:
        spark.conf.set(name, before)
