"""Extensions for arriving data: running class statistics by event-time window, and incremental manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import manifest


def windowed_statistics(detections: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """window_start, class_name, n, mean_confidence over a stream (or table) of detections with ts.

    Rows later than ``late`` behind the newest are left out once their window is closed.
    """
    by = detections.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "class_name")
    return by.agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")).select(F.col("w.start").alias("window_start"), "class_name", "n", "mean_confidence")


def manifest_updates(spark: SparkSession, files: DataFrame, path: str, checkpoint: str, on_plan: Callable[[DataFrame], None]) -> StreamingQuery:
    """Plan each micro-batch of file rows (parent_id, size, mtime, digest) against the manifest kept under path.

    on_plan gets new and updated rows; the manifest keeps every version, the highest batch of an id being current.
    """

    def one(batch: DataFrame, number: int) -> None:
        kept = spark.read.schema(batch.schema.add("batch", "long")).parquet(path) if _exists(spark, path) else None
        current = kept.filter(F.col("batch") < number).groupBy("parent_id").agg(F.max_by(F.struct("size", "mtime", "digest"), "batch").alias("v")).select("parent_id", "v.*") if kept is not None else batch.limit(0)
        planned = manifest.plan(current, batch).filter("status in ('new', 'updated')")
        on_plan(planned)
        batch.join(planned, "parent_id", "left_semi").withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(path)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
