"""Running sums and ranks over orders of any length: no task holds a whole key.

Rows are dealt by ranges of (keys, order), so that a key of any weight lies in several parts, each in order. Sums of
whole parts, a small table, are run over first; within a part a window adds up the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import Scratch


def in_parts(rows: DataFrame, keys: list[str], order: list[Column], scratch: Scratch) -> DataFrame:
    """rows with ``part``, written: parts follow the order of keys and order. Rows equal in both stay together."""
    return scratch.keep(rows.repartitionByRange(*[F.asc(k) for k in keys], *order).withColumn("part", F.spark_partition_id()))


def running(parts: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """parts with ``rn`` (rank in its key, from 1) and a running sum for each of sums."""
    values = {"rn": F.lit(1).cast("long"), **sums}
    whole = parts.groupBy(*keys, "part").agg(*[F.sum(v).alias(f"__{n}") for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in values])
    same = F.col("part") == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    upto = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(whole, same).drop("_part", *[f"_{k}" for k in keys])
    return out.withColumns({n: F.sum(v).over(upto) + F.col(f"__{n}") for n, v in values.items()}).drop(*[f"__{n}" for n in values])


def best_from_here(parts: DataFrame, keys: list[str], reversed_order: list[Column], value: str, name: str) -> DataFrame:
    """parts with the largest value from each row on to the end of its key; reversed_order is the order backwards."""
    whole = parts.groupBy(*keys, "part").agg(F.max(value).alias("__top"))
    after = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"), F.max("__top").over(after).alias("__later"))
    same = F.col("part") == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    upto = Window.partitionBy(*keys, "part").orderBy(*reversed_order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(whole, same).drop("_part", *[f"_{k}" for k in keys])
    return out.withColumn(name, F.greatest(F.max(value).over(upto), F.col("__later"))).drop("__later")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], scratch: Scratch) -> DataFrame:
    """rows with ``rn``, their rank in their key from 1, however many rows a key has."""
    return running(in_parts(rows, keys, order, scratch), keys, order, {}).drop("part")
