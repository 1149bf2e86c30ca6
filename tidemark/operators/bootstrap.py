"""Drawing rows anew with replacement: sums over each replicate, with exactly as many draws as there are rows.

Rows fall into parts of a bounded size by a hash of their key. How many of a replicate's draws fall into a part is settled
by a tree over the parts: each node splits its draws between its halves by a binomial draw whose seed is the node and the
replicate, so every part finds its own number along its path, without the others and without the driver. Within a part the
draws are spread evenly over its rows, and leave it as sums: replicates, not rows times replicates, are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import Scratch

PART_ROWS = 50_000


def draws_of_part(sizes: np.ndarray, part: int, replicates: int, seed: int) -> np.ndarray:
    """For each replicate, how many of the draws over all parts fall into one; over the parts they sum to the rows."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    low, high = 0, len(sizes)
    left = np.full(replicates, upto[-1])
    while high - low > 1:
        middle = (low + high) // 2
        share = (upto[middle] - upto[low]) / max(upto[high] - upto[low], 1)
        first = np.random.default_rng([seed, low, high]).binomial(left, share)
        low, high, left = (low, middle, first) if part < middle else (middle, high, left - first)
    return left


def counts_within(size: int, draws: np.ndarray, part: int, seed: int) -> np.ndarray:
    """replicates x rows: how often each row of a part is drawn."""
    rng = np.random.default_rng([seed, part, size, 1])
    return np.stack([np.bincount(rng.integers(0, size, m), minlength=size) for m in draws])


def resampled_sums(rows: DataFrame, key: str, values: list[str], replicates: int, scratch: Scratch, seed: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """rep, draws and the sum of each of values (null counts as 0) over rows drawn anew, as often as there are rows.

    key names a row; the same rows and seed give the same draws on any cluster. No rows: no replicates.
    """
    n = rows.count()
    parts = max(1, -(-n // part_rows))
    dealt = rows.select(F.col(key).alias("_key"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    dealt = scratch.keep(dealt.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(parts)).cast("int")))
    sizes = np.zeros(parts, np.int64)
    for r in dealt.groupBy("_part").count().collect():  # a row for each part
        sizes[r["_part"]] = r["count"]

    def draw(table: pa.Table) -> pa.Table:
        part = table["_part"][0].as_py()
        table = table.sort_by([("_key", "ascending"), *[(v, "ascending") for v in values]])
        stats = np.stack([np.ones(table.num_rows), *[table[v].to_numpy() for v in values]], axis=1)
        draws = draws_of_part(sizes, part, replicates, seed)
        out = np.concatenate([counts_within(len(stats), draws[k : k + 16], part * replicates + k, seed) @ stats for k in range(0, replicates, 16)])
        return pa.table({"rep": np.arange(replicates), "draws": out[:, 0].astype(np.int64), **{v: out[:, k + 1] for k, v in enumerate(values)}})

    schema = "rep long, draws long, " + ", ".join(f"`{v}` double" for v in values)
    return dealt.groupBy("_part").applyInArrow(draw, schema).groupBy("rep").agg(F.sum("draws").alias("draws"), *[F.sum(v).alias(v) for v in values])
