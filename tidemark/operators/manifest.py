"""Incremental manifests: what is new, changed, unchanged or gone since the last run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order_stats import quantiles
from tidemark.scratch import Scratch

#: Seconds by which modification times may differ without being a change.
MTIME_SLACK = 2.0


def plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """parent_id, status over the full outer join of two manifests (parent_id, size, mtime, digest)."""
    o, n = (side.select("parent_id", *[F.col(c).alias(f"{p}_{c}") for c in ("size", "mtime", "digest")], F.lit(True).alias(f"in_{p}")) for p, side in (("old", old), ("new", new)))
    both = o.join(n, "parent_id", "full_outer")
    same = F.col("old_digest").eqNullSafe(F.col("new_digest")) & (F.col("old_size") == F.col("new_size")) & (F.abs(F.col("old_mtime") - F.col("new_mtime")) <= MTIME_SLACK)
    status = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "stale").when(same, "unchanged").otherwise("updated")
    return both.select("parent_id", status.alias("status"))


def guarded(planned: DataFrame, most: float = 0.2) -> DataFrame:
    """The plan, or an error if more than a share of what is present would go stale."""
    counts = planned.agg(F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") != "stale").alias("present")).first()
    if counts["stale"] > most * max(counts["present"], 1):
        raise ValueError(f"{counts['stale']} of {counts['present']} images would be removed; pass a higher limit if that is meant")
    return planned


def cache_decision(now: Column, cached: Column, forced: Column) -> Column:
    """reuse a result of the same fingerprint; of another one rebuild it if that is forced, else refuse."""
    return F.when(now.eqNullSafe(cached), "reuse").when(forced, "rebuild").otherwise("refuse")


def rejected_by_rounds(pairs: DataFrame, scratch: Scratch, factor: float = 3.0) -> DataFrame:
    """pair, residual, round: in each round the worse half (rounded up) of the pairs beyond factor medians is rejected.

    pairs: pair, residual. Rounds go on until no pair is left beyond; round is null for what stays. Of equal residuals
    the larger pair goes first. Rounds are at most the logarithm of the bad pairs, for each time the median settles.
    """
    left, gone, number = scratch.keep(pairs.select("pair", "residual")), None, 0
    while True:
        typical = quantiles(left, [], {"mid": ("residual", 0.5)}, scratch).first()["mid"]
        bad = scratch.keep(left.filter(F.col("residual") > factor * typical)) if typical is not None else None
        n = bad.count() if bad is not None else 0
        if not n:
            break
        number += 1
        last = bad.orderBy(F.desc("residual"), F.desc("pair")).limit(-(-n // 2)).orderBy("residual", "pair").first()
        out = (F.col("residual") > last["residual"]) | ((F.col("residual") == last["residual"]) & (F.col("pair") >= last["pair"]))
        fallen = scratch.keep(bad.filter(out).withColumn("round", F.lit(number)))
        gone = fallen if gone is None else gone.union(fallen)
        left = scratch.keep(left.join(fallen.select("pair"), "pair", "left_anti"))
    kept = left.withColumn("round", F.lit(None).cast("int"))
    return kept if gone is None else kept.union(gone)
