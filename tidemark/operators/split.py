"""Deterministic splits of annotated images: by hash, by groups of shared ground, by greedy deficits."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import stable_unit

SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}


def hash_split(key: Column, shares: dict[str, float] = SHARES) -> Column:
    """A split by the key alone: adding rows moves none."""
    u, upto, out = stable_unit(key), 0.0, None
    for name, share in shares.items():
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(list(shares)[-1])


def homed(parents: DataFrame, group: str) -> DataFrame:
    """home, quarantined and group_frozen for images of groups that share ground.

    A group's home is the batch of its member with most weight (ties: the smallest id). If a group holds a frozen
    image, its other members are quarantined: they may enter no split.
    """
    w = Window.partitionBy(group)
    out = parents.withColumn("group_frozen", F.bool_or("frozen").over(w))
    out = out.withColumn("home", F.max_by("batch", F.struct("weight", -F.col("parent_id"))).over(w))
    return out.withColumn("quarantined", F.col("group_frozen") & ~F.col("frozen"))


def deficit_split(units: DataFrame, batch: str, shares: dict[str, float] = SHARES, seed: int = 42) -> DataFrame:
    """unit, batch, split: in each batch, heaviest first, a unit goes where most weight is still missing.

    units: unit (string), batch, weight. Units without weight go by a seeded draw of their own; a split whose share
    is 0 gets none. A group is the units of one batch.
    """
    names = [s for s, share in shares.items() if share > 0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = str(pdf[batch].iloc[0])
        order = sorted(pdf.unit)
        random.Random(f"{seed}:{key}").shuffle(order)
        turn = {u: i for i, u in enumerate(order)}
        weight = dict(zip(pdf.unit, pdf.weight))
        total = sum(weight.values())
        missing = {s: shares[s] * total for s in names}
        chosen = {}
        for u in sorted(weight, key=lambda u: (-weight[u], turn[u])):
            if weight[u] > 0:
                s = max(names, key=lambda s: (missing[s], -names.index(s)))
                missing[s] -= weight[u]
            else:
                s = random.Random(f"{seed}:{key}:{u}").choices(names, [shares[n] for n in names])[0]
            chosen[u] = s
        return pd.DataFrame({"unit": list(chosen), batch: pdf[batch].iloc[0], "split": list(chosen.values())})

    return units.groupBy(batch).applyInPandas(run, f"unit string, {batch} string, split string")
