"""A frozen test bench: images of each batch whose class counts come near a share of the batch's."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import Scratch


def freeze_bench(counts: DataFrame, share: float) -> DataFrame:
    """batch, unit, gap: units chosen one by one, each time the one that leaves the smallest gap, until none helps.

    counts: batch, unit, class_name, n. The gap is the sum over classes of the distance between chosen and wanted
    counts, relative to wanted. Units of a batch with equal counts are one row of a group with a multiplicity, named
    by the smallest unit, which also breaks ties of the gap; they are handed out in order of unit.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("kind")
        place = {c: k for k, c in enumerate(sorted({c for names in pdf.names for c in names}))}
        have = np.zeros((len(pdf), len(place)))
        for row, (names, ns) in enumerate(zip(pdf.names, pdf.ns)):
            have[row, [place[c] for c in names]] = ns
        kinds, units = list(pdf.kind), pdf.units.to_numpy()
        want = share * (have * units[:, None]).sum(axis=0)
        gap = lambda g: (np.abs(g - want) / np.maximum(want, 1e-9)).sum(axis=-1)
        got, used, chosen = np.zeros_like(want), np.zeros(len(kinds), np.int64), []
        while True:
            gaps = np.where(used < units, gap(got + have), np.inf)
            best = int(np.argmin(np.round(gaps, 9)))
            if gaps[best] >= gap(got):
                break
            got += have[best]
            used[best] += 1
            chosen.append((kinds[best], int(used[best]), round(float(gap(got)), 6)))
        return pd.DataFrame(chosen, columns=["kind", "turn", "gap"]).assign(batch=pdf.batch.iloc[0])[["batch", "kind", "turn", "gap"]]

    one = counts.filter("class_name is not null").groupBy("batch", "unit", "class_name").agg(F.sum("n").alias("n")).filter("n <> 0")
    units = one.groupBy("batch", "unit").agg(F.array_sort(F.collect_list(F.struct("class_name", "n"))).alias("classes"))
    same = Window.partitionBy("batch", "classes")
    turns = units.select("batch", "unit", F.min("unit").over(same).alias("kind"), F.row_number().over(same.orderBy("unit")).cast("long").alias("turn"))
    kinds = units.groupBy("batch", "classes").agg(F.min("unit").alias("kind"), F.count("*").alias("units"))
    kinds = kinds.select("batch", "kind", "units", F.col("classes.class_name").alias("names"), F.col("classes.n").cast("array<long>").alias("ns"))
    taken = kinds.groupBy("batch").applyInPandas(run, "batch string, kind string, turn long, gap double").alias("t")
    turns = turns.alias("u")
    on = F.col("t.batch").eqNullSafe(F.col("u.batch")) & (F.col("t.kind") == F.col("u.kind")) & (F.col("t.turn") == F.col("u.turn"))
    return turns.join(taken, on).select("u.batch", "u.unit", "t.gap")


#: Least groups of a batch, weight of the classes' gap, and what it costs to take a group out of another split.
LEAST_GROUPS, CLASS_WEIGHT = 3, 0.5
PENALTIES = {"test": 0.0, "val": 0.02, "train": 0.04}


def freeze_stratified(parents: DataFrame, objects: DataFrame, share: float, scratch: Scratch, seed: str = "bench", least_groups: int = LEAST_GROUPS, penalties: dict[str, float] | None = None) -> DataFrame:
    """batch, unit, turn, gap: whole spatial groups of each batch, taken one after the other as long as the gap to the targets falls.

    parents: batch, parent_id, unit (its group; null: itself), split (null: train); objects: parent_id, class_name, n. The
    gap is the distance to a share of the batch's objects and to one of its images, each relative to it, and half the mean
    of the same over its classes. A group is chosen by the gap that it leaves and a penalty for the split it is taken from
    (the dearest of its images'), ties by a stable hash; the penalty isn't part of the gap. A batch of fewer groups than
    least_groups gives none, nor does one without a batch name. Each round is one pass over the groups that are left, in
    which every batch takes its best one: no task holds a batch, and there are as many rounds as the batch that takes most
    has turns.
    """
    c, costs = F.col, penalties or PENALTIES
    dearest = max(costs.values())
    penalty = F.coalesce(*[F.when(F.coalesce("split", F.lit("train")) == s, v) for s, v in costs.items()], F.lit(dearest))
    images = parents.filter("batch IS NOT NULL").select("batch", "parent_id", F.coalesce(c("unit").cast("string"), c("parent_id").cast("string")).alias("unit"), penalty.alias("penalty"))
    images = scratch.keep(images.groupBy("batch", "parent_id").agg(F.min("unit").alias("unit"), F.max("penalty").alias("penalty")))
    counts = objects.filter("class_name IS NOT NULL AND n > 0").join(images.select("batch", "parent_id", "unit"), "parent_id").groupBy("batch", "unit", "class_name").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts)
    classes = counts.groupBy("batch").agg(F.sort_array(F.collect_set("class_name")).alias("classes"))  # class names of a batch
    named = counts.groupBy("batch", "unit").agg(F.map_from_entries(F.collect_list(F.struct("class_name", "n"))).alias("by_class"))
    units = images.groupBy("batch", "unit").agg(F.count(F.lit(1)).cast("double").alias("images"), F.max("penalty").alias("penalty")).join(named, ["batch", "unit"], "left").join(classes, "batch", "left")
    have = F.transform(F.coalesce("classes", F.array().cast("array<string>")), lambda k: F.coalesce(F.try_element_at("by_class", k), F.lit(0)).cast("double"))
    order = F.sha2(F.concat_ws(":", F.lit(seed), "batch", "unit").cast("binary"), 256)
    units = scratch.keep(units.select("batch", "unit", "images", "penalty", have.alias("have"), order.alias("order")))
    width = units.groupBy("batch").agg(F.count(F.lit(1)).alias("units"), F.sum("images").alias("images"), F.max(F.size("have")).alias("k")).filter(c("units") >= least_groups)
    totals = units.select("batch", F.posexplode("have").alias("place", "n")).groupBy("batch", "place").agg(F.sum("n").alias("n")).groupBy("batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "n"))), lambda s: s["n"]).alias("total"))
    none = F.array().cast("array<double>")
    state = width.join(totals, "batch", "left").select(
        "batch", (c("images") * share).alias("want_images"), F.transform(F.coalesce("total", none), lambda n: n * share).alias("want"),
        F.lit(0.0).alias("got_images"), F.transform(F.coalesce("total", none), lambda n: F.lit(0.0)).alias("got"),
    )
    whole = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    off = lambda aim, is_: F.abs(aim - is_) / F.greatest(aim, F.lit(1.0))

    def gap(got, got_images):
        each = F.zip_with("want", got, lambda aim, is_: off(aim, is_))
        return off(whole(c("want")), whole(got)) + off(c("want_images"), got_images) + F.when(F.size("want") > 0, CLASS_WEIGHT * whole(each) / F.size("want")).otherwise(0.0)

    state = scratch.keep(state.withColumn("gap", gap(c("got"), c("got_images"))))
    left, taken, turn = units, None, 0
    while True:
        turn += 1
        added = F.zip_with("got", "have", lambda a, b: a + b)
        tried = left.join(state, "batch").withColumns({"after": gap(added, c("got_images") + c("images")), "sum": added})
        cost = F.struct(F.round(c("after") + c("penalty"), 12).alias("cost"), "order", "unit")
        best = tried.groupBy("batch").agg(F.min_by(F.struct("unit", "after", "sum", (c("got_images") + c("images")).alias("sum_images"), F.round(c("after") + c("penalty"), 12).alias("cost"), "gap", "want", "want_images"), cost).alias("b")).select("batch", "b.*")
        best = scratch.keep(best.filter(c("cost") < F.round("gap", 12)))
        if best.isEmpty():
            break
        chosen = best.select("batch", "unit", F.lit(turn).alias("turn"), c("after").alias("gap"))
        taken = chosen if taken is None else taken.union(chosen)
        state = best.select("batch", "want_images", "want", c("sum_images").alias("got_images"), c("sum").alias("got"), c("after").alias("gap"))
        left = scratch.keep(left.join(best.select("batch").distinct(), "batch", "left_semi").join(best.select("batch", "unit"), ["batch", "unit"], "left_anti"))
    return taken if taken is not None else units.select("batch", "unit", F.lit(0).alias("turn"), F.lit(0.0).alias("gap")).limit(0)
