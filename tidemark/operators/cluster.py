"""Connected components and greedy suppression over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import Scratch

#: Rounds after which what they found is written as one table.
FOLD = 8


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the smallest node that links (a, b) reach from it, for every node of a link.

    Each round a node hooks to its smallest neighbour, follows one pointer, and links are drawn again between
    labels; a round at least halves the nodes of what is left of a component, so rounds grow with its logarithm.
    """
    edges = scratch.keep(links.select("a", "b").filter("a <> b").distinct())
    labels = None
    while n := edges.count():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        hook = scratch.keep(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")), 2 * n)
        next_ = hook.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        jump = scratch.keep(hook.join(next_, "to", "left").select("node", F.coalesce("beyond", "to").alias("to")), 2 * n)
        ends = [jump.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab"]
        drawn = edges.join(ends[0], "a").join(ends[1], "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        fresh = scratch.keep(drawn.filter("a <> b").distinct(), n)
        moved = jump.withColumnRenamed("to", "label")
        labels = moved if labels is None else scratch.keep(relabel(labels, moved))
        scratch.drop(edges, hook)
        edges = fresh
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def relabel(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """labels (node, label) after labels have got labels themselves (moved: node, label)."""
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def greedy_suppression(nodes: DataFrame, conflicts: DataFrame, scratch: Scratch) -> DataFrame:
    """node, kept: what a pass in rank order keeps, dropping whatever conflicts with a kept node of higher rank.

    conflicts (high, low) hold each conflicting pair, high of the better rank. A node is kept once no undecided or
    kept node stands above it, and dropped once a kept one does; rounds follow the longest chain of conflicts,
    and each only looks at pairs that are still undecided. A dropped node suppresses nobody.
    """
    open_ = scratch.keep(conflicts.select("high", "low"))
    dropped, rounds = None, 0
    while not open_.isEmpty():
        rounds += 1
        below = open_.select(F.col("low").alias("high")).distinct()
        firm = open_.join(below, "high", "left_anti")
        fallen = scratch.keep(firm.select(F.col("low").alias("node")).distinct())
        dropped = fallen if dropped is None else dropped.union(fallen)
        if rounds % FOLD == 0:
            dropped = scratch.keep(dropped)  # one table again, however many rounds there are
        gone = fallen.withColumnRenamed("node", "low")
        rest = open_.join(gone, "low", "left_anti").join(gone.withColumnRenamed("low", "high"), "high", "left_anti")
        fresh = scratch.keep(rest.select("high", "low"))
        scratch.drop(open_)
        open_ = fresh
    if dropped is None:
        return nodes.select("node", F.lit(True).alias("kept"))
    return nodes.select("node").join(dropped.withColumn("out", F.lit(True)), "node", "left").select("node", F.col("out").isNull().alias("kept"))
