"""The counter over parts against one pass, with keys of many parts."""

import random

from pyspark.sql import functions as F

from tidemark.operators.counter_scan import counted
from tidemark.scratch import Scratch


def test_counter_equals_one_pass(spark):
    rng = random.Random(6)
    rows = [(k, t, rng.random() < share) for k, n, share in (("a", 700, 0.1), ("b", 35, 0.9), ("c", 1, 0.0), ("d", 250, 0.0), (None, 60, 0.5)) for t in range(n)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame([(*r, "x") for r in shuffled], "k string, t int, w boolean, kept string").drop("kept")
        got = {(r.k, r.t): r.kept for r in counted(frame, "k", ["t"], F.col("w"), Scratch(spark, "t")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = {}
    for k, t, w in rows:
        keep = w or n.get(k, 0) % 10 == 0
        n[k] = n.get(k, 0) + keep
        assert got[k, t] == keep, (k, t)
    assert len(got) == len(rows) and n["d"] == 1
    assert counted(frame.limit(0), "k", ["t"], F.col("w"), Scratch(spark, "t")).collect() == []
