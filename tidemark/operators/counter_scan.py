"""A counter that decides which rows are kept, run over keys of any length without one task for a key.

Kept are rows that are wanted, and others where the number kept so far is a multiple of a period. What a run of rows does
to the counter depends on it only modulo the period: it is a map of that many states. Rows are dealt in ranges of (key,
order); each part gives its keys' maps, the maps of a key's parts are composed in order, a small table, and each part then
runs again from the state that it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import in_parts
from tidemark.scratch import Scratch

PERIOD = 10


def step(state: int, wanted: bool, period: int) -> tuple[bool, int]:
    """Whether a row is kept, and the state after it."""
    kept = wanted or state == 0
    return kept, (state + kept) % period


def _runs(table: pa.Table) -> Iterator[tuple[object, int, int]]:
    """(key, first row, one past the last) of runs of equal keys."""
    keys = table["key"].to_pylist()
    first = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[first]:
            yield keys[first], first, k
            first = k


def counted(rows: DataFrame, key: str, order: list[str], wanted: Column, scratch: Scratch, period: int = PERIOD) -> DataFrame:
    """rows with kept: whether each is kept by the counter of its key, in the order of columns (which name a row of a key).

    A null in wanted is not wanted; null keys are a key.
    """
    named = rows.withColumn("wanted", F.coalesce(wanted, F.lit(False)))
    kind = dict(named.dtypes)[key]
    parts = in_parts(named, [key], [F.asc(c) for c in order], scratch)
    work = parts.select("part", F.col(key).alias("key"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], "wanted")
    sorting = [("key", "ascending"), *[(f"o{k}", "ascending") for k in range(len(order))]]

    def maps(table: pa.Table) -> pa.Table:
        table = table.sort_by(sorting)
        wanted_ = table["wanted"].to_pylist()
        out = []
        for value, first, end in _runs(table):
            states = list(range(period))
            for w in wanted_[first:end]:
                states = [step(s, w, period)[1] for s in states]
            out.append((value, states))
        return pa.table({"part": pa.array([table["part"][0].as_py()] * len(out), pa.int32()), "key": pa.array([v for v, _ in out], table["key"].type), "after": pa.array([s for _, s in out], pa.list_(pa.int32()))})

    def begins(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        state, starts = 0, []
        for after in table["after"].to_pylist():
            starts.append(state)
            state = after[state]
        return pa.table({"part": table["part"], "key": table["key"], "start": pa.array(starts, pa.int32())})

    def decide(table: pa.Table, starts: pa.Table) -> pa.Table:
        table = table.sort_by(sorting)
        first_state = dict(zip(starts["key"].to_pylist(), starts["start"].to_pylist()))
        wanted_, kept = table["wanted"].to_pylist(), []
        for value, first, end in _runs(table):
            state = first_state[value]
            for w in wanted_[first:end]:
                k, state = step(state, w, period)
                kept.append(k)
        return table.drop_columns(["part", "wanted"]).append_column("kept", pa.array(kept, pa.bool_()))

    mapped = scratch.keep(work.groupBy("part").applyInArrow(maps, f"part int, key {kind}, after array<int>"))
    started = scratch.keep(mapped.groupBy("key").applyInArrow(begins, f"part int, key {kind}, start int"))  # a row for each part of a key
    kinds = dict(work.dtypes)
    schema = f"key {kind}, " + ", ".join(f"o{k} {kinds[f'o{k}']}" for k in range(len(order))) + ", kept boolean"
    decided = work.groupBy("part").cogroup(started.groupBy("part")).applyInArrow(decide, schema)
    return decided.select(F.col("key").alias(key), *[F.col(f"o{k}").alias(c) for k, c in enumerate(order)], "kept")
