"""K-d tree sharding of documents by bytes, with DataFrame functions only.

The tree is learnt on a light table (sizes and coordinates, no text). A node that must hold k shards is cut along
its widest dimension where the bytes on one side reach floor(k/2)/k of the node's: a distributed weighted median,
found by sums over digits of the coordinate, most significant first, so that no task sees a node's rows in order.
The finished tree has one cut fewer than shards and is compiled into one CASE expression, which assigns any row
without a join.

Order along a dimension: 16 bits of the dimension, then 47 bits of a hash of the text, then a hash of the id. Rows
with equal texts have equal places, so a cut passes by them, unless they weigh more than the slack, a set share of
a shard's bytes; such a hot group is cut by the id's hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

SHARDS = 40
#: Bytes that a document takes beside its text.
OVERHEAD = 16
#: Share of a shard's bytes up to which rows of equal text are never cut apart.
SLACK = 0.02
DIGIT_BITS = 16
PLACE_BITS = 63
#: Places within one digit up to which they are summed one by one.
FEW_ROWS = 50_000
#: Rows numbered in one task.
SLOT_ROWS = 100_000
SLOT_BYTES = 64 << 20


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def of_text(value: Column) -> Column:
    """16 bits that order short codes by their first two characters; null first."""
    code = lambda k: F.least(F.coalesce(F.ascii(F.substring(value, k, 1)), F.lit(0)), F.lit(255))
    return (code(1) * 256 + code(2)).cast("long")


def of_number(value: Column) -> Column:
    """16 bits that order numbers from 0 on by their logarithm; null first."""
    return F.least(F.floor(F.log2(F.coalesce(F.greatest(value, F.lit(0)), F.lit(0)) + 1) * 1024), F.lit(65535)).cast("long")


@dataclass
class Cut:
    dimension: str
    place: int
    id_place: int | None
    left: "Cut | int"
    right: "Cut | int"


def places(docs: DataFrame) -> dict[str, Column]:
    """The columns that a cut looks at: size, one place for each dimension, and the id's hash."""
    text = F.col("text").cast("string")
    size = text_bytes(text) + OVERHEAD
    tie = F.xxhash64(text).bitwiseAND(F.lit((1 << 47) - 1))
    dims = {"lang": of_text(F.col("lang").cast("string")), "bytes": of_number(size)}
    at = {f"__at_{name}": F.shiftleft(value, 47).bitwiseOR(tie) for name, value in dims.items()}
    own = F.xxhash64(F.lit(7), F.col("doc_id").cast("long")).bitwiseAND(F.lit((1 << 62) - 1))
    return {"__size": size, **at, "__own": own}


def assign(tree: Cut | int) -> Column:
    if isinstance(tree, int):
        return F.lit(tree)
    at = F.col(f"__at_{tree.dimension}")
    before = at < tree.place
    if tree.id_place is not None:
        before = before | ((at == tree.place) & (F.col("__own") < tree.id_place))
    return F.when(before, assign(tree.left)).otherwise(assign(tree.right))


def _values(light: DataFrame, columns: str, rows: list[tuple]) -> DataFrame:
    """A table of a few rows (one for each node at most), to be sent to every executor."""
    text = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else f"{v}L" for v in row) + ")" for row in rows)
    return F.broadcast(light.sparkSession.sql(f"SELECT * FROM VALUES {text} AS nodes({columns})"))


def learn(light: DataFrame, shards: int, scratch: Scratch, slack: float = SLACK) -> Cut | int:
    """The tree over a light table with the columns of places(). Node n has children 2n and 2n+1; 1 is the root."""
    dims = sorted(c[5:] for c in light.columns if c.startswith("__at_"))
    of = {1: shards}  # shards of each node
    cuts: dict[int, tuple[str, int, int | None]] = {}
    level = [1] if shards > 1 else []
    rows = light.select(*[c for c in light.columns if c.startswith("__")], F.lit(1).cast("long").alias("__node"))
    span: dict[str, int] = {}
    total = 0
    while level:
        wide = [f(F.shiftright(f"__at_{d}", 47)).alias(f"{k}_{d}") for d in dims for k, f in (("low", F.min), ("high", F.max))]
        stats = {r["__node"]: r for r in rows.groupBy("__node").agg(F.sum("__size").alias("bytes"), *wide).collect()}
        if 1 in level and 1 in stats:
            total = stats[1]["bytes"]
            span = {d: max(1, stats[1][f"high_{d}"] - stats[1][f"low_{d}"]) for d in dims}
        goals = {}
        for n in level:
            cuts[n] = (dims[0], 0, None)  # of a node without rows
            of[2 * n], of[2 * n + 1] = of[n] // 2, of[n] - of[n] // 2
            if n in stats:
                r = stats[n]
                widest = max(dims, key=lambda d: ((r[f"high_{d}"] - r[f"low_{d}"]) / span[d], d))
                goals[n] = (widest, r["bytes"] * (of[n] // 2) / of[n])
        cuts |= _cuts(rows, goals, slack * total / shards)
        level = [c for n in level for c in (2 * n, 2 * n + 1) if of[c] > 1]
        if level and goals:
            at = _values(light, "__node, dim, place, own", [(n, *cuts[n]) for n in goals])
            value = _along("dim", dims)
            before = (value < F.col("place")) | ((value == F.col("place")) & F.coalesce(F.col("__own") < F.col("own"), F.lit(False)))
            moved = rows.join(at, "__node").withColumn("__node", F.col("__node") * 2 + F.when(before, 0).otherwise(1)).drop("dim", "place", "own")
            rows = scratch.keep(moved)

    def build(n: int, first: int) -> Cut | int:
        if of[n] == 1:
            return first
        return Cut(*cuts[n], build(2 * n, first), build(2 * n + 1, first + of[2 * n]))

    return build(1, 0)


def _along(dim: str, dims: list[str]) -> Column:
    """The place along the dimension that a column names."""
    out = F.lit(None).cast("long")
    for d in dims:
        out = F.when(F.col(dim) == d, F.col(f"__at_{d}")).otherwise(out)
    return out


def _cuts(rows: DataFrame, goals: dict[int, tuple[str, float]], slack: float) -> dict[int, tuple[str, int, int | None]]:
    """For each node where to cut so that the bytes before come nearest its goal."""
    if not goals:
        return {}
    dims = sorted({d for d, _ in goals.values()})
    nodes = _values(rows, "__node, dim", [(n, d) for n, (d, _) in goals.items()])
    rows = rows.join(nodes, "__node").select("__node", "__size", "__own", _along("dim", dims).alias("__at"))
    cuts, hot = {}, {}
    for n, (place, before, weight) in _descend(rows, "__at", PLACE_BITS, {n: goal for n, (_, goal) in goals.items()}).items():
        want = goals[n][1] - before
        if weight > slack:
            hot[n] = (place, want)
        else:
            cuts[n] = (goals[n][0], place + (2 * want > weight), None)
    if hot:
        groups = _values(rows, "__node, hot", [(n, p) for n, (p, _) in hot.items()])
        inside = rows.join(groups, "__node").filter("__at = hot").drop("hot")
        for n, (own, before, weight) in _descend(inside, "__own", 62, {n: want for n, (_, want) in hot.items()}).items():
            cuts[n] = (goals[n][0], hot[n][0], own + (2 * (hot[n][1] - before) > weight))
    return cuts


def _descend(rows: DataFrame, at: str, bits: int, goals: dict[int, float]) -> dict[int, tuple[int, int, int]]:
    """For each node the value of ``at`` at which running bytes pass its goal, the bytes before it and its own."""
    prefix = {n: 0 for n in goals}
    before = {n: 0 for n in goals}
    shift = bits
    while True:
        known, shift = shift, max(0, shift - DIGIT_BITS)
        state = _values(rows, "__node, prefix, start, goal", [(n, prefix[n], before[n], float(goals[n])) for n in goals])
        within = rows.join(state, "__node").filter(F.shiftright(at, known) == F.col("prefix"))
        picked = _passing(within, F.shiftright(at, shift))
        for n, r in picked.items():
            prefix[n], before[n] = r["part"], r["upto"] - r["bytes"]
        if shift and max(r["n"] for r in picked.values()) <= FEW_ROWS:
            state = _values(rows, "__node, prefix, start, goal", [(n, prefix[n], before[n], float(goals[n])) for n in goals])
            picked, shift = _passing(rows.join(state, "__node").filter(F.shiftright(at, shift) == F.col("prefix")), F.col(at)), 0
        if not shift:
            return {n: (r["part"], r["upto"] - r["bytes"], r["bytes"]) for n, r in picked.items()}


def _passing(rows: DataFrame, part: Column) -> dict[int, dict]:
    """For each node the part (the last one at most) within which bytes, running on from start, pass the goal."""
    window = Window.partitionBy("__node").orderBy("part")
    sums = rows.groupBy("__node", part.alias("part")).agg(F.sum("__size").alias("bytes"), F.count("*").alias("n"), F.first("start").alias("start"), F.first("goal").alias("goal"))
    running = sums.withColumn("upto", F.sum("bytes").over(window) + F.col("start")).withColumn("last", F.lead("part").over(window).isNull())
    passed = running.filter("(upto > goal and upto - bytes <= goal) or (last and upto <= goal)")
    return {r["__node"]: r for r in passed.collect()}


def slots(rows: DataFrame, counted: DataFrame, order: list[Column]) -> DataFrame:
    """slot: gapless numbers from 0 within each __shard. counted has the same __shard and __own columns, without texts.

    A shard's rows are numbered by pieces of about SLOT_ROWS rows and SLOT_BYTES bytes at most, by a hash of id and
    text, so that no task has to order a whole shard.
    """
    largest = counted.groupBy("__shard").agg(F.count("*").alias("rows"), F.sum("__size").alias("bytes")).agg(F.max("rows"), F.max("bytes")).first()
    pieces = max(1, math.ceil((largest[0] or 0) / SLOT_ROWS), math.ceil((largest[1] or 0) / SLOT_BYTES))
    piece = F.pmod(F.xxhash64("__own", "__at_bytes"), F.lit(pieces))
    sizes = counted.groupBy("__shard", piece.alias("__piece")).count()
    before = Window.partitionBy("__shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__shard", "__piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__shard", "__piece").orderBy(*order)
    numbered = rows.withColumn("__piece", piece).withColumn("__number", F.row_number().over(own) - 1)
    return numbered.join(sizes, ["__shard", "__piece"]).withColumn("slot", F.col("__before") + F.col("__number")).drop("__piece", "__before", "__number")


def shard_documents(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    size is the text's UTF-8 bytes (none if null) plus OVERHEAD; text_crc32 of a null text is that of no bytes, 0.
    Instead of a number of shards a target size may be given. Law ``bytes``: the shards' sizes come near each
    other; more shards may move any row, so grown_shard is null. Rows of equal text share a shard unless they weigh
    more than SLACK of one. Repeated rows are rows like others. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.col("text").cast("string")
    at = places(docs)
    light = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), *[v.alias(k) for k, v in at.items()]))
    tree = learn(light, shards or leaves(light, target_bytes), scratch)
    placed = light.withColumn("__shard", assign(tree))
    numbered = slots(placed, placed.select("__shard", "__own", "__at_bytes", "__size"), [F.col("doc_id"), F.col("text_crc32")])
    return numbered.select(
        "doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("__shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def leaves(light: DataFrame, target_bytes: int) -> int:
    return max(1, math.ceil((light.agg(F.sum("__size")).first()[0] or 0) / target_bytes))


def with_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """docs, with all columns, and shard and slot (replacing columns of these names)."""
    scratch = Scratch(docs.sparkSession, "shards")
    at = places(docs)
    light = scratch.keep(docs.select(*[v.alias(k) for k, v in at.items()]))
    tree = learn(light, shards or leaves(light, target_bytes), scratch)
    docs = docs.drop("shard", "slot")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    placed = docs.select(row.alias("row"), *[v.alias(k) for k, v in at.items()], F.col("doc_id").cast("long").alias("doc_id")).withColumn("__shard", assign(tree))
    numbered = slots(placed, light.select(assign(tree).alias("__shard"), "__own", "__at_bytes", "__size"), [F.col("doc_id"), F.col("__at_bytes")])
    return numbered.select("row.*", F.col("__shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
