"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents lie in blocks by hash; a document heavier than a quarter of its source's mean block is a block
of its own. A source's quota is the exact number of block draws that its target needs: as many passes over all blocks
as fit, then, in a permuted order, the blocks that fit into what is left, and one last draw for the remainder, which
takes single documents of one more block, largest first. A binary tree splits the quotas of all sources among the
output shards: each node hands its left child a multivariate hypergeometric draw from its own quotas, which is exactly
the share that a shuffle of all draws would have put there. A leaf's quota of a source is an interval of that source's
permuted draws, so that leaves hold disjoint draws; what a document is taken for is counted from the leaves' draws,
and rows are shuffled within a shard by hash.

What meets in one task is the table of sources, the blocks of one source (five times BLOCKS at most), or the documents
of one last block. Documents themselves are never shuffled while the table of draws is of broadcast size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
#: No source is repeated more often than this.
MOST_PASSES = 3
OUTPUT_SHARDS = 16
#: Documents in a block, about.
BLOCK_DOCS = 128
#: Blocks of a source (and of a block, where a source needs more) at most, a power of two.
BLOCK_BITS = 12
BLOCKS = 1 << BLOCK_BITS
#: Draws of all sources together stay below what a hypergeometric draw of numpy takes (10^9).
MOST_DRAWS = 900_000_000
#: Sources whose quotas one task splits.
GROUP_SOURCES = 10_000
#: Blocks (some 50 bytes each) up to which their draws are sent to every executor.
BROADCAST_BLOCKS = 500_000
#: The block of a source's last draw, which holds single documents.
REST = -(1 << 63)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, source_size, n_docs, target: shares of all words by weight, none above most times its size.

    Sources in order of code points (null last) take the weights in turn. Sources reach their limit in order of
    limit per weight, so the level at which the rest stand comes from running sums in that order.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("turn", turn).withColumn("weight", cycle[F.pmod(F.col("turn"), F.lit(len(weights)))])
    by = by.withColumn("limit", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "turn")
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.withColumn("room", F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    by = by.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", F.col("room") / F.col("open"))
    by = by.withColumn("within", F.col("level") * F.col("weight") <= F.col("limit"))
    level = F.min(F.when(F.col("within"), F.struct(F.col("limit") / F.col("weight"), "turn", "level"))).over(all_)["level"]
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def _digit(level: int, blocks: Column) -> Column:
    """The block of a document at a level: BLOCK_BITS of its hash."""
    return F.shiftright("place", BLOCK_BITS * level).bitwiseAND(F.lit(BLOCKS - 1)).bitwiseAND(blocks - 1)


def _blocks(n_docs: Column, most: int = BLOCKS) -> Column:
    """A power of two, most at most, with about BLOCK_DOCS documents each."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.pow(2.0, F.ceil(F.log2(n_docs / BLOCK_DOCS))))).cast("long")


def _block() -> Column:
    """The block of a document at level 0; a heavy document has one of its own, below 0."""
    heavy = F.col("size") * F.col("blocks") * 4 > F.col("source_size")
    return F.when(heavy, -1 - F.col("place").bitwiseAND(F.lit((1 << 62) - 1))).otherwise(_digit(0, F.col("blocks")))


def _same(*columns: str) -> Column:
    """Null-safe equality of columns with those that have an underscore before."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return condition


def choose(words: np.ndarray, single: np.ndarray, left: float) -> tuple[np.ndarray, int, float]:
    """Of blocks in permuted order those that fit into left words; the block for the remainder (-1: none), and the remainder.

    A block that is a single document can't be taken in part: it is taken for the remainder only if nothing else is
    there and that comes nearer.
    """
    taken = np.zeros(len(words), bool)
    for k, w in enumerate(words):
        if w <= left:
            taken[k] = True
            left -= w
    open_ = np.flatnonzero(~taken & ~single)
    if len(open_):
        return taken, int(open_[0]), left
    others = np.flatnonzero(~taken)
    if len(others):
        nearest = others[np.argmin(words[others])]
        taken[nearest] = words[nearest] < 2 * left
    return taken, -1, left


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """source, path, digit, n_docs of the blocks chosen (rest 0) and of the one to be taken in part (rest: words)."""
    pdf = pdf.sort_values(["order", "digit"], ignore_index=True)
    taken, last, left = choose(pdf.words.to_numpy(), pdf.digit.to_numpy() < 0, float(pdf.left.iloc[0]))
    pdf["rest"] = 0.0
    if last >= 0 and left > 0:
        taken[last] = True
        pdf.loc[last, "rest"] = left
    return pdf.loc[taken, ["source", "digit", "n_docs", "rest"]]


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Largest first, the documents of one block that still fit, then one more if that comes nearer."""
    pdf = pdf.sort_values(["size", "place"], ascending=[False, True], ignore_index=True)
    left = float(pdf.left.iloc[0])
    sizes, taken = pdf["size"].to_numpy(), np.zeros(len(pdf), bool)
    for k, size in enumerate(sizes):
        if size <= left:
            taken[k] = True
            left -= size
    rest = np.flatnonzero(~taken)
    if len(rest) and sizes[rest[-1]] < 2 * left:
        taken[rest[-1]] = True
    return pdf.loc[taken, ["place"]]


def split_quotas(quotas: np.ndarray, shards: int, seed: int, totals: np.ndarray | None = None) -> np.ndarray:
    """Quotas (one for each source) split among shards: an array of shards x sources whose columns sum to quotas.

    totals has the draws of each shard (by default as near to equal as can be); a node of the tree hands its left
    child as many draws as the shards below it have.
    """
    if totals is None:
        ends = int(quotas.sum()) * np.arange(shards + 1) // shards
        totals = np.diff(ends)
    if shards == 1:
        return quotas[None]
    half = shards // 2
    rng = np.random.Generator(np.random.PCG64([seed, shards, int(quotas.sum())]))
    left = int(totals[:half].sum())
    taken = rng.multivariate_hypergeometric(quotas, left, method="marginals") if left else np.zeros_like(quotas)
    return np.concatenate([split_quotas(taken, half, 2 * seed + 1, totals[:half]), split_quotas(quotas - taken, shards - half, 2 * seed + 2, totals[half:])])


def _group_totals(shards: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group", ignore_index=True)
        table = split_quotas(pdf.draws.to_numpy(np.int64), shards, seed)
        return pd.DataFrame({"group": pdf.group, "totals": list(table.T.tolist())})

    return run


def _leaves(shards: int, seed: int):
    """Of a group of sources the leaves' intervals: shard, source, first draw, draws."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["no_source", "source"], ignore_index=True)
        table = split_quotas(pdf.draws.to_numpy(np.int64), shards, seed + 1 + int(key[0]), np.array(pdf.totals.iloc[0], np.int64))
        firsts = np.cumsum(table, axis=0) - table
        shard, source = np.nonzero(table)
        return pd.DataFrame({"source": pdf.source.to_numpy()[source], "shard": shard, "first": firsts[shard, source], "draws": table[shard, source]})

    return run


def draw(drawable: DataFrame, shards: int, seed: int, sources: int) -> DataFrame:
    """source, block, pass, shard: the draws (source, block, pass) as the leaves of the splitting tree hold them."""
    order = Window.partitionBy("source").orderBy("pass", F.xxhash64(F.lit(seed), "pass", "block"), "block")
    drawn = drawable.withColumn("nth", F.row_number().over(order) - 1)
    groups = max(1, -(-sources // GROUP_SOURCES))
    quotas = drawable.groupBy("source").agg(F.count("*").alias("draws")).withColumn("no_source", F.col("source").isNull())
    quotas = quotas.withColumn("group", F.pmod(F.xxhash64("source"), F.lit(groups)))
    totals = quotas.groupBy("group").agg(F.sum("draws").alias("draws")).groupBy(F.lit(0).alias("all")).applyInPandas(_group_totals(shards, seed), "group long, totals array<long>")
    leaves = quotas.join(totals, "group").groupBy("group").applyInPandas(_leaves(shards, seed), "source string, shard int, first long, draws long")
    each = leaves.select(F.col("source").alias("_source"), "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("draws") - 1)).alias("_nth"))
    return drawn.join(each, _same("source", "nth")).select("source", "block", "pass", "shard")


@dataclass
class Mix:
    """rows: doc_id, source, size, place, source_size, target, block; draws: source, block, pass, shard; rest: places of last draws."""

    rows: DataFrame
    goal: DataFrame
    draws: DataFrame
    rest: DataFrame
    repeated: DataFrame | None


def placed(docs: DataFrame, seed: int) -> DataFrame:
    """row (all columns), doc_id, source, size, place (a hash of id, source and text), part for each row of docs."""
    doc_id, text, source = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    place = F.xxhash64(F.lit(seed), doc_id, source, text)
    return docs.select(row.alias("row"), doc_id.alias("doc_id"), source.alias("source"), word_count(text).alias("size"), place.alias("place"), F.spark_partition_id().alias("part"))


def _apart(rows: DataFrame, repeated: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with places of their own: rows that share one are numbered, by the parts they lie in, so that no task takes them all."""
    some = repeated.select(F.col("place").alias("_place"))
    same = F.col("place") == F.col("_place")
    hot = scratch.keep(rows.join(some, same, "left_semi"))
    by = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = hot.groupBy("place", "part").count().select(F.col("place").alias("_place"), F.col("part").alias("_part"), F.coalesce(F.sum("count").over(by), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("place", "part").orderBy(F.lit(0)))
    told = hot.withColumn("nth", nth).join(before, (F.col("place") == F.col("_place")) & (F.col("part") == F.col("_part")))
    told = told.withColumn("place", F.xxhash64("place", F.col("before") + F.col("nth"))).select(*rows.columns)
    return rows.join(some, same, "left_anti").union(told)


def plan(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...], most: int, shards: int, seed: int) -> Mix:
    """Rows with their blocks, and the draws that the tree's leaves hold."""
    light = scratch.keep(placed(docs, seed).drop("row"))
    repeated = scratch.keep(light.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1").select("place"))
    repeated = None if repeated.isEmpty() else repeated
    apart = light if repeated is None else _apart(light, repeated, scratch)
    sized = light if repeated is None else scratch.keep(apart)
    sized = sized.drop("part")
    goal = targets(sized, weights, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    goal = scratch.keep(goal)
    sources = goal.count()
    few = min(BLOCKS, 1 << max(0, (MOST_DRAWS // (5 * (most + 1) * max(sources, 1))).bit_length() - 1))
    goal = goal.withColumn("blocks", _blocks(F.col("n_docs"), few))
    key = goal.select(F.col("source").alias("_source"), "source_size", "target", "blocks")
    rows = sized.join(key, _same("source")).withColumn("block", _block()).drop("_source", "blocks")

    full = rows.filter("size > 0").groupBy("source", "block").agg(F.sum("size").alias("words"), F.count("*").alias("n_docs"))
    full = scratch.keep(full)
    left = goal.select(F.col("source").alias("_source"), "left", "passes")
    order = F.xxhash64(F.lit(seed), "digit").alias("order")
    chosen = "source string, digit long, n_docs long, rest double"
    here = full.join(left, _same("source")).filter("left > 0").withColumnRenamed("block", "digit").select("source", "digit", "words", "n_docs", "left", order)
    found = scratch.keep(here.groupBy("source").applyInPandas(_choose, chosen))
    partly = found.filter("rest > 0")
    inside = rows.filter("size > 0").join(partly.select(F.col("source").alias("_source"), F.col("digit").alias("_block"), "n_docs", F.col("rest").alias("left")), _same("source", "block"))
    inside = scratch.keep(inside.select("source", "size", "place", "n_docs", "left"))
    rest = []
    for level in range(1, 5):
        if (inside.agg(F.max("n_docs")).first()[0] or 0) <= 16 * BLOCK_DOCS:
            break
        parts = inside.withColumn("digit", _digit(level, _blocks(F.col("n_docs"))))
        sums = parts.groupBy("source", "digit").agg(F.sum("size").alias("words"), F.count("*").alias("n_docs"), F.first("left").alias("left"))
        below = scratch.keep(sums.withColumn("order", F.xxhash64(F.lit(seed + level), "digit")).groupBy("source").applyInPandas(_choose, chosen))
        to = below.select(F.col("source").alias("_source"), F.col("digit").alias("_digit"), F.col("n_docs").alias("_n"), "rest")
        met = scratch.keep(parts.join(to, _same("source", "digit")).select("source", "size", "place", F.col("_n").alias("n_docs"), "rest"))
        rest.append(met.filter("rest = 0").select("source", "place"))
        inside = met.filter("rest > 0").withColumnRenamed("rest", "left")
    single = inside.select("source", "size", "place", "left").groupBy("source").applyInPandas(lambda pdf: _fit(pdf).assign(source=pdf.source.iloc[0]), "place long, source string")
    rest.append(single.select("source", "place"))
    last = rest[0]
    for frame in rest[1:]:
        last = last.union(frame)
    last = scratch.keep(last)

    more = found.filter("rest = 0").select(F.col("source").alias("_source"), F.col("digit").alias("_block"), F.lit(1).alias("more"))
    times = full.join(left.select("_source", "passes"), _same("source")).drop("_source").join(more, _same("source", "block"), "left")
    times = times.withColumn("times", F.col("passes") + F.coalesce("more", F.lit(0))).filter("times > 0")
    drawable = times.select("source", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("pass"))
    ends = last.select("source").distinct().join(left.select("_source", "passes"), _same("source")).select("source", F.lit(REST).cast("long").alias("block"), (F.col("passes") + 1).alias("pass"))
    draws = scratch.keep(draw(scratch.keep(drawable.union(ends)), shards, seed, sources))
    return Mix(rows, goal, draws, last.select("place"), repeated)


def _by_block(draws: DataFrame) -> DataFrame:
    """For each block its draws (pass, shard), to be joined to documents; sent to every executor if they are few."""
    by = draws.groupBy(F.col("source").alias("_source"), F.col("block").alias("_block")).agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("drawn"))
    return F.broadcast(by) if draws.select("source", "block").distinct().count() <= BROADCAST_BLOCKS else by


def _drawn(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows (source, block, place, size and others) with ``drawn``: each draw of a leaf that takes the row; null if none does."""
    by = _by_block(mix.draws)
    last = mix.draws.filter(F.col("block") == REST).select(F.col("source").alias("_source"), F.struct("pass", "shard").alias("end"))
    rest = mix.rest.select(F.col("place").alias("_place"))
    rest = F.broadcast(rest) if rest.count() <= BROADCAST_BLOCKS else rest
    some = rows.join(by, _same("source", "block"), "left").drop("_source", "_block").join(rest, F.col("place") == F.col("_place"), "left")
    some = some.join(F.broadcast(last) if last.count() <= BROADCAST_BLOCKS else last, _same("source"), "left").drop("_source")
    ended = F.when(F.col("_place").isNotNull(), F.array("end")).otherwise(F.array().cast("array<struct<pass:bigint,shard:int>>"))
    none = F.array().cast("array<struct<pass:bigint,shard:int>>")
    return some.withColumn("drawn", F.when(F.col("size") > 0, F.concat(F.coalesce("drawn", none), ended)).otherwise(none)).drop("_place", "end")


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, shards: int = OUTPUT_SHARDS, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    size counts the words of the text (null: 0), target is the source's, taken the words of all draws that the leaves
    of the splitting tree hold of the document: a whole multiple of its size, at most ``most``. Rows without words are
    not drawn. Null is a source of its own. Rows repeated with one id, source and text are drawn each for itself. An
    empty table gives an empty result.
    """
    mix = plan(docs, Scratch(docs.sparkSession, "mixture"), weights, most, shards, seed)
    drawn = _drawn(mix.rows, mix)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("drawn")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, shards: int = OUTPUT_SHARDS, seed: int = 11) -> DataFrame:
    """The mix itself: docs, with all columns, a row for each draw, and mix_shard, mix_position (replacing columns of these names)."""
    scratch = Scratch(docs.sparkSession, "mixture")
    mix = plan(docs, scratch, weights, most, shards, seed)
    whole = placed(docs.drop("mix_shard", "mix_position"), seed)
    whole = whole if mix.repeated is None else _apart(whole, mix.repeated, scratch)
    key = mix.goal.select(F.col("source").alias("_source"), "source_size", "blocks")
    rows = whole.join(key, _same("source")).withColumn("block", _block()).drop("_source")
    each = _drawn(rows, mix).select("row", "place", F.explode("drawn").alias("at"))
    position = F.xxhash64(F.lit(seed), "at.shard", "place", "at.pass")
    return each.select("row.*", F.col("at.shard").alias("mix_shard"), position.alias("mix_position"))
