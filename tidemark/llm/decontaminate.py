"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, marks and digits of any script, lower-cased. Seeds are all runs of min_match tokens of the
benchmark; a document's seeds are found by a vectorised look-up of their hashes in the seed table (a map-side join:
nothing of a document is shuffled). For each document and each test item that share enough, tiles are laid as Running
Karp-Rabin lays them: the longest common run of tokens not yet covered on either side is marked first, then the next
longest, down to min_match; what is laid is compared token by token. The share of the item's tokens under tiles is its
coverage. Because tiles may lie in any order, a passage whose sentences were moved about is covered all the same.

An item covered to the threshold has at least so many seeds in common as tiles of min_match tokens would need, so its
commonest seeds, one fewer than that, need not be looked up: a phrase that many items share doesn't lead to all of
them. Once an item is found by a rarer seed, all its seeds count.

The seed table is sent to executors in slices of a bounded number of seeds, whole items at a time. A larger benchmark
takes more passes over the documents, one after the other: the driver holds one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.textblocks import blocks, ngrams, words

MIN_MATCH = 5
THRESHOLD = 0.5
#: Seeds in one slice (24 bytes each).
SLICE_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """The text's tokens, lower-cased, with a space between them."""
    return F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{M}\p{N}]+", " ")


@dataclass
class SeedTable:
    """Items with their ids, tokens and seeds, and the seeds to be looked up, sorted by hash, with their items.

    seed_length is min_match; in a table of shorter items, which are looked up whole, their number of tokens.
    """

    seed_length: int
    ids: np.ndarray
    words: list[list[bytes]]
    seeds: list[np.ndarray]
    hash: np.ndarray
    item: np.ndarray


def needed(n_tokens: int, min_match: int, threshold: float) -> int:
    """Seeds that an item has in common at least with what covers it to the threshold."""
    return max(1, int(np.ceil(np.ceil(threshold * n_tokens - 1e-9) / min_match - 1e-9)))


def _table(ids: list, texts: list[str], seed_length: int, min_match: int, threshold: float) -> SeedTable:
    of, seeds = [t.encode().split() for t in texts], []
    for block in blocks(pa.array(texts, pa.string())):
        h, at = ngrams(w := words(block, fold=False), seed_length)
        cuts = np.searchsorted(w.text[at], np.arange(block.texts + 1))
        seeds += [h[a:b] for a, b in zip(cuts, cuts[1:])]
    flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    values, counts = np.unique(flat, return_counts=True)
    hashes, items = [], []
    for k, own in enumerate(seeds):
        distinct = np.unique(own)
        common = counts[np.searchsorted(values, distinct)]
        spare = needed(len(of[k]), min_match, threshold) - 1 - (len(own) - len(distinct))  # repeats may stand for several
        rare = distinct[np.lexsort((distinct, common))][: len(distinct) - max(0, spare)]
        hashes.append(rare)
        items.append(np.full(len(rare), k))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    return SeedTable(seed_length, np.array(ids, dtype=object), of, seeds, h[order], (np.concatenate(items) if items else np.zeros(0, np.int64))[order])


def seed_tables(benchmark: DataFrame, min_match: int, slice_seeds: int, threshold: float = THRESHOLD) -> Iterator[SeedTable]:
    """Seed tables over all items, built from the benchmark a bounded piece at a time.

    An item of fewer than min_match tokens is looked up as a whole. One without tokens, or null, can't be found. Rows
    repeated with one item_id count as items of their own.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("text")).filter("item_id is not null and text is not null")
    held: dict[int, list] = {}
    size = 0

    def tables() -> Iterator[SeedTable]:
        for n, items in sorted(held.items()):
            yield _table([i for i, _ in items], [t for _, t in items], n, min_match, threshold)
        held.clear()

    for row in rows.toLocalIterator(prefetchPartitions=False):
        n = len(row.text.split())
        if n:
            held.setdefault(min(n, min_match), []).append((row.item_id, row.text))
            size += n
        if size >= slice_seeds:
            yield from tables()
            size = 0
    yield from tables()


def tile(doc_at: np.ndarray, item_at: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, tokens) from the places where seeds match.

    A maximal common run of n tokens shows as n - min_match + 1 matching seeds in a row on one diagonal. Of what
    is left of all runs the longest becomes a tile (ties: earlier in the item, then in the document); what it
    covers is cut from the others.
    """
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    breaks = np.flatnonzero((np.diff(d - i) != 0) | (np.diff(d) != 1)) + 1
    firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(d)]])
    runs = [(int(d[a]), int(i[a]), int(b - a) + min_match - 1) for a, b in zip(firsts, lasts)]
    return lay(runs, min_match)


def lay(runs: list[tuple[int, int, int]], min_match: int) -> list[tuple[int, int, int]]:
    import heapq

    heap = [(-n, i, d) for d, i, n in runs]
    heapq.heapify(heap)
    doc_used: set[int] = set()
    item_used: set[int] = set()
    tiles = []
    while heap:
        size, i, d = heapq.heappop(heap)
        size = -size
        free = [d + k not in doc_used and i + k not in item_used for k in range(size)]
        if all(free):
            tiles.append((d, i, size))
            doc_used.update(range(d, d + size))
            item_used.update(range(i, i + size))
            continue
        at = 0
        while at < size:
            end = at
            while end < size and free[end]:
                end += 1
            if end - at >= min_match:
                heapq.heappush(heap, (at - end, i + at, d + at))
            at = end + 1
    return tiles


def matches(column: pa.Array, table: SeedTable, min_match: int, threshold: float) -> Iterator[tuple[int, int, int, int, list[tuple[int, int, int]]]]:
    """(row, item index, tokens covered, tokens of the item, tiles) for each tokenised text and item covered to the threshold."""
    if not len(table.hash):
        return
    for block in blocks(column):
        w = words(block, fold=False)
        h, at = ngrams(w, table.seed_length)
        low = np.searchsorted(table.hash, h, "left")
        hit = np.flatnonzero(table.hash[np.minimum(low, len(table.hash) - 1)] == h)
        if not len(hit):
            continue
        # a text's distinct seeds only, and of these the items
        text, seed = np.unique(np.stack([w.text[at[hit]], low[hit]]), axis=1)
        each = np.searchsorted(table.hash, table.hash[seed], "right") - seed
        item = table.item[np.repeat(seed - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())]
        pairs = np.unique(np.stack([np.repeat(text, each), item]), axis=1)
        firsts = np.concatenate([[0], np.cumsum(w.per_text)])
        cuts = np.searchsorted(w.text[at], np.arange(block.texts + 1))
        last, order, own = -1, None, None
        for t, k in pairs.T.tolist():
            if t != last:
                last, own = t, h[cuts[t] : cuts[t + 1]]
                order = np.argsort(own, kind="stable")
                own = own[order]
            a, b = np.searchsorted(own, table.seeds[k], "left"), np.searchsorted(own, table.seeds[k], "right")
            n = b - a
            item_at = np.repeat(np.arange(len(n)), n)
            doc_at = order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] + (at[cuts[t]] - firsts[t])
            size = len(table.words[k])
            reach = np.unique((np.flatnonzero(n)[:, None] + np.arange(table.seed_length)).reshape(-1))
            if len(reach) < threshold * size:  # tiles lie within these tokens
                continue
            tiles = [x for x in tile(doc_at, item_at, table.seed_length) if _equal(block, w, int(firsts[t]) + x[0], table.words[k][x[1] : x[1] + x[2]])]
            covered = sum(n for _, _, n in tiles)
            if covered >= threshold * size:
                yield block.first + t, k, covered, size, tiles


def _equal(block, w, first: int, of: list[bytes]) -> bool:
    return all(block.data[w.start[first + k] : w.end[first + k]].tobytes() == word for k, word in enumerate(of))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, slice_seeds: int = SLICE_SEEDS) -> DataFrame:
    """Every pair of a document and a test item that its tiles cover to the threshold.

    doc_id, item_id, covered_tokens, item_tokens, coverage, n_tiles, tiles (doc_token, item_token, tokens).
    Null or empty texts match nothing; repeated rows each give their pairs; an empty table or benchmark gives none.
    """
    schema = "doc_id long, item_id long, covered_tokens int, item_tokens int, coverage double, n_tiles int, tiles array<struct<doc_token:int,item_token:int,tokens:int>>"
    kind = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered_tokens", pa.int32()), ("item_tokens", pa.int32()), ("coverage", pa.float64()), ("n_tiles", pa.int32())]
        + [("tiles", pa.list_(pa.struct([("doc_token", pa.int32()), ("item_token", pa.int32()), ("tokens", pa.int32())])))]
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("text"))

    def search(table: SeedTable) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                rows = [
                    {"doc_id": ids[row].as_py(), "item_id": int(table.ids[item]), "covered_tokens": covered, "item_tokens": tokens, "coverage": covered / tokens, "n_tiles": len(tiles)}
                    | {"tiles": [dict(zip(("doc_token", "item_token", "tokens"), t)) for t in tiles]}
                    for row, item, covered, tokens, tiles in matches(batch.column("text"), table, min_match, threshold)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

        return texts.mapInArrow(run, schema)

    return _each_slice(docs, seed_tables(benchmark, min_match, slice_seeds, threshold), search, schema)


def _each_slice(docs: DataFrame, tables: Iterator[SeedTable], search, schema: str) -> DataFrame:
    """What search finds with each table. Of several tables all results are written, so that none is held longer."""
    scratch, parts = Scratch(docs.sparkSession, "decontamination"), []
    table = next(tables, None)
    while table is not None:
        following = next(tables, None)
        found = search(table)
        parts.append(found if following is None and not parts else scratch.keep(found))
        table = following
    whole = docs.sparkSession.createDataFrame([], schema) if not parts else parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def is_contaminated(text: Column, table: SeedTable, min_match: int, threshold: float) -> Column:
    @F.arrow_udf("boolean")
    def run(column: pa.Array) -> pa.Array:
        flags = np.zeros(len(column), bool)
        for row, *_ in matches(column, table, min_match, threshold):
            flags[row] = True
        return pa.array(flags)

    return run(tokens(text))


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, slice_seeds: int = SLICE_SEEDS) -> DataFrame:
    """docs, with all columns, without the rows that hold a test item to the threshold, whether the item has an id or not.

    With one slice of seeds rows are filtered where they are; with several, the texts found are known by two hashes.
    """
    items = benchmark.select(F.lit(0).alias("item_id"), "text")
    tables = seed_tables(items, min_match, slice_seeds, threshold)
    first, second = next(tables, None), next(tables, None)
    text = F.col("text").cast("string")
    if first is None:
        return docs
    if second is None:
        return docs.filter(~is_contaminated(text, first, min_match, threshold))

    def every() -> Iterator[SeedTable]:
        yield first
        yield second
        yield from tables

    keys = {"__held": F.xxhash64(text), "__also": F.xxhash64(F.lit(3), text)}

    def search(table: SeedTable) -> DataFrame:
        return docs.filter(is_contaminated(text, table, min_match, threshold)).select(*[v.alias(k) for k, v in keys.items()])

    held = _each_slice(docs, every(), search, "__held long, __also long").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(row.alias("row"), *[v.alias(k) for k, v in keys.items()])
    return named.join(held, ["__held", "__also"], "left_anti").select("row.*")
