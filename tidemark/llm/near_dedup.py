"""Near-duplicate documents: fast similarity sketching, banding, exact verification, connected components.

Sketch. Every shingle of a set is thrown into one of t bins in up to 2t rounds. In the first t rounds the bin is
random; in round t+j every shingle goes to bin j, so that every coordinate is filled in the end. A coordinate
keeps the smallest value (round first, then a hash), and a text stops after the round that filled its last bin.
Two sets agree on a coordinate with probability equal to their Jaccard similarity, with concentration as for
independent minhashes, at O(|set| + t log t) instead of O(|set| * t).

Banding. bands * rows coordinates; with 25 bands of 5, a pair at similarity 0.85 shares no band with
probability (1 - 0.85^5)^25 < 5e-7, and one at 0.95 with < 1e-16.

Verification without all pairs. Texts with equal shingle sets are one node. In each bucket some members are
pivots; every other member is compared with them on full shingle sets, links are contracted to components, and
the pivots leave the bucket, as all their links in it are known. A bucket whose members are all in one component
needs no further comparison.

A bucket may hold many texts that are near, but not near enough. What a first round with one pivot each leaves open
is therefore dealt anew by an exact filter: with the shingles of all these texts in one order, rare ones first, two
sets can only overlap enough if they share a shingle among the first few of each (how many follows from both sizes).
Each text enters the buckets of these shingles, by size classes; shingles of one text only make no bucket. Then
rounds go on, with eight times as many pivots each, until no bucket is left with members of two components. So no
pair that could join two components is left out, and no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.textblocks import PLACES, blocks, mix, shingle_sets, words
from tidemark.operators.cluster import connected_components, relabel

SHINGLE_WORDS = 5
BANDS, ROWS = 25, 5
SIMILARITY_PERCENT = 85
#: For the stage that filters a corpus: a pair at 0.8 shares no band with probability (1 - 0.8^5)^40 < 2e-7.
STAGE_PERCENT, STAGE_BANDS = 80, 40
#: Ids up to this many (8 bytes each, 16 with a label) are sent to every executor to pick texts or sets; beyond, these are shuffled to them.
BROADCAST_IDS = 2_000_000
#: Counters of shingle frequencies, one byte each; a shingle's rarity only sets the order in which prefixes are cut.
COUNTERS = 1 << 22
#: Ratio of set sizes within a class.
SIZE_CLASS = 1.02


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates for each set; the row of an empty set has no meaning."""
    out = np.full((len(sets), t), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    live = sizes > 0
    owner = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    flat = out.reshape(-1)
    for round_ in range(2 * t):
        use = live[owner]
        if not use.all():
            owner, items = owner[use], items[use]
        if not len(items):
            break
        h = mix(items + np.uint64((round_ + 1) * 0xD1B54A32D192ED03 % 2**64))
        bins = (h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24) if round_ < t else np.full(len(h), round_ - t, np.uint64)
        values = np.uint64(round_ << 40) | (h & np.uint64((1 << 40) - 1))
        np.minimum.at(flat, owner * t + bins.astype(np.int64), values)
        live &= (out == np.iinfo(np.uint64).max).any(axis=1)
    return out


def _set_key(s: np.ndarray) -> int:
    """One 64-bit key of a shingle set, equal for equal sets."""
    sums = np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64), len(s)], np.uint64)
    return int(mix((sums * PLACES[:3]).sum(dtype=np.uint64, keepdims=True))[0])


def _signatures(bands: int, rows: int, shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for block in blocks(batch.column("text")):
                sets = shingle_sets(words(block), block.texts, shingle)
                sketches = sketch(sets, bands * rows).reshape(len(sets), bands, rows)
                keys = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys + sketches[:, :, r])
                keys = mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
                full = np.array([len(s) > 0 for s in sets], bool)
                nodes = np.array([_set_key(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(block.first, block.texts),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(nodes, mask=~full),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].view(np.int64).reshape(-1))),
                    ],
                    schema=schema,
                )

    return run, "doc_id long, n_shingles long, node long, bands array<long>"


def _sets(shingle: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                sets = [s for s in shingle_sets(words(block), block.texts, shingle) if len(s)]
                nodes = np.array([_set_key(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run, "node long, shingles binary"


def _linked(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                if not len(p):
                    keep.append(False)
                    continue
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=schema)

    return run, "a long, b long"


#: A node in a bucket; place serves the exact filter only: set size, shingles behind and side of prefix_keys in one.
MEMBER = ("bucket", "node", "place")


def _place(column: str) -> dict[str, Column]:
    at = F.col(column)
    return {"size": F.shiftright(at, 32), "rest": F.shiftright(at, 2).bitwiseAND(F.lit((1 << 30) - 1)), "side": at.bitwiseAND(F.lit(3))}


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each counter, 255 standing for more: a table of COUNTERS bytes."""
    schema = pa.schema([("counter", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for value in batch.column("shingles"):
                np.add.at(total, (np.frombuffer(value.as_buffer(), np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], schema=schema)

    often = sets.mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).filter("n > 1")
    found = often.select(F.col("counter").cast("int").alias("counter"), F.least("n", F.lit(255)).cast("short").alias("n")).toArrow()
    table = np.ones(COUNTERS, np.uint8)
    table[found.column("counter").to_numpy()] = found.column("n").to_numpy().astype(np.uint8)
    return table


def size_class(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(SIZE_CLASS) + 1e-9))


def prefix_keys(s: np.ndarray, often: np.ndarray, percent: int, classes: frozenset[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set, two sets that overlap enough sharing one; for each the side and how many shingles come behind.

    A key is of a shingle and of two size classes (classes: those that occur). Side 2: both classes are the same;
    else 0 if the set is of the smaller class, 1 if of the larger.
    """
    n = len(s)
    count = often[(s % np.uint64(len(often))).astype(np.int64)]
    order = np.lexsort((s, count))
    s, count = s[order], count[order]
    own = size_class(n)
    keys, sides, rests = [s[:0]], [], []
    for other in range(size_class(max(1, -(-n * percent // 100))), size_class(n * 100 // percent) + 1):
        if other not in classes:
            continue
        least = max(-(-n * percent // 100), int(np.floor(SIZE_CLASS**other)))
        need = -(-percent * (n + least) // (100 + percent))
        at = np.flatnonzero(count[: max(0, n - need + 1)] > 1)
        pair = min(own, other) * int(PLACES[11]) + max(own, other) * int(PLACES[12])
        keys.append(mix(s[at] + np.uint64(pair % 2**64)))
        sides.append(np.full(len(at), 2 if own == other else int(own > other), np.int64))
        rests.append(n - 1 - at)
    return np.concatenate(keys), np.concatenate([*sides, np.zeros(0, np.int64)]), np.concatenate([*rests, np.zeros(0, np.int64)])


def _prefix_buckets(sets: DataFrame, percent: int) -> DataFrame:
    """bucket, node, place and label for the sets (node, shingles, label), by prefix_keys."""
    sizes = sets.select((F.length("shingles") / 8).cast("long").alias("n")).select(F.floor(F.log("n") / float(np.log(SIZE_CLASS)) + 1e-9).alias("c")).distinct()
    classes = frozenset(r["c"] for r in sizes.collect())  # at most a few thousand, whatever the number of sets
    often = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))
    schema = pa.schema([(c, pa.int64()) for c in (*MEMBER, "label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column("shingles")]
            found = [prefix_keys(s, often.value, percent, classes) for s in own]
            each = [len(f[0]) for f in found]
            keys, sides, rests = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            places = (np.repeat(np.array([len(s) for s in own], np.int64), each) << 32) | (rests << 2) | sides
            nodes, labels = (np.repeat(batch.column(c).to_numpy(), each) for c in ("node", "label"))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes), pa.array(places, pa.int64()), pa.array(labels)], schema=schema)

    return sets.mapInArrow(run, ", ".join(f"{c} long" for c in (*MEMBER, "label")))


def _label(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """nodes with the label of each, itself where it has none."""
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _several(labelled: DataFrame) -> DataFrame:
    """The buckets in which members that may be compared have more than one label."""
    found = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min(_place("place")["side"]).alias("low"), F.max(_place("place")["side"]).alias("high"))
    return found.filter("least < most and (high = 2 or low < high)").select("bucket")


def near_duplicates(
    docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = SIMILARITY_PERCENT, shingle: int = SHINGLE_WORDS, broadcast_ids: int = BROADCAST_IDS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id long, text string; more columns are left out).

    Two documents are linked if 100 * |common shingles| >= percent * |all shingles|, on full sets. component_id is
    the smallest doc_id reachable by links, kept tells whether it is the row's own. A null or wordless text has
    no shingles and is linked with nothing. Rows repeated with one doc_id are one document in the result's sense:
    each gets a row, and equal ones are all kept. A null doc_id is never a component_id unless the whole group has
    none. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _signatures(bands, rows, shingle)
    signed = scratch.keep(texts.mapInArrow(run, schema))
    classes = scratch.keep(signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.hash("doc_id"), "doc_id", "bands")).alias("pick")))
    spread = classes.select("node", F.explode("pick.bands").alias("bucket"))
    # written, so that the join by bucket is of two plain shuffles, which the engine splits where a bucket is hot
    shared = scratch.keep(spread.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("bucket"))
    anywhere = F.lit(2).cast("long").alias("place")  # every pair in a band's bucket may be compared
    members = scratch.keep(spread.join(shared, "bucket").select("bucket", "node", anywhere))

    sets = _needed_sets(texts, classes, members, scratch, shingle, broadcast_ids) if not members.isEmpty() else None
    n_sets = sets.count() if sets else 0
    labels = None
    pivots = 1
    while n := members.count():
        labelled = scratch.keep(_label(members, labels), n)
        chosen = labelled.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(pivots))).groupBy("bucket", "slot")
        chosen = chosen.agg(F.min(F.struct(F.xxhash64(F.lit(pivots), "node").alias("order"), *MEMBER[1:], "label")).alias("p"))
        chosen = scratch.keep(chosen.select("bucket", *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in (*MEMBER[1:], "label")]), n)
        # the first shared shingle of two sets that overlap enough has enough of both behind it
        own, other = _place("place"), _place("pivot_place")
        enough = (100 + percent) * (1 + F.least(own["rest"], other["rest"])) >= percent * (own["size"] + other["size"])
        apart = F.col("label") != F.col("pivot_label")
        pairs = labelled.join(chosen, "bucket").filter(apart & enough & ((own["side"] == 2) | (own["side"] != other["side"])))
        pairs = scratch.keep(pairs.select(F.col("pivot_node").alias("a"), F.col("node").alias("b")).distinct(), n)
        asked = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), n)
        # the first round asks for nearly all sets, the others for some of them
        some = sets.join(F.broadcast(asked), "node", "left_semi") if asked.count() <= min(n_sets // 2, broadcast_ids) else sets
        found = _verify(pairs, some, percent)
        if labels is None:
            labels = connected_components(found, scratch)
        else:
            ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}2")) for c in "ab"]
            ends = found.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
            moved = connected_components(ends, scratch)
            fresh = moved.join(labels, "node", "left_anti")
            labels = scratch.keep(relabel(labels, moved).union(fresh), n)
        left = members.join(chosen, (members.bucket == chosen.bucket) & (members.node == chosen.pivot_node), "left_anti")
        if pivots == 1:
            labelled_left = scratch.keep(_label(left, labels), n)
            open_ = scratch.keep(labelled_left.join(scratch.keep(_several(labelled_left), n), "bucket", "left_semi").select("node", "label").distinct(), n)
            # read three times: sets stay where they lie, or are written once
            open_sets = sets.join(F.broadcast(open_), "node") if open_.count() <= broadcast_ids else scratch.keep(sets.join(open_, "node"))
            left = scratch.keep(_prefix_buckets(open_sets, percent))
            scratch.drop(open_sets)
        else:
            left = scratch.keep(_label(left, labels), n)
        several = scratch.keep(_several(left), n)
        fresh = scratch.keep(left.join(several, "bucket", "left_semi").select(*MEMBER), n)
        scratch.drop(members, labelled, chosen, pairs, asked, left, several)
        members, pivots = fresh, pivots * 8

    groups = classes.select("node", "rep")
    if labels is None:
        groups = groups.withColumnRenamed("rep", "component_id")
    else:
        named = _label(groups, labels)
        least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
        groups = named.join(least, "label").select("node", "component_id")
    whole = signed.select("doc_id", "n_shingles", "node").join(groups, "node", "left")
    whole = whole.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return whole.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _needed_sets(texts: DataFrame, classes: DataFrame, members: DataFrame, scratch: Scratch, shingle: int, broadcast_ids: int) -> DataFrame:
    """The shingle sets of nodes that share a bucket, from the text of one document each."""
    nodes = members.select("node").distinct()
    wanted = scratch.keep(classes.join(nodes, "node", "left_semi").select("node", F.col("pick.doc_id").alias("doc_id")))
    ids = wanted.select("doc_id").distinct()
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    run, schema = _sets(shingle)
    made = texts.join(ids, texts.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("text").mapInArrow(run, schema)
    return scratch.keep(made.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    run, schema = _linked(percent)
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.length("shingles").alias("y_size"))
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.length("shingles").alias("x_size"))
    close = 100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size")
    return pairs.join(y, "b").join(x, "a").filter(close).select("a", "b", "x", "y").mapInArrow(run, schema)


def row_key(doc_id: Column, text: Column) -> Column:
    """Stands for a row's id and text."""
    return F.xxhash64(doc_id, text)


def keep_one_of_each(docs: DataFrame, percent: int = STAGE_PERCENT, bands: int = STAGE_BANDS, broadcast_ids: int = BROADCAST_IDS, **options) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id stays, with all its columns.

    Groups are of texts, whatever their ids: different texts under one doc_id, or under none, are grouped each for
    itself. A null doc_id comes after all others; ties go by a hash of doc_id and text. Rows equal in doc_id and
    text are one document: the first by a hash of all columns stays. Null and wordless texts are in no group and
    stay; those without a doc_id aren't taken for one document either. Different rows whose 64-bit keys clash are told
    apart by a second hash and all stay. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = row_key(doc_id, text)
    # near_duplicates takes the key of a row for its id, so that it sees texts under one id apart
    groups = near_duplicates(docs.select(key.alias("doc_id"), text.alias("text")), percent=percent, bands=bands, broadcast_ids=broadcast_ids, **options)
    groups = groups.select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = docs.groupBy(key.alias("key")).agg(F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"))).alias("least"), F.count("*").alias("rows"))
    first = groups.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("least", "key", "rows")).alias("first"))
    first = scratch.keep(first.select("first.key", "first.rows"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*own).alias("row"), key.alias("key"), F.xxhash64(*own).alias("order"), F.xxhash64(F.lit("again"), doc_id, text).alias("check"), (doc_id.isNull() & (text.isNull() | ~text.rlike(r"[^\x20\x09-\x0d]"))).alias("loose"))

    def of(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.withColumn("found", F.lit(True))
        return whole.join(F.broadcast(keys) if keys.count() <= broadcast_ids else keys, "key", how)

    kept = of(first.filter("rows = 1").select("key"), "left").filter("loose or found").select("row")
    several = first.filter("rows > 1").select("key")
    if not several.isEmpty():
        repeated = of(several, "inner").filter("not loose").groupBy("key", "check").agg(F.min_by("row", "order").alias("row"))  # each task passes on one copy of a row
        kept = kept.union(repeated.select("row"))
    return kept.select("row.*")
