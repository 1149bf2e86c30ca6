"""The trie of conversation prefixes, from sorted sequences and range minima of their common prefixes.

Each conversation is a sequence of digests of its turns. Sorted by sequence and id, the conversations that share a prefix
stand side by side: a prefix of depth d reaches left and right as far as the common prefixes of neighbours (LCPs) are at
least d long. Each candidate, a pair of neighbours and its LCP, searches both ends for itself by halving steps over a
sparse table of range minima; no stack runs over the rows.

The sorted rows lie in pieces of a bounded size. A piece knows its neighbours' border rows, so prefixes within it are
settled there. Prefixes across a border are few, at most one for each depth of the border's LCP: the piece where such a
prefix ends is found over the pieces' minima, by the same search, and a join with that piece's ends gives the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Conversations and turns of a piece, about; there are as many pieces as shuffle partitions at least.
PIECE_ROWS, PIECE_TURNS = 100_000, 2_000_000
#: Conversations of one family, and how many of their first turns may be shared.
FAMILY, MOST_SHARED = 20, 3
NO_ENDS = hashlib.sha256(b"").hexdigest()
DIGEST = 16
COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Rows that a piece gives: nodes (N), ends of prefixes to the right of its left border (R) and to the left of its right one (L), ids of a run that began before (H), the piece (P).
PARTS = (
    "kind string, piece long, depth long, conv_id long, parent_conv_id long, parent_border long, parent_depth long, n_convs long, n_children long, n_leaves long, saved_tokens long,"
    " words_before long, left_least long, right_least long, closed boolean, ends string"
)
FIELDS = [c.split()[0] for c in PARTS.split(", ")]
KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in PARTS.split(", ")])


class RangeMinima:
    """Minima of a[i : i + 2**k] for all i and k."""

    def __init__(self, a: np.ndarray):
        self.size, self.levels = len(a), [a]
        while 2 << (len(self.levels) - 1) <= len(a):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima from first to last, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << k) + 1])
        return out

    def before(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to at whose value is below the bound; -1 if there is none."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            start = at - (1 << k) + 1
            inside = start >= 0
            inside[inside] = self.levels[k][start[inside]] >= bound[inside]
            at[inside] -= 1 << k
        return at

    def after(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from at on whose value is below the bound; the size if there is none."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            inside = at + (1 << k) <= self.size
            inside[inside] = self.levels[k][at[inside]] >= bound[inside]
            at[inside] += 1 << k
        return at


def common_prefixes(turns: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of equal first turns of each row and the one before it (none for the first row)."""
    both = np.minimum(sizes[1:], sizes[:-1])
    starts = np.cumsum(both) - both
    within = np.arange(both.sum()) - np.repeat(starts, both)
    differs = np.flatnonzero((turns[np.repeat(begins[1:], both) + within] != turns[np.repeat(begins[:-1], both) + within]).any(axis=1))
    at = np.searchsorted(differs, starts)
    first = np.append(differs, len(within))[at]
    return np.minimum(first - starts, both)


class Piece:
    """Neighbouring rows in sorted order, with the border rows of the pieces beside it."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("pos").combine_chunks()
        pos = table["pos"].to_numpy()
        self.number = table["piece"][0].as_py()
        before, behind = int(pos[0] < 0), int(pos[-1] == BEHIND)
        n = self.n = len(pos) - before - behind
        self.conv = table["conv_id"].to_numpy()[before : before + n]
        keys, words = table["key"].combine_chunks(), table["words"].combine_chunks()
        sizes = pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(np.int64) // DIGEST
        begins = np.cumsum(sizes) - sizes
        data = b"".join(keys.to_pylist())
        lcp = common_prefixes(np.frombuffer(data, np.uint64).reshape(-1, 2), begins, sizes)
        #: lcp[i]: of rows i - 1 and i; -1 before the first row of all and behind the last.
        self.lcp = np.concatenate([[] if before else [-1], lcp, [] if behind else [-1]]).astype(np.int64)
        self.sizes, self.begins = sizes[before : before + n], begins[before : before + n]
        self.same = np.zeros(n, bool)  # as the row before
        own = np.arange(n)
        previous = np.concatenate([sizes[:1] if before else [-1], self.sizes[:-1]])
        self.same = (self.lcp[:n] == self.sizes) & (previous == self.sizes)
        self.words = np.concatenate([[0], np.cumsum(words.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
        self.shared_words = np.cumsum(self.words_to(own, np.maximum(self.lcp[:n], 0)))
        self.leaves = np.concatenate([[0], np.cumsum(self.lcp[1:] < self.sizes)])
        self.minima, self.ids = RangeMinima(self.lcp), RangeMinima(self.conv)
        self.breaks = np.append(np.flatnonzero(~self.same), n)

    def words_to(self, row: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Words of a row's first turns."""
        return self.words[self.begins[row] + turns] - self.words[self.begins[row]]

    def run(self, row: int) -> str:
        """Ids of the rows from this one on that have its sequence."""
        return ",".join(map(str, self.conv[row : self.breaks[np.searchsorted(self.breaks, row, "right")]].tolist()))

    def nodes(self) -> pa.Table:
        """Prefixes whose members all lie here. A parent that reaches across a border is named by border and depth."""
        n, lcp = self.n, self.lcp
        inner = np.arange(1, n)
        left, right = self.minima.before(inner, lcp[1:n]), self.minima.after(inner + 1, lcp[1:n]) - 1
        closed = (left >= 0) & (right < n)
        spans, group = np.unique(left[closed] * (n + 1) + right[closed], return_inverse=True)
        first, last = np.concatenate([spans // (n + 1), np.arange(n)]), np.concatenate([spans % (n + 1), np.arange(n)])
        branches = np.bincount(group, self.sizes[1:][closed] > lcp[1:n][closed], len(spans)).astype(np.int64)
        bottom = np.concatenate([np.zeros(len(spans), np.int64), self.sizes])
        bottom[group] = lcp[1:n][closed]
        branches = np.concatenate([branches + (self.sizes[first[: len(spans)]] > bottom[: len(spans)]), np.zeros(n, np.int64)])
        upper = np.maximum(lcp[first], lcp[last + 1])
        some = np.flatnonzero(bottom > upper)  # a row that another one begins with or equals has no prefix of its own
        first, last, bottom, upper, branches = first[some], last[some], bottom[some], upper[some], branches[some]
        least = self.ids.least(first, last)

        # The parent of a span's shallowest prefix is the prefix of the deeper neighbouring pair.
        pair = np.where(lcp[first] >= lcp[last + 1], first, last + 1)
        border = np.where(pair == 0, self.number, np.where(pair == n, self.number + 1, -1))
        within = np.flatnonzero(border < 0)
        at = pair[within] - 1
        border[within] = np.where(left[at] < 0, self.number, np.where(right[at] >= n, self.number + 1, -1))
        parent = np.full(len(first), -1)
        known = within[border[within] < 0]
        parent[known] = self.ids.least(left[pair[known] - 1], right[pair[known] - 1])

        ends = [NO_ENDS] * len(first)
        for k in np.flatnonzero(self.sizes[first] == bottom).tolist():
            ends[k] = hashlib.sha256(self.run(first[k]).encode()).hexdigest()
        depths = bottom - upper
        span = np.repeat(np.arange(len(first)), depths)
        depth = np.arange(len(span)) - np.repeat(np.cumsum(depths) - depths, depths) + upper[span] + 1
        top, deepest = depth == upper[span] + 1, depth == bottom[span]
        members = (last - first)[span] + 1
        shared = (self.shared_words[last] - self.shared_words[first])[span]
        root = depth == 0
        across = top & (border[span] >= 0) & ~root
        return self._table(
            "N", self.number, len(span), depth=depth, conv_id=least[span], n_convs=members, n_children=np.where(deepest, branches[span], 1),
            parent_conv_id=pa.array(np.where(top, parent[span], least[span]), mask=across | root), parent_border=pa.array(border[span], mask=~across), parent_depth=pa.array(depth - 1, mask=~across),
            n_leaves=(self.leaves[last + 1] - self.leaves[first])[span], saved_tokens=shared - (members - 1) * self.words_to(first[span], np.maximum(depth - 1, 0)),
            ends=pa.array(np.array(ends, object)[span], pa.string(), mask=~deepest).fill_null(NO_ENDS),
        )

    def right_ends(self) -> pa.Table:
        """Of prefixes across the left border: where they end here, and what of them lies here."""
        depth = np.arange(self.lcp[0] + 1)
        end = self.minima.after(np.ones(len(depth), np.int64), depth)
        closed = end <= self.n
        last = np.minimum(end, self.n) - 1
        deeper = np.array([(self.sizes[: e + 1] > d)[self.lcp[: e + 1] == d].sum() for d, e in zip(depth, last)], np.int64)
        return self._table(
            "R", self.number, len(depth), depth=depth, conv_id=self.ids.least(np.zeros(len(depth), np.int64), last), n_convs=last, n_children=deeper, n_leaves=self.leaves[last + 1], saved_tokens=self.shared_words[last], closed=closed
        )

    def left_ends(self) -> pa.Table:
        """Of prefixes across the right border: where they begin here, and what of them lies here."""
        n = self.n
        depth = np.arange(self.lcp[n] + 1)
        begin = self.minima.before(np.full(len(depth), n - 1), depth)
        closed, first = begin >= 0, np.maximum(begin, 0)
        deeper = np.array([(self.sizes[f] > d) + (self.sizes[f + 1 :] > d)[self.lcp[f + 1 : n] == d].sum() for d, f in zip(depth, first)], np.int64)
        ends = [self.run(f) if c and self.sizes[f] == d else None for d, f, c in zip(depth.tolist(), first.tolist(), closed.tolist())]
        return self._table(
            "L", self.number + 1, len(depth), depth=depth, conv_id=self.ids.least(first, np.full(len(depth), n - 1)), n_convs=first, n_children=deeper, n_leaves=self.leaves[first], saved_tokens=self.shared_words[first],
            words_before=self.words_to(first, np.maximum(depth - 1, 0)), closed=closed, ends=pa.array(ends, pa.string()),
        )

    def whole(self) -> pa.Table:
        """The piece, and ids of a run that goes on from the piece before."""
        least = int(self.lcp[: self.n].min())
        at_least = int((self.sizes > least)[self.lcp[: self.n] == least].sum())
        one = self._table("P", self.number, 1, conv_id=[int(self.conv.min())], n_convs=[self.n], n_children=[at_least], n_leaves=self.leaves[-1:], saved_tokens=self.shared_words[-1:], left_least=[least], right_least=[int(self.lcp[1:].min())])
        if not self.same[0]:
            return one
        return pa.concat_tables([one, self._table("H", self.number, 1, depth=self.sizes[:1], ends=[self.run(0)])])

    @staticmethod
    def _table(kind: str, piece: int, n: int, **columns) -> pa.Table:
        columns |= {"kind": [kind] * n, "piece": np.full(n, piece)}
        return pa.table([pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(n, f.type)) for f in SCHEMA], schema=SCHEMA)

    def parts(self) -> pa.Table:
        return pa.concat_tables([self.nodes(), self.right_ends(), self.left_ends(), self.whole()])


#: pos of the row behind a piece.
BEHIND = 1 << 40


class Pieces:
    """What is known of all pieces, a few numbers for each; finds the pieces where a prefix across a border begins and ends."""

    def __init__(self, rows: list):
        column = lambda name: np.array([r[name] for r in rows], np.int64)
        self.left, self.right, self.ids = RangeMinima(column("left_least")), RangeMinima(column("right_least")), RangeMinima(column("conv_id"))
        before = lambda name: np.concatenate([[0], np.cumsum(column(name))])
        self.rows, self.shared, self.leaves = before("n_convs"), before("saved_tokens"), before("n_leaves")
        #: Rows by (depth, piece) that branch off a prefix of the piece's least depth, summed.
        self.order = np.lexsort((np.arange(len(rows)), column("left_least")))
        self.keys = column("left_least")[self.order] * len(rows) + self.order
        self.branches = np.concatenate([[0], np.cumsum(column("n_children")[self.order])])

    def find(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For borders and depths: the first and last piece of the prefix, its rows, words and leaves up to there, and the least id and branches of pieces between."""
        for batch in batches:
            border, depth = batch.column("piece").to_numpy(), batch.column("depth").to_numpy()
            first, last = self.left.before(border - 1, depth), self.right.after(border, depth)
            some = last - first > 1
            least, branches = np.zeros(len(border), np.int64), np.zeros(len(border), np.int64)
            least[some] = self.ids.least(first[some] + 1, last[some] - 1)
            size = len(self.rows) - 1
            branches[some] = self.branches[np.searchsorted(self.keys, depth[some] * size + last[some], "left")] - self.branches[np.searchsorted(self.keys, depth[some] * size + first[some] + 1, "left")]
            differ = lambda a: pa.array(a[last] - a[first])
            columns = [batch.column("piece"), batch.column("depth"), pa.array(first), pa.array(last), pa.array(least, mask=~some), pa.array(branches), differ(self.rows), differ(self.shared), differ(self.leaves)]
            yield pa.RecordBatch.from_arrays(columns, ["border", "depth", "first", "last", "least", "between", "rows", "shared", "leaves"])

    FOUND = "border long, depth long, first long, last long, least long, between long, rows long, shared long, leaves long"


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (digest, words) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).alias("t"))
    return turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(spoken: DataFrame) -> DataFrame:
    """Each conversation with its first turns from the first of its family: conv_id, key, words."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = spoken.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    joined = spoken.withColumn("base", base).withColumn("h", shared.cast("int")).join(heads, "base", "left")
    turns = F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    built = joined.select("conv_id", turns.alias("turns"))
    return built.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), "")).alias("key"), F.transform("turns", lambda t: t.words.cast("int")).alias("words"))


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the packs of ids of each (border, depth), which come one after another."""
    key, running = None, None
    for batch in batches:
        done = []
        for border, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("border", "depth", "ends"))):
            if (border, depth) == key:
                running.update(b",")
            else:
                if key:
                    done.append((*key, running.hexdigest()))
                key, running = (border, depth), hashlib.sha256()
            running.update(ends.encode())
        yield _digests(done)
    if key:
        yield _digests([(*key, running.hexdigest())])


def _digests(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["border", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame, piece_rows: int = PIECE_ROWS, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations (conv_id, turn, role, text; other columns are left out).

    Turns are ordered by turn, null first, equal ones by the digest of role and text; null role or text is empty; a
    repeated row is a turn of its own. Rows without a conv_id take no part. Turns are equal if 128 bits of their SHA-256 are.
    An empty table has no conversation and so no row, not even a root. A conversation's digests (20 bytes a turn) are one row.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    built = scratch.keep(rebuilt(scratch.keep(sequences(conversations))))
    size = built.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("turns")).first()
    if not size.n:
        return spark.createDataFrame([], COLUMNS)
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.n // piece_rows), -(-size.turns // piece_turns))
    place = F.monotonically_increasing_id()
    ordered = built.repartitionByRange(count, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ordered = scratch.keep(ordered.select(F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"), "conv_id", "key", "words"))
    filled = [(r.part, k, r.n) for k, r in enumerate(ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect())]  # a row for each piece
    rows = ordered.join(F.broadcast(spark.createDataFrame(filled, "part long, piece long, n long")), "part")
    borders = rows.filter("pos = 0 OR pos = n - 1")
    own = ["conv_id", "key", "words"]
    beside = [borders.filter("pos = n - 1").select((F.col("piece") + 1).alias("piece"), F.lit(-1).cast("long").alias("pos"), *own), borders.filter("pos = 0").select((F.col("piece") - 1).alias("piece"), F.lit(BEHIND).alias("pos"), *own)]
    beside = beside[0].union(beside[1]).filter(F.col("piece").between(0, len(filled) - 1))
    rows.select("piece", "pos", *own).union(beside).groupBy("piece").applyInArrow(lambda table: Piece(table).parts(), PARTS).write.partitionBy("kind").parquet(scratch.path("parts"))

    def part(kind: str) -> DataFrame:
        return parts.filter(F.col("kind") == kind)

    parts = spark.read.schema(PARTS).parquet(scratch.path("parts"))
    pieces = Pieces(part("P").orderBy("piece").collect())
    found = part("R").select("piece", "depth").mapInArrow(pieces.find, Pieces.FOUND)
    left = part("L").filter("closed").select((F.col("piece") - 1).alias("first"), "depth", F.struct("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words_before", "ends").alias("l"))
    right = part("R").filter("closed").select(F.col("piece").alias("last"), "depth", F.struct("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens").alias("r"))
    members = F.col("rows") + F.col("r.n_convs") - F.col("l.n_convs") + 1
    across = found.join(left, ["first", "depth"]).join(right, ["last", "depth"]).select(
        "border", "depth", "first", F.least("least", "l.conv_id", "r.conv_id").alias("conv_id"), members.alias("n_convs"), (F.col("l.n_children") + F.col("between") + F.col("r.n_children")).alias("n_children"),
        (F.col("leaves") + F.col("r.n_leaves") - F.col("l.n_leaves")).alias("n_leaves"), (F.col("shared") + F.col("r.saved_tokens") - F.col("l.saved_tokens") - (members - 1) * F.col("l.words_before")).alias("saved_tokens"),
        F.col("l.ends").alias("ends"),
    )
    across = scratch.keep(across)
    begun = across.filter("first = border - 1")  # each prefix once, at the first border that it crosses
    packs = begun.filter("ends IS NOT NULL").select("border", "depth", "first", "ends")
    further = part("H").select(F.col("piece").alias("border"), "depth", "ends").join(across.select("border", "depth", F.col("first").alias("begin")), ["border", "depth"])
    packs = packs.union(further.select(F.col("begin") + 1, "depth", "border", "ends"))
    digests = packs.repartition("border", "depth").sortWithinPartitions("border", "depth", "first").mapInArrow(_digest_ends, "border long, depth long, ends_sha256 string")
    parents = across.select(F.col("border").alias("parent_border"), F.col("depth").alias("parent_depth"), F.col("conv_id").alias("parent"))
    begun = begun.drop("ends").join(digests, ["border", "depth"], "left").withColumn("parent_depth", F.col("depth") - 1).withColumn("parent_border", F.col("border"))
    begun = begun.join(parents, ["parent_border", "parent_depth"], "left").withColumn("parent_conv_id", F.col("parent")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    nodes = part("N").withColumnRenamed("ends", "ends_sha256")
    under = nodes.filter("parent_border IS NOT NULL").drop("parent_conv_id").join(parents.withColumnRenamed("parent", "parent_conv_id"), ["parent_border", "parent_depth"])
    columns = [c.split()[0] for c in COLUMNS.split(", ")]
    return nodes.filter("parent_border IS NULL").select(columns).union(under.select(columns)).union(begun.select(columns))
