"""Exact top-k by inner product: norm-bucketed retrieval with length or coordinate pruning.

Vectors are grouped by length into buckets of a bounded number of rows, longest first. A query's k-th score against
a bounded seed (the longest vectors) is a lower bound theta on its k-th score overall. Against a bucket whose longest
vector has length L, a query q needs vectors at a cosine of at least theta / (|q| L): the bucket's local threshold.
Above 1 the bucket is skipped. If it is high, coordinate pruning: a vector can reach that cosine only if its largest
query coordinates lie in a feasible interval each. If it is low, length pruning: only the bucket's prefix of vectors
at least theta / |q| long can do. What is left is verified by exact products.

Queries and candidates meet in tiles: some blocks of queries and some buckets of neighbouring lengths are one group, so
that a task holds a bounded number of vectors, a block is sent once to a group of buckets, and a bucket once to a piece
of the queries. Components travel in the narrowest integers that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

K = 20
BUCKET_ROWS = 8192
QUERY_ROWS = 512
#: The longest vectors, against which every query gets its first bound.
SEED_ROWS = 4096
#: Buckets sorted in one task.
TASK_BUCKETS = 8
#: Local cosine threshold from which coordinates prune better than lengths, and how many of them are looked at.
COORDINATE_FROM = 0.75
FOCUS = 4
NONE = np.iinfo(np.int64).min
#: Length from which bounds aren't used, as products may leave the range of a long.
WIDE = 2.0**30


def lengths(whole: np.ndarray) -> np.ndarray:
    """Lengths of rows, of any finite components."""
    most = np.abs(whole).max(axis=1, initial=0)
    unit = whole / np.where(most > 0, most, 1)[:, None]
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt((unit * unit).sum(axis=1)), np.finfo(np.float64).max)


def quantised(scale: float = 64.0):
    """vec_id, norm, vector (bytes of doubles): components as floor(scale * x); vectors with a missing or non-finite one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(scale * flat)
                whole = np.where(np.isfinite(flat), np.clip(whole, -np.finfo(np.float64).max, np.finfo(np.float64).max), whole)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = (bad[ends] == bad[ends - sizes]) & column.is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(good)
            vectors = [whole[ends[r] - sizes[r] : ends[r]] for r in rows]
            norms = [float(lengths(v[None])[0]) for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array(norms, pa.float64()), pa.array([v.tobytes() for v in vectors], pa.binary())], ["vec_id", "norm", "vector"]
            )

    return run, "vec_id long, norm double, vector binary"


def narrow(matrix: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest kind that holds them all."""
    most = np.abs(matrix).max(initial=0)
    return matrix.astype(next((k for k, limit in (("<i1", 2**7), ("<i2", 2**15), ("<i4", 2**31)) if most < limit), "<f8"))


def _pack(rows: int):
    """Rows in their order into blocks: size, longest, ids, norms, vectors (zero-padded to one width), their kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            parts = [np.frombuffer(v, np.float64) for _, _, v in held]
            matrix = np.zeros((len(parts), max(map(len, parts))), np.float64)
            for k, v in enumerate(parts):
                matrix[k, : len(v)] = v
            matrix = narrow(matrix)
            ids, norms = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held])
            held.clear()
            values = [pa.array([len(ids)], pa.int32()), pa.array([norms.max()]), pa.array([ids.tobytes()], pa.binary()), pa.array([norms.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()), pa.array([matrix.dtype.str])]
            return pa.RecordBatch.from_arrays(values, ["size", "longest", "ids", "norms", "vectors", "kind"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "norm", "vector"))):
                held.append(row)
                if len(held) == rows:
                    yield block()
        if held:
            yield block()

    return run, "size int, longest double, ids binary, norms binary, vectors binary, kind string"


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"], np.float64), np.frombuffer(row["vectors"], row["kind"]).reshape(row["size"], -1)


def exact_products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows: in floating point where that is exact, in unbounded integers where 64 bits may not do.

    A product beyond the range of a long is given as the longest or smallest long.
    """
    width = max(p.shape[1], q.shape[1])
    p, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (p, q))
    most = [max(abs(float(m.max(initial=0))), abs(float(m.min(initial=0)))) for m in (p, q)]
    bound = most[0] * most[1] * max(width, 1)
    if bound < 2**62:
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        return (p.astype(kind) @ q.astype(kind).T).astype(np.int64)
    p, q = (np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (p, q))
    return np.array([[min(max(x, -(2**63)), 2**63 - 1) for x in row] for row in (p @ q.T).tolist()], np.int64).reshape(len(p), len(q))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -1 - scores[some]))[:k]]
    return np.lexsort((ids, -1 - scores))[:k]


def theta_from(ids: np.ndarray, vectors: np.ndarray, seed: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th best of the seed (itself aside) for each query, as score and id; NONE where the seed has fewer."""
    scores, holders = np.full(len(ids), NONE), np.full(len(ids), np.iinfo(np.int64).max)
    products = exact_products(vectors, seed[2])
    for row, own in enumerate(products):
        others = np.flatnonzero(seed[0] != ids[row])
        if len(others) >= k:
            last = others[best(own[others], seed[0][others], k)[-1]]
            scores[row], holders[row] = own[last], seed[0][last]
    return scores, holders


def search_bucket(q_ids, q_norms, q_vectors, theta, holder, p_ids, p_norms, p_vectors, k, coordinate_from=COORDINATE_FROM, focus=FOCUS):
    """(row of the query, places in the bucket, scores) of what reaches theta, k at most for each query.

    holder is the id that has theta: a row of that score counts up to this id, as ties go to smaller ids.
    """
    out = []
    if p_norms[0] > WIDE or (len(q_norms) and q_norms.max() > WIDE) or max(theta.max(initial=0), -int(theta.min(initial=0))) >= 2**62:
        theta_bound = np.zeros(len(theta))  # bounds in doubles say nothing here: every product is verified
    else:
        theta_bound = theta
    unit = p_vectors / np.maximum(p_norms, 1e-300)[:, None]
    slack = 1e-9
    longest = p_norms[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(theta_bound > 0, theta_bound / (q_norms * longest), 0.0)
        least = np.where(theta_bound > 0, theta_bound / q_norms, 0.0) * (1 - slack)
    open_ = np.flatnonzero(~(local > 1 + slack))
    by_coordinate = [r for r in open_ if local[r] >= coordinate_from]
    by_length = np.array([r for r in open_ if local[r] < coordinate_from], np.int64)
    for r in by_coordinate:
        q = q_vectors[r, : unit.shape[1]] / q_norms[r]
        some = np.arange(np.searchsorted(-p_norms, -least[r], "right"))
        turn = np.arccos(min(1.0, local[r] * (1 - slack)))  # at most this far is a vector turned from the query
        for f in np.argsort(-np.abs(q))[:focus]:
            angle = np.arccos(np.clip(q[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + turn)) - slack, np.cos(max(0.0, angle - turn)) + slack
            some = some[(unit[some, f] >= low) & (unit[some, f] <= high)]
        scores = exact_products(p_vectors[some], q_vectors[r : r + 1])[:, 0]
        use = ((scores > theta[r]) | (scores == theta[r]) & (p_ids[some] <= holder[r])) & (p_ids[some] != q_ids[r])
        out.append((r, some[use], scores[use]))
    if len(by_length):
        upto = np.searchsorted(-p_norms, -least[by_length], "right")
        products = exact_products(q_vectors[by_length], p_vectors[: upto.max(initial=0)])
        for at, r in enumerate(by_length):
            scores = products[at, : upto[at]]
            ids = p_ids[: upto[at]]
            use = np.flatnonzero(((scores > theta[r]) | (scores == theta[r]) & (ids <= holder[r])) & (ids != q_ids[r]))
            out.append((r, use, scores[use]))
    return [(r, some[keep], scores[keep]) for r, some, scores in out for keep in [best(scores, p_ids[some], k)] if len(keep)]


def _search(k: int):
    """Query blocks beside buckets, to each query's k best among them."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(blocks: pa.Table, buckets: pa.Table) -> pa.Table:
        parts = []
        held = [_unpack(row) + (row["longest"],) for row in buckets.to_pylist()]
        for row in blocks.to_pylist():
            q_ids, q_norms, q_vectors = _unpack(row)
            theta, holder = np.frombuffer(row["theta"], np.int64).reshape(2, -1)
            rows, ids, scores = [], [], []
            for p_ids, p_norms, p_vectors, longest in held:
                if longest >= row["need"]:
                    for r, places, found in search_bucket(q_ids, q_norms, q_vectors, theta, holder, p_ids, p_norms, p_vectors, k):
                        rows.append(np.full(len(places), r))
                        ids.append(p_ids[places])
                        scores.append(found)
            if rows:
                r, i, s = np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)
                order = np.lexsort((i, -1 - s, r))  # -1 - s: no long overflows
                r, i, s = r[order], i[order], s[order]
                nth = np.arange(len(r)) - np.searchsorted(r, r, "left")
                parts.append(pa.Table.from_arrays([pa.array(q_ids[r[nth < k]]), pa.array(i[nth < k]), pa.array(s[nth < k])], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run, "query_id long, vec_id long, score long"


def _with_theta(k: int, seed: tuple):
    """Adds theta to query blocks, and the least length that any of a block's queries needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            thetas, needs = [], []
            for row in batch.to_pylist():
                ids, norms, vectors = _unpack(row)
                theta, holder = theta_from(ids, vectors, seed, k)
                with np.errstate(divide="ignore", invalid="ignore"):
                    needs.append(float(np.where(theta > 0, theta / norms, 0.0).min()) * (1 - 1e-9) if norms.max() <= WIDE and theta.max() < 2**62 else 0.0)
                thetas.append(np.stack([theta, holder]).astype(np.int64).tobytes())
            columns = [batch.column(c) for c in ("size", "ids", "norms", "vectors", "kind")] + [pa.array(thetas, pa.binary()), pa.array(needs, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["size", "ids", "norms", "vectors", "kind", "theta", "need"])

    return run, "size int, ids binary, norms binary, vectors binary, kind string, theta binary, need double"


def top_k(vectors: DataFrame, is_query, k: int = K, scale: float = 64.0, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query (a condition on vec_id) its k best among all others.

    score is the integer inner product of floor(scale * x), with exact integers whatever their size; one beyond the
    range of a long counts as the largest or smallest long. Ties go to the smaller vec_id; fewer rows than k are all
    given. Vectors that are null or hold a null or non-finite component take no part; of unequal lengths the shorter
    counts as padded with zeros. Rows repeated with one vec_id are told apart only by vector: a row is never its own
    partner, nor are others of its id. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    run, schema = quantised(scale)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null")
    clean = scratch.keep(rows.mapInArrow(run, schema))
    n = clean.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pack, packed = _pack(bucket_rows)
    parts = -(-n // (bucket_rows * TASK_BUCKETS))
    order = [F.desc("norm"), F.asc("vec_id")]
    number = F.monotonically_increasing_id()  # the partition is in its high bits
    buckets = clean.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, packed)
    buckets = scratch.keep(buckets.withColumn("group", F.shiftright(number, 33)))
    longest = clean.orderBy(*order).limit(SEED_ROWS).mapInArrow(_pack(SEED_ROWS)[0], packed).collect()[0]
    seed = _unpack(longest)
    pack, packed = _pack(query_rows)
    queries = clean.filter(is_query)
    asked = max(1, -(-queries.count() // (query_rows * TASK_BUCKETS)))
    run, schema = _with_theta(k, seed)
    blocks = scratch.keep(queries.repartitionByRange(asked, "vec_id").mapInArrow(pack, packed).mapInArrow(run, schema).withColumn("piece", F.shiftright(number, 33)))
    # which pieces of the queries meet which groups of buckets: small tables of a row for each, by length
    kinds = buckets.groupBy("group").agg(F.max("longest").alias("longest"))
    spread = scratch.keep(blocks.groupBy("piece").agg(F.min("need").alias("need")).join(kinds, F.col("longest") >= F.col("need")).select("piece", "group"))
    run, schema = _search(k)
    found = blocks.join(spread, "piece").groupBy("group", "piece").cogroup(buckets.join(spread, "group").groupBy("group", "piece")).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
