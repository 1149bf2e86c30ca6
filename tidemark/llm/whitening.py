"""Whitening of embeddings with block matrices.

Rows are packed into blocks where they lie, which indexes them, and centred block by block; the blocks' transposed product
is their scatter, whose eigenvectors (a matrix of dimensions by dimensions, on the driver) over the roots of the eigenvalues
are the whitening matrix; a second block product projects the rows. A slab of a bounded number of blocks is one block
matrix, as Spark deals the result of a product to about the root of its partitions; a job works on many slabs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Components that are returned.
COMPONENTS = 16
#: Rows of a block, blocks of a slab, slabs of a job.
BLOCK_ROWS, SLAB_BLOCKS, JOB_SLABS = 1024, 256, 64
#: Rows of a task that packs blocks, at least, so that few blocks are filled up with zeros.
PACKED_ROWS = 8192
#: Columns of a block.
BLOCK_COLUMNS = 1024
#: Scaled entries are kept within this size, so that they are longs.
LARGEST = float(2**61)
#: An eigenvalue below this share of the largest is none.
LEAST_EIGENVALUE = 1e-13
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame, scale: float, offset: int) -> DataFrame:
    """vec_id, x: floor(scale * entry) + offset of each entry, for rows whose vector is whole and finite."""
    vector = F.col("embedding").cast("array<double>")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    bounded = lambda c: F.greatest(F.least(F.floor(c * F.lit(scale)).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    return usable.select("vec_id", F.transform("v", lambda c: bounded(c).cast("long") + F.lit(offset)).alias("x"))


def _pack(width: int, block_rows: int):
    """Rows of a task to blocks: part (the task), seq, n, x (n rows of longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, np.zeros((0, width), np.int64)

        def block(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["part", "seq", "n", "x"])

        for batch in batches:
            held = np.concatenate([held, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)])
            while len(held) >= block_rows:
                yield block(held[:block_rows])
                seq, held = seq + 1, held[block_rows:]
        if len(held):
            yield block(held)

    return run, "part int, seq long, n int, x binary"


def _sums(width: int):
    """Sums of each dimension over the blocks of a batch, as decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [0] * width
            for x in batch.column("x").to_pylist():
                rows = np.frombuffer(x, np.int64).reshape(-1, width)
                safe = np.abs(rows).max() < 2**62 // len(rows)
                total = [a + int(b) for a, b in zip(total, (rows if safe else rows.astype(object)).sum(axis=0))]
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(map(str, total)), pa.string())], ["k", "s"])

    return run, "k int, s string"


class Centring:
    """n * x - sums for the rows of a block, exactly; firsts: the number of each part's first block."""

    def __init__(self, n: int, sums: list[int], firsts: dict[int, int]):
        self.n, self.sums, self.firsts = n, sums, firsts

    def apart(self, x: bytes) -> tuple[np.ndarray, np.ndarray]:
        rows = np.frombuffer(x, np.int64).reshape(-1, len(self.sums))
        most = max(int(rows.max()), -int(rows.min())) * self.n + max(map(abs, self.sums))
        return rows, rows * np.int64(self.n) - np.array(self.sums, np.int64) if most < 2**62 else rows.astype(object) * self.n - np.array(self.sums, object)

    def blocks(self, block_rows: int, slab_blocks: int):
        """block, slab, values: centred rows as doubles, filled up with zeros, which add nothing to a scatter."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = np.array([self.firsts[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("seq").to_numpy()
                values = []
                for x in batch.column("x").to_pylist():
                    whole = np.zeros((block_rows, len(self.sums)))
                    centred = (self.apart(x)[1] / self.n).astype(np.float64)
                    whole[: len(centred)] = centred
                    values.append(whole.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(numbers // slab_blocks), pa.array(values, pa.binary())], ["block", "slab", "values"])

        return run, "block long, slab long, values binary"

    def rows(self, block_rows: int):
        """index, x, deviation: the squared length of n * x - sums, null beyond a long."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, seq, x in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "x"))):
                    rows, apart = self.apart(x)
                    if int(max(apart.max(), -apart.min())) ** 2 * len(self.sums) < 2**63:
                        deviations = (apart * apart).sum(axis=1).tolist()
                    else:
                        deviations = [d if d < 2**63 else None for d in (sum(int(c) ** 2 for c in row) for row in apart)]
                    index = (self.firsts[part] + seq) * block_rows + np.arange(len(rows))
                    lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(self.sums), dtype=np.int32), pa.array(rows.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(index), lists, pa.array(deviations, pa.int64())], ["index", "x", "deviation"])

        return run, "index long, x array<long>, deviation long"


class Slabs:
    """The centred blocks, a folder for each slab of them."""

    def __init__(self, spark: SparkSession, path: str, blocks: int, width: int, block_rows: int, slab_blocks: int):
        self.spark, self.path, self.blocks, self.width, self.block_rows, self.slab_blocks = spark, path, blocks, width, block_rows, slab_blocks

    def jobs(self, slabs_at_once: int) -> Iterator[list[tuple[int, BlockMatrix]]]:
        """(first row, matrix) of the slabs that one job works on."""
        count = -(-self.blocks // self.slab_blocks)
        for first in range(0, count, slabs_at_once):
            yield [(k * self.slab_blocks * self.block_rows, self._matrix(k)) for k in range(first, min(count, first + slabs_at_once))]

    def _matrix(self, k: int) -> BlockMatrix:
        first, rows, width = k * self.slab_blocks, self.block_rows, self.width
        side = min(width, BLOCK_COLUMNS)

        def pieces(row):
            whole = np.frombuffer(row.values, np.float64).reshape(rows, width)
            for j in range(0, width, side):
                part = whole[:, j : j + side]
                yield (row.block - first, j // side), DenseMatrix(rows, part.shape[1], part.ravel(), True)

        read = self.spark.read.schema("block long, values binary").parquet(f"{self.path}/slab={k}")
        return BlockMatrix(read.rdd.flatMap(pieces), rows, side, min(self.slab_blocks, self.blocks - first) * rows, width)


def _scatter(slabs: Slabs, slabs_at_once: int) -> np.ndarray:
    """Sum of the slabs' transposed products, in the order of the slabs."""
    context, total = slabs.spark.sparkContext, np.zeros((slabs.width, slabs.width))
    for job in slabs.jobs(slabs_at_once):
        products = []
        for _, matrix in job:
            # The last argument deals the common dimension, the rows, to that many tasks; the public method lacks it.
            product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, matrix.numRowBlocks)
            side = min(slabs.width, BLOCK_COLUMNS)
            products.append(BlockMatrix(product, side, side).blocks.map(lambda b: (b[0], b[1].toArray())))
        summed = context.union(products).reduceByKey(lambda a, b: a + b)
        for (i, j), block in summed.collect():  # dimensions by dimensions, whatever the number of rows
            total[i * side : i * side + block.shape[0], j * side : j * side + block.shape[1]] += block
    return (total + total.T) / 2


def _projected(slabs: Slabs, matrix: np.ndarray, slabs_at_once: int, scratch: Scratch) -> DataFrame:
    """index, z: the rows times a matrix."""
    spark, path, side = slabs.spark, scratch.path("projected"), min(slabs.width, BLOCK_COLUMNS)
    columns, block_rows = matrix.shape[1], slabs.block_rows
    parts = [((k, 0), DenseMatrix(len(p), columns, p.ravel("F").tolist())) for k, p in enumerate(matrix[i : i + side] for i in range(0, slabs.width, side))]
    for job in slabs.jobs(slabs_at_once):
        right = BlockMatrix(spark.sparkContext.parallelize(parts, 1), side, columns, slabs.width, columns)
        rows = []
        for first, left in job:
            rows.append(left.multiply(right).blocks.flatMap(lambda b, first=first: [(first + b[0][0] * block_rows + r, row) for r, row in enumerate(b[1].toArray().tolist())]))
        spark.createDataFrame(spark.sparkContext.union(rows), "index long, z array<double>").write.mode("append").parquet(path)
    return spark.read.schema("index long, z array<double>").parquet(path)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: float = 64.0, offset: int = 1_000_000, block_rows: int = BLOCK_ROWS, slab_blocks: int = SLAB_BLOCKS, slabs_at_once: int = JOB_SLABS) -> DataFrame:
    """A row for each row of vectors (vec_id, embedding; other columns are left out) and component.

    Rows whose vector is null or holds null or non-finite entries take no part, nor do those shorter than the longest
    vector. The fit is over distinct vectors; all repeats of a vector get its values. deviation is null where it exceeds a
    long. A component without variance (an eigenvalue below LEAST_EIGENVALUE of the largest) is whitened to null and
    takes no part in identity_error, which is null where no component has any; explained is null where the trace is 0. No
    usable row, or only empty vectors: no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = quantised(vectors, scale, offset)
    size = rows.agg(F.max(F.size("x")).alias("width"), F.count(F.lit(1)).alias("rows")).first()
    width, usable = size.width or 0, size.rows
    if not width:
        return spark.createDataFrame([], RESULT)
    rows = rows.filter(F.size("x") == width).withColumn("h", F.xxhash64("x"))
    distinct = rows.select("h", "x").distinct().select("x")
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, usable // PACKED_ROWS))
    fit = scratch.keep(distinct.coalesce(tasks).mapInArrow(*_pack(width, block_rows)))
    firsts, blocks, n = {}, 0, 0
    for r in fit.groupBy("part").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n")).orderBy("part").collect():  # a row for each task
        firsts[r.part], blocks, n = blocks, blocks + r.blocks, n + r.n
    sums = fit.select("x").mapInArrow(*_sums(width)).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r.s) for r in sums.orderBy("k").collect()]  # a row for each dimension
    centring = Centring(n, sums, firsts)
    fit.mapInArrow(*centring.blocks(block_rows, slab_blocks)).write.partitionBy("slab").parquet(scratch.path("centred"))
    slabs = Slabs(spark, scratch.path("centred"), blocks, width, block_rows, slab_blocks)

    values, basis = np.linalg.eigh(_scatter(slabs, slabs_at_once) / n)
    k = min(components, width)
    values, basis = np.maximum(values[::-1], 0.0), basis[:, ::-1][:, :k]
    trace, own = float(values.sum()), values[:k]
    varies = own > LEAST_EIGENVALUE * values[0]
    whitening = np.where(varies, basis / np.sqrt(np.where(varies, own, 1.0)), 0.0)
    projected = _projected(slabs, whitening, slabs_at_once, scratch)
    error = None
    if varies.any():
        z = MLUtils.convertVectorColumnsFromML(projected.select("index", array_to_vector("z").alias("z")), "z")
        covariance = IndexedRowMatrix(z, blocks * block_rows, k).computeGramianMatrix().toArray() / n  # the mean of centred rows is 0
        error = float(np.abs(covariance - np.eye(k))[np.ix_(varies, varies)].max())

    known = fit.mapInArrow(*centring.rows(block_rows))
    ids = rows.select("vec_id", "h", "x").join(known.withColumn("h", F.xxhash64("x")), ["h", "x"]).select("vec_id", "index", "deviation")
    per_component = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.lit(bool(varies[c])).alias("varies"), F.lit(float(own[c]) / trace if trace else None).cast("double").alias("explained")) for c in range(k)])
    exploded = ids.join(projected, "index").select("vec_id", "deviation", F.explode(F.arrays_zip(F.col("z"), per_component.alias("c"))).alias("e"))
    whitened = F.when(F.col("e.c.varies"), F.col("e.z"))
    return exploded.select("vec_id", F.col("e.c.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", whitened.alias("whitened"), F.col("e.c.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
