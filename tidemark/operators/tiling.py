"""Tile windows and grids as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geodesy import tile_of


def windows(images: DataFrame, width: str, height: str, tile: int, stride: int) -> DataFrame:
    """images, a row for each window x0, y0, x1, y1.

    Windows start at every stride below the size and are moved back inside at the far edge, so that some repeat;
    an image smaller than a tile gets windows from 0 that reach beyond it.
    """
    starts = lambda size: F.sequence(F.lit(0), F.greatest(F.col(size), F.lit(1)) - 1, F.lit(stride))
    inside = lambda at, size: F.greatest(F.lit(0), F.least(F.col(at), F.col(size) - tile)).cast("long")
    each = images.withColumn("x", F.explode(starts(width))).withColumn("y", F.explode(starts(height)))
    each = each.withColumn("x0", inside("x", width)).withColumn("y0", inside("y", height)).drop("x", "y")
    return each.withColumn("x1", F.col("x0") + tile).withColumn("y1", F.col("y0") + tile)


def most_square_grid(width: Column, height: Column, cap: int) -> Column:
    """columns and rows of the fewest pieces under a pixel cap, whichever divisors make pieces most square."""
    pieces = F.greatest(F.lit(1), F.ceil(width * height / cap)).cast("int")
    choices = F.filter(F.sequence(F.lit(1), pieces), lambda c: pieces % c == 0)
    ranked = F.transform(choices, lambda c: F.struct(F.round(F.abs(F.log((width / c) / (height / (pieces / c)))), 9).alias("off"), c.alias("columns"), (pieces / c).cast("int").alias("rows")))
    return F.array_min(ranked)


#: From a window to its detections: class, confidence and ring of each.
Predictor = Callable[[int, int], Iterable[tuple[str, float, list[tuple[float, float]]]]]


def predicted(tiles: DataFrame, image: str, predict: Predictor) -> DataFrame:
    """image, x0, y0, class_name, confidence, ring: what a predictor finds in each window (image, x0, y0).

    The predictor runs where the windows lie, on Arrow batches; it may load its model on first use in a task.
    """
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kind = pa.schema([(image, pa.int64()), ("x0", pa.int64()), ("y0", pa.int64()), ("class_name", pa.string()), ("confidence", pa.float64()), ("ring", pa.list_(point))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows += [(i, x, y, name, sure, [{"x": float(u), "y": float(v)} for u, v in ring]) for name, sure, ring in predict(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows) if rows else [[]] * len(kind), kind)], schema=kind)

    given = tiles.select(F.col(image).cast("long").alias(image), F.col("x0").cast("long").alias("x0"), F.col("y0").cast("long").alias("y0"))
    return given.mapInArrow(run, f"{image} long, x0 long, y0 long, class_name string, confidence double, ring array<struct<x:double,y:double>>")


def quadkey(x: Column, y: Column, zoom: Column) -> Column:
    """The digits of a tile from zoom 1 down, each a quarter of the tile before; empty at zoom 0."""
    bit = lambda v, k: F.call_function("shiftright", v, (zoom - k).cast("int")).bitwiseAND(F.lit(1))
    digit = lambda k: (bit(x, k) + 2 * bit(y, k)).cast("string")
    return F.when(zoom == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(zoom, F.lit(1))), digit), ""))


def pyramid(points: DataFrame, lon: str, lat: str, native: int, values: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """zoom, tx, ty, quadkey and values for each tile with points, from zoom native to 0.

    values: for each name what is aggregated over a finest tile, and how coarser tiles aggregate that. Points are counted
    once, into finest tiles; every coarser zoom is summed from these by the leading bits of their place. A point without
    a place takes no part.
    """
    tx, ty = tile_of(F.col(lon), F.col(lat), F.lit(native))
    at = points.filter(f"`{lon}` IS NOT NULL AND `{lat}` IS NOT NULL").withColumns({"tx": tx.cast("long"), "ty": ty.cast("long")})
    finest = at.groupBy("tx", "ty").agg(*[first.alias(name) for name, (first, _) in values.items()])
    zooms = finest.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(native))))
    up = F.lit(native) - F.col("zoom")
    coarse = zooms.withColumns({k: F.call_function("shiftright", F.col(k), up) for k in ("tx", "ty")}).groupBy("zoom", "tx", "ty").agg(*[again(name).alias(name) for name, (_, again) in values.items()])
    return coarse.select("zoom", "tx", "ty", quadkey(F.col("tx"), F.col("ty"), F.col("zoom")).alias("quadkey"), *values)
