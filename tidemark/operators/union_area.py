"""The exact area under any of many rings, by cells: no task holds more than a bounded number of rings.

Rings are cut to the cells of a grid. A cell that one ring covers is full. A cell of many rings is quartered, round by
round, until few are left in it; there a sweep over the slabs between all corners and crossings of edges adds up what any
ring covers, which is linear within a slab.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clipping
from tidemark.functions.geometry import clip_to_box, ring_area
from tidemark.operators.spatial_join import in_cells
from tidemark.scratch import Scratch

#: Rings of a cell that are swept over at once, and how often a cell is quartered at most (rings through one point stay together).
SWEPT = 128
QUARTERED = 10


def swept_area(points: np.ndarray, sizes: np.ndarray) -> float:
    """Area under any of some simple rings."""
    k = np.arange(points.shape[1])
    after = np.take_along_axis(points, np.where(k + 1 < sizes[:, None], k + 1, 0)[..., None], axis=1)
    used = k < sizes[:, None]
    ring = np.nonzero(used)[0]
    a, b = points[used], after[used]
    d = b - a
    xs = [a[:, 0]]
    for i in range(len(a) - 1):  # crossings of an edge with all later ones
        whole = d[i, 0] * d[i + 1 :, 1] - d[i, 1] * d[i + 1 :, 0]
        apart = a[i + 1 :] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (apart[:, 0] * d[i + 1 :, 1] - apart[:, 1] * d[i + 1 :, 0]) / whole
            t = (apart[:, 0] * d[i, 1] - apart[:, 1] * d[i, 0]) / whole
        meet = (whole != 0) & (s > 0) & (s < 1) & (t > 0) & (t < 1)
        xs.append(a[i, 0] + s[meet] * d[i, 0])
    x = np.unique(np.concatenate(xs))
    if len(x) < 2:
        return 0.0
    left, right = np.searchsorted(x, np.minimum(a[:, 0], b[:, 0])), np.searchsorted(x, np.maximum(a[:, 0], b[:, 0]))
    spans = right - left
    edge = np.repeat(np.arange(len(a)), spans)
    slab = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + left[edge]
    middle = (x[slab] + x[slab + 1]) / 2
    y = a[edge, 1] + (middle - a[edge, 0]) / d[edge, 0] * d[edge, 1]
    order = np.lexsort((y, ring[edge], slab))
    sign = np.empty(len(y), np.int64)
    sign[order] = 1 - 2 * (np.arange(len(y)) % 2)  # a ring's edges over a slab come in pairs
    order = np.lexsort((-sign, y, slab))
    y, slab, depth = y[order], slab[order], np.cumsum(sign[order])
    covered = (depth[:-1] > 0) & (slab[1:] == slab[:-1])
    return float(((y[1:] - y[:-1]) * (x[slab[:-1] + 1] - x[slab[:-1]]))[covered].sum())


def union_area(rings: DataFrame, keys: list[str], cell: float, scratch: Scratch, swept: int = SWEPT) -> DataFrame:
    """keys and area: what the rings of each key cover. rings: ring (simple), x0, y0, x1, y1 (the box around it), keys (not null).

    Rings without an area count for nothing; a key of such rings only has no row. Equal rings are one.
    """
    c, at = F.col, ["cx", "cy", "size"]
    pieces = in_cells(rings.select(*keys, "ring", "x0", "y0", "x1", "y1").distinct(), cell).select(*keys, (c("cell_x") * F.lit(cell)).alias("cx"), (c("cell_y") * F.lit(cell)).alias("cy"), F.lit(float(cell)).alias("size"), "ring")
    out = None
    for level in range(QUARTERED + 1):
        cut = pieces.withColumn("ring", clip_to_box(c("ring"), c("cx"), c("cy"), c("cx") + c("size"), c("cy") + c("size"))).filter(F.size("ring") > 2)
        cut = cut.withColumn("share", ring_area(c("ring")) / (c("size") * c("size"))).filter("share > 0")
        held = scratch.keep(cut)
        cells = scratch.keep(held.groupBy(*keys, *at).agg(F.max("share").alias("most"), F.count(F.lit(1)).alias("n")))
        full = cells.filter("most >= 1 - 1e-12").select(*keys, (c("size") * c("size")).alias("area"))
        few = cells.filter(f"most < 1 - 1e-12 AND (n <= {swept} OR {str(level == QUARTERED).lower()})").select(*keys, *at)
        schema = ", ".join([f"`{k}` {dict(held.dtypes)[k]}" for k in keys] + ["area double"])

        def sweep(table: pa.Table) -> pa.Table:
            area = swept_area(*clipping.padded(table["ring"]))
            return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "area": [area]})

        part = full.union(held.join(few, [*keys, *at]).select(*keys, *at, "ring").groupBy(*keys, *at).applyInArrow(sweep, schema))
        out = part if out is None else out.union(part)
        many = cells.filter(f"most < 1 - 1e-12 AND n > {swept}").select(*keys, *at)
        if level == QUARTERED or many.isEmpty():
            break
        half = c("size") / 2
        quarter = F.explode(F.array(*[F.struct((c("cx") + half * i).alias("cx"), (c("cy") + half * j).alias("cy")) for i in (0, 1) for j in (0, 1)]))
        pieces = held.join(many, [*keys, *at]).select(*keys, quarter.alias("q"), half.alias("size"), "ring").select(*keys, "q.cx", "q.cy", "size", "ring")
    return out.groupBy(*keys).agg(F.sum("area").alias("area"))
