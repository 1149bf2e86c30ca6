"""Dark borders of images on a grid of cells, and windows that keep clear of them.

Dark cells are labelled within tiles of a bounded size, each tile a task's small array; labels that meet across a seam are
linked, and connected components of labels, not of cells, settle which belong together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cluster import connected_components
from tidemark.scratch import Scratch

TILE = 32
#: Fixed value: least share of an image that a dark component must have.
LEAST_SHARE = 0.001
#: Rows of an image at most, as a component is named by image, row and column.
SIDE = 1 << 16
LABELLED = "image long, x long, y long, node long"


def labels_of(dark: np.ndarray) -> np.ndarray:
    """For each dark cell the smallest number of a cell (row by row) that it is joined to, diagonals too; the size elsewhere."""
    size = dark.size
    label = np.where(dark, np.arange(size).reshape(dark.shape), size)
    while True:
        near = np.pad(label, 1, constant_values=size)
        rows, columns = dark.shape
        least = np.min([near[i : i + rows, j : j + columns] for i in range(3) for j in range(3)], axis=0)
        least = np.where(dark, least, size)
        jumped = np.where(dark, np.append(least.ravel(), size)[least], size)  # to the label of the label
        if (jumped == label).all():
            return label
        label = jumped


def _label_tile(table: pa.Table) -> pa.Table:
    x, y, image = table["x"].to_numpy(), table["y"].to_numpy(), table["image"][0].as_py()
    left, top = x.min() // TILE * TILE, y.min() // TILE * TILE
    dark = np.zeros((TILE, TILE), bool)
    dark[y - top, x - left] = True
    label = labels_of(dark)[y - top, x - left]
    node = (image * SIDE + top + label // TILE) * SIDE + left + label % TILE
    return pa.table({"image": table["image"], "x": table["x"], "y": table["y"], "node": node})


def nodata_cells(dark: DataFrame, scratch: Scratch, least_share: float = LEAST_SHARE) -> DataFrame:
    """image, x, y, component: dark cells (image, x, y, columns, rows) of components that touch their image's edge and are large enough.

    Cells beyond an image take no part; repeated cells are one. component is the number of its first tile's first cell.
    """
    c = F.col
    cells = dark.select(*[c(k).cast("long").alias(k) for k in ("image", "x", "y", "columns", "rows")]).filter("x >= 0 AND y >= 0 AND x < columns AND y < rows").distinct()
    cells = scratch.keep(cells)
    tiled = cells.select("image", "x", "y", F.floor(c("x") / TILE).alias("tx"), F.floor(c("y") / TILE).alias("ty"))
    labelled = scratch.keep(tiled.groupBy("image", "tx", "ty").applyInArrow(_label_tile, LABELLED))
    border = labelled.filter((c("x") % TILE).isin(0, TILE - 1) | (c("y") % TILE).isin(0, TILE - 1))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((1, 0), (0, 1), (1, 1), (-1, 1))]))
    moved = border.select("image", (c("x")).alias("ox"), c("y").alias("oy"), c("node").alias("a"), steps.alias("s")).select("image", (c("ox") + c("s.dx")).alias("x"), (c("oy") + c("s.dy")).alias("y"), "a")
    links = moved.join(border.select("image", "x", "y", c("node").alias("b")), ["image", "x", "y"]).filter("a <> b").select("a", "b")
    labels = connected_components(links, scratch)
    edge = (c("x") == 0) | (c("y") == 0) | (c("x") == c("columns") - 1) | (c("y") == c("rows") - 1)
    parts = labelled.join(cells, ["image", "x", "y"]).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(edge).alias("edge"), F.max(c("columns") * c("rows")).alias("whole"))
    named = parts.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"), "n", "edge", "whole")
    kept = named.groupBy("component").agg(F.sum("n").alias("n"), F.max("edge").alias("edge"), F.max("whole").alias("whole")).filter(c("edge") & (c("n") >= least_share * c("whole"))).select("component")
    of_node = named.join(kept, "component").select("node", "component")
    return labelled.join(of_node, "node").select("image", "x", "y", "component")


def rescue(nodata: np.ndarray, windows: list[tuple[int, int]], side: int, objects: np.ndarray, most_nodata: float, seen: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Of one image in cells: windows kept, windows added, and each object's largest share in a window.

    nodata: rows x columns; objects: x0, y0, x1, y1. Sums of nodata under a window come from a summed-area table. An object
    that no kept window shows enough of gets the free place nearest to it that holds it whole; an object that an added
    window shows needs none of its own.
    """
    sums = np.pad(nodata.astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    under = sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side]
    free = under <= most_nodata * side * side
    area = (objects[:, 2] - objects[:, 0]) * (objects[:, 3] - objects[:, 1])
    best = np.zeros(len(objects))

    def look(x: int, y: int) -> None:
        w = np.clip(np.minimum(objects[:, 2], x + side) - np.maximum(objects[:, 0], x), 0, None)
        h = np.clip(np.minimum(objects[:, 3], y + side) - np.maximum(objects[:, 1], y), 0, None)
        np.maximum(best, w * h / area, out=best)

    kept = [w for w in windows if free[w[1], w[0]]]
    for w in kept:
        look(*w)
    added: list[tuple[int, int]] = []
    for k in np.flatnonzero(best < seen).tolist() if nodata.any() else []:
        if best[k] >= seen:
            continue
        x0, y0, x1, y1 = objects[k]
        low = np.maximum(0, np.ceil([x1 - side, y1 - side])).astype(int)
        high = np.minimum([free.shape[1] - 1, free.shape[0] - 1], np.floor([x0, y0])).astype(int)
        if (low > high).any():
            continue
        v, u = np.nonzero(free[low[1] : high[1] + 1, low[0] : high[0] + 1])
        if not len(u):
            continue
        near = int(np.argmin((u + low[0] - (x0 + x1 - side) / 2) ** 2 + (v + low[1] - (y0 + y1 - side) / 2) ** 2))
        place = (int(u[near] + low[0]), int(v[near] + low[1]))
        if place not in kept and place not in added:
            added.append(place)
            look(*place)
    return kept, added, best


PLANNED = "image long, x long, y long, rescue boolean, objects long, lost long"


def plan_windows(objects: DataFrame, nodata: DataFrame, columns: int, rows: int, side: int, stride: int, most_nodata: float, seen: float = 0.8) -> DataFrame:
    """image, x, y, rescue: windows of each image with objects, in cells; objects, lost: of the image, how many there are and how many no window shows.

    objects: image, id, x0, y0, x1, y1 in cells, taken in order of id; nodata: image, x, y. One image and its objects are one
    task's work, as each window that is added depends on those before it; objects without area take no part.
    """
    starts = lambda size: sorted({max(0, min(k, size - side)) for k in range(0, size, stride)})
    grid = [(x, y) for y in starts(rows) for x in starts(columns)]

    def plan(found: pa.Table, dark: pa.Table) -> pa.Table:
        if not found.num_rows:
            return pa.table({k: [] for k in ("image", "x", "y", "rescue", "objects", "lost")}, schema=SCHEMA)
        found = found.sort_by("id")
        mask = np.zeros((rows, columns), bool)
        mask[dark["y"].to_numpy(), dark["x"].to_numpy()] = True
        kept, added, best = rescue(mask, grid, side, np.stack([found[k].to_numpy() for k in ("x0", "y0", "x1", "y1")], axis=1), most_nodata, seen)
        places = kept + added
        n = len(places)
        return pa.table({"image": [found["image"][0].as_py()] * n, "x": [p[0] for p in places], "y": [p[1] for p in places], "rescue": [False] * len(kept) + [True] * len(added), "objects": [len(best)] * n, "lost": [int((best < seen).sum())] * n}, schema=SCHEMA)

    double = [F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")]
    usable = objects.select(F.col("image").cast("long").alias("image"), "id", *double).filter("x1 > x0 AND y1 > y0")
    within = nodata.select("image", "x", "y").filter(f"x < {columns} AND y < {rows}")
    return usable.groupBy("image").cogroup(within.groupBy("image")).applyInArrow(plan, PLANNED)


SCHEMA = pa.schema([("image", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("rescue", pa.bool_()), ("objects", pa.int64()), ("lost", pa.int64())])
