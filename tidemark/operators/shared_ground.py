"""Ground that images of different splits share, and what of the image in the lower split must be masked.

Footprints of one site meet in a grid join, as far apart as the margin; whatever the other image's footprint, widened by
the margin, covers of the lower image is its zone. Test ranks above val, val above train.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clipping
from tidemark.functions.geometry import RING, polygon_common_area, ring_area, ring_box
from tidemark.operators.spatial_join import meeting_pairs
from tidemark.operators.union_area import union_area
from tidemark.scratch import Scratch

#: Metres around a photo (its place is as good as its receiver) and around a mosaic beside a mosaic; least zone in square metres.
PHOTO_MARGIN, MOSAIC_MARGIN, LEAST_ZONE = 5.0, 0.25, 0.01
#: Pieces of a quarter circle around a widened corner.
QUARTER = 16


def split_rank(split: Column) -> Column:
    return F.when(split == "test", 2).when(split == "val", 1).when(split == "train", 0)


def widened(ring: Column, margin: Column) -> Column:
    """A convex ring with everything within margin of it; corners are rounded by chords."""

    @F.arrow_udf(RING)
    def run(a: pa.Array, m: pa.Array) -> pa.Array:
        points, sizes = clipping.padded(a)
        points, margins = clipping.counter_clockwise(points, sizes), np.asarray(m.to_numpy(zero_copy_only=False), float)
        width, k = points.shape[1], np.arange(points.shape[1])
        after, before = np.where(k + 1 < sizes[:, None], k + 1, 0), np.where(k > 0, k - 1, np.maximum(sizes[:, None] - 1, 0))
        take = lambda at: np.take_along_axis(points, at[..., None], axis=1)
        outward = lambda edge: np.arctan2(-edge[..., 0], edge[..., 1])
        start = outward(points - take(before))
        turn = (outward(take(after) - points) - start) % (2 * np.pi)
        step = np.ceil(turn / (np.pi / 2) * QUARTER - 1e-9).astype(np.int64).clip(1)
        n = int(step.max(initial=1))
        at = np.minimum(np.arange(n + 1), step[..., None]) / step[..., None]
        angle = start[..., None] + at * turn[..., None]
        arcs = points[:, :, None] + margins[:, None, None, None] * np.stack([np.cos(angle), np.sin(angle)], axis=-1)
        return clipping.rings_of(arcs.reshape(len(sizes), width * (n + 1), 2), np.where(sizes > 2, sizes * (n + 1), 0))

    return run(ring, margin)


def _cut(ring: Column, convex: Column) -> Column:
    @F.arrow_udf(RING)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        other, n = clipping.padded(b)
        return clipping.rings_of(*clipping.clipped(*clipping.padded(a), clipping.counter_clockwise(other, n), n))

    return run(ring, convex)


def shared_zones(footprints: DataFrame, cell: float, photo_margin: float = PHOTO_MARGIN, mosaic_margin: float = MOSAIC_MARGIN) -> DataFrame:
    """A row for each pair of images whose splits differ and whose ground meets: masked, kept, their splits, overlap, zone and its area, share, margin.

    footprints: parent_id, site, split, kind (photo or mosaic), ring (convex). Rows without a site, a known split or a
    footprint take no part.
    """
    c = F.col
    usable = footprints.select("parent_id", "site", "split", "kind", "ring", split_rank(c("split")).alias("rank"), ring_box(c("ring")).alias("box")).filter("site IS NOT NULL AND rank IS NOT NULL AND size(ring) > 2")
    usable = usable.select("parent_id", "site", "split", "kind", "ring", "rank", c("box.x0").alias("x0"), c("box.y0").alias("y0"), c("box.x1").alias("x1"), c("box.y1").alias("y1"))
    margin = F.when((c("a_kind") == "mosaic") & (c("b_kind") == "mosaic"), mosaic_margin).otherwise(photo_margin)
    met = meeting_pairs(usable, usable, cell, ("site",), max(photo_margin, mosaic_margin)).filter("a_rank < b_rank").withColumn("margin", margin)
    near = (c("a_x0") - c("margin") < c("b_x1")) & (c("b_x0") < c("a_x1") + c("margin")) & (c("a_y0") - c("margin") < c("b_y1")) & (c("b_y0") < c("a_y1") + c("margin"))
    zones = met.filter(near).withColumn("zone", _cut(c("a_ring"), widened(c("b_ring"), c("margin")))).withColumn("zone_area", ring_area(c("zone"))).filter(c("zone_area") > LEAST_ZONE)
    return zones.select(
        c("a_parent_id").alias("masked"), c("a_split").alias("masked_split"), c("b_parent_id").alias("kept"), c("b_split").alias("kept_split"), polygon_common_area(c("a_ring"), c("b_ring")).alias("overlap"),
        "zone", "zone_area", (c("zone_area") / F.greatest(ring_area(c("a_ring")), F.lit(1e-9))).alias("share"), "margin",
    )


def masked_areas(zones: DataFrame, cell: float, scratch: Scratch) -> DataFrame:
    """masked and area: the ground under any of an image's zones, each square metre once."""
    boxed = zones.select("masked", F.col("zone").alias("ring"), ring_box(F.col("zone")).alias("box")).select("masked", "ring", "box.x0", "box.y0", "box.x1", "box.y1")
    return union_area(boxed, ["masked"], cell, scratch)


def touched(tiles: DataFrame, zones: DataFrame, cell: float, least: float = 1e-9) -> DataFrame:
    """parent_id, tile, area: tiles (parent_id, tile, ring) that lie on a zone of their image, and the largest piece of one zone on them."""
    box = lambda frame: frame.withColumn("box", ring_box(F.col("ring"))).select("*", "box.x0", "box.y0", "box.x1", "box.y1").drop("box")
    met = meeting_pairs(box(tiles.select("parent_id", "tile", "ring")), box(zones.select(F.col("masked").alias("parent_id"), F.col("zone").alias("ring"))), cell, ("parent_id",))
    on = met.withColumn("area", polygon_common_area(F.col("a_ring"), F.col("b_ring"))).filter(F.col("area") > least)
    return on.groupBy(F.col("a_parent_id").alias("parent_id"), F.col("a_tile").alias("tile")).agg(F.max("area").alias("area"))
