"""Theta joins of boxes by a grid: an equi-join on cells in place of a nested loop.

A box enters every cell it touches. A pair of boxes that meet shares one cell in which the lower corner of their
intersection lies; it is reported there only, so that no distinct is needed afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


#: Width and height of a cell; one number for squares.
Cell = float | tuple[float, float]


def _sides(cell: Cell) -> dict[str, float]:
    return dict(zip("xy", cell if isinstance(cell, tuple) else (cell, cell)))


def _drawn_in(prefix: str, axis: str, shrink: float) -> tuple[Column, Column]:
    """Low and high side of a box along an axis, each drawn in by a share of the box's length."""
    low, high = F.col(f"{prefix}{axis}0"), F.col(f"{prefix}{axis}1")
    return (low + shrink * (high - low), high - shrink * (high - low)) if shrink else (low, high)


def in_cells(boxes: DataFrame, cell: Cell, margin: float = 0.0, shrink: float = 0.0) -> DataFrame:
    """boxes (x0, y0, x1, y1), a row for each cell (cell_x, cell_y) that a box, widened by margin or drawn in, touches."""

    def span(axis: str) -> Column:
        low, high = _drawn_in("", axis, shrink)
        side = _sides(cell)[axis]
        return F.sequence(F.floor((low - margin) / side).cast("long"), F.floor((high + margin) / side).cast("long"))

    return boxes.withColumn("cell_x", F.explode(span("x"))).withColumn("cell_y", F.explode(span("y")))


def drawn_in_for(least: float) -> float:
    """The share by which boxes can be drawn in on each side, so that all that overlap by a ratio of least still meet.

    Their intersection is least times as long as the longer of them along either axis, so their middles are nearer than
    half the sum of their lengths, each shortened by least. The last digits are left to rounding.
    """
    return max(0.0, least) / 2 * (1 - 1e-6)


def overlap(a: str = "a", b: str = "b") -> Column:
    """Area of the intersection of two prefixed boxes; 0 if they don't meet."""
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(F.col(f"{a}_{high}"), F.col(f"{b}_{high}")) - F.greatest(F.col(f"{a}_{low}"), F.col(f"{b}_{low}")))
    return side("x0", "x1") * side("y0", "y1")


def area(p: str) -> Column:
    return (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))


def iou(a: str = "a", b: str = "b") -> Column:
    return overlap(a, b) / (area(a) + area(b) - overlap(a, b))


def meeting_pairs(left: DataFrame, right: DataFrame, cell: Cell, keys: tuple[str, ...] = (), distance: float = 0.0, shrink: float = 0.0) -> DataFrame:
    """Pairs of boxes that meet (touching counts), or come within distance along both axes: columns a_* and b_*.

    keys are columns on both sides that must be equal. cell should be near the size of a box; it only changes the
    number of rows on the way. With shrink only boxes meet that still do when each is drawn in by that share of its
    lengths on every side (drawn_in_for tells how far an overlap ratio allows).
    """
    a = in_cells(left, cell, distance, shrink).select(*[F.col(c).alias(f"a_{c}") for c in left.columns], *[F.col(k).alias(f"key_{k}") for k in keys], "cell_x", "cell_y")
    b = in_cells(right, cell, 0.0, shrink).select(*[F.col(c).alias(f"b_{c}") for c in right.columns], *[F.col(k).alias(f"key_{k}") for k in keys], "cell_x", "cell_y")
    met = a.join(b, [*[f"key_{k}" for k in keys], "cell_x", "cell_y"])
    here = F.lit(True)
    for axis in "xy":
        (a0, a1), (b0, b1) = (_drawn_in(f"{p}_", axis, shrink) for p in "ab")
        here = here & (a0 - distance <= b1) & (b0 <= a1 + distance) & (F.floor(F.greatest(a0 - distance, b0) / _sides(cell)[axis]) == F.col(f"cell_{axis}"))
    return met.filter(here).drop("cell_x", "cell_y", *[f"key_{k}" for k in keys])


def self_pairs(boxes: DataFrame, cell: Cell, keys: tuple[str, ...], order: str, distance: float = 0.0, shrink: float = 0.0) -> DataFrame:
    """Each meeting pair of one table once, a before b by order."""
    return meeting_pairs(boxes, boxes, cell, keys, distance, shrink).filter(F.col(f"a_{order}") < F.col(f"b_{order}"))
