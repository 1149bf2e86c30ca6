"""Label files as annotators left them, checked before they are used: every fault of every batch as a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import polygon_iou, ring_box
from tidemark.functions.keys import normal_name
from tidemark.operators.spatial_join import self_pairs

#: How far a coordinate may lie beyond the image, and the overlap from which two objects of a class are one.
BEYOND, TWICE = 0.01, 0.5


def validate_labels(lines: DataFrame, names: DataFrame, known: DataFrame, cells: float, beyond: float = BEYOND, twice: float = TWICE) -> DataFrame:
    """batch, problem, what: lines (batch, image, line_no, line) against the classes that batches name (batch, local_id, name) and those known (key).

    A batch without names has that as its only fault. A line without words says nothing. One that has other than numbers,
    fewer than three points or an odd number of coordinates is malformed and tells no class; one with a coordinate out of
    bounds is told and still read. Ids that the batch doesn't name and names that no known key resolves are told once for
    each batch. Objects of an image and resolved class that overlap by twice are told as pairs. cells: grid cells to an
    image's side, for the search of pairs.
    """
    c = F.col
    tokens = F.filter(F.split(F.trim(F.coalesce("line", F.lit(""))), r"\s+"), lambda t: t != "")
    numbers = F.transform(F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda t: t.try_cast("double"))
    said = lines.withColumn("tokens", tokens).filter(F.size("tokens") > 0).withColumns({"local_id": F.get("tokens", F.lit(0)).try_cast("int"), "v": numbers})
    named = names.select("batch").distinct()
    nameless = said.select("batch").distinct().join(named, "batch", "left_anti").select("batch", F.lit("no class names").alias("problem"), c("batch").alias("what"))
    read = said.join(named, "batch", "left_semi")
    fault = F.when(c("local_id").isNull() | F.exists("v", lambda x: x.isNull()), "no number").when(F.size("v") < 6, "too few points").when(F.size("v") % 2 != 0, "odd number")
    fault = fault.when(F.exists("v", lambda x: (x < -beyond) | (x > 1 + beyond)), "out of bounds")
    read = read.withColumn("fault", fault)
    faulty = read.filter("fault IS NOT NULL").select("batch", c("fault").alias("problem"), F.concat_ws(":", c("image").cast("string"), c("line_no").cast("string")).alias("what"))
    resolved = names.withColumn("key", normal_name("name")).join(F.broadcast(known.select("key", F.lit(True).alias("known"))), "key", "left")  # a taxonomy is a constant table
    objects = read.filter("fault IS NULL OR fault = 'out of bounds'").join(resolved.select("batch", "local_id", "name", "key", "known"), ["batch", "local_id"], "left")
    unknown = objects.filter("name IS NULL").select("batch", F.lit("unknown id").alias("problem"), c("local_id").cast("string").alias("what")).distinct()
    unresolved = objects.filter("name IS NOT NULL AND known IS NULL").select("batch", F.lit("unresolved name").alias("problem"), c("name").alias("what")).distinct()
    points = F.transform(F.sequence(F.lit(0), (F.size("v") / 2).cast("int") - 1), lambda i: F.struct(F.get("v", 2 * i).alias("x"), F.get("v", 2 * i + 1).alias("y")))
    rings = objects.filter("known AND fault IS NULL").withColumn("ring", points).withColumn("box", ring_box(c("ring"))).select("batch", "image", "key", "line_no", "ring", "box.x0", "box.y0", "box.x1", "box.y1")
    met = self_pairs(rings, 1.0 / cells, ("batch", "image", "key"), "line_no").filter(polygon_iou(c("a_ring"), c("b_ring")) >= twice)
    repeated = met.select(c("a_batch").alias("batch"), F.lit("repeated object").alias("problem"), F.concat_ws("~", c("a_line_no").cast("string"), c("b_line_no").cast("string")).alias("what"))
    return nameless.union(faulty).union(unknown).union(unresolved).union(repeated)
