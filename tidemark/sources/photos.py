"""Photos of a flight from the heads of their files: a lenient and a strict reader, positions, rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geodesy import from_dms
from tidemark.sources.exif import BY_MAKE, exif
from tidemark.sources.labels import HEAD_BYTES, flight_tags, xmp_attributes

#: Degrees by which a camera may lean from straight down, and by which two positions may differ.
MOST_PITCH, POSITIONS_AGREE = 15.0, 0.001

#: For each make how its attributes become lat, lon, alt, yaw and pitch. Another make is added here.
FLIGHT_TAGS: dict[str, Callable[[Column], Column]] = {"DJI": flight_tags}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shown(files: DataFrame) -> DataFrame:
    """files (path, content) that are JPEG and lie in no hidden folder, nor are hidden themselves."""
    return files.filter(F.col("path").rlike(r"(?i)\.jpe?g$") & ~F.col("path").rlike(r"/\."))


def head(content: Column) -> Column:
    """The text of a file's head, in which attributes are looked for."""
    return F.decode(F.substring(content, 1, HEAD_BYTES), "ISO-8859-1")


def _tags(files: DataFrame, make: str) -> DataFrame:
    tags = FLIGHT_TAGS[make](F.col("xmp"))
    return files.withColumn("xmp", xmp_attributes(head(F.col("content")))).select("path", tags.alias("t")).select("path", "t.*")


def _faults() -> list[tuple[str, Column]]:
    c = F.col
    return [("no altitude", c("alt").isNull() | (c("alt") <= 1)), ("no heading", c("yaw").isNull()), ("no position", c("lat").isNull() | c("lon").isNull()), ("not vertical", F.abs(c("pitch") + 90) > MOST_PITCH)]


def lenient(files: DataFrame, make: str = "DJI") -> DataFrame:
    """path, lat, lon, alt, yaw, pitch, alerts, usable: all photos, with an alert for each fault."""
    alerts = F.array_compact(F.array(*[F.when(fault, name) for name, fault in _faults()]))
    return _tags(files, make).withColumn("alerts", alerts).withColumn("usable", F.size("alerts") == 0)


def strict(files: DataFrame, make: str = "DJI") -> DataFrame:
    """path, lat, lon, alt, yaw, pitch, reason: the first fault, for which a photo is rejected; null for a good one."""
    reason = F.coalesce(*[F.when(fault, name) for name, fault in _faults()])
    return _tags(files, make).withColumn("reason", reason)


def dms(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    return from_dms(degrees, minutes, seconds, hemisphere)


def preferred(exif: Column, xmp: Column) -> tuple[Column, Column]:
    """The camera's own coordinate, else that of the attributes, and whether both are there and differ too much."""
    return F.coalesce(exif, xmp), F.coalesce(F.abs(exif - xmp) > POSITIONS_AGREE, F.lit(False))


def from_heads(files: DataFrame) -> DataFrame:
    """path, make, model, width, height, focal_mm, lat, lon, alt, yaw, pitch, differ, reason: from the bytes of files (path, content).

    The position of the Exif directory comes before that of the attributes; differ tells where both are there and apart.
    Attributes are read by the adapter of the make. reason is why a photo can't be placed, null for a good one; a head that
    can't be read has nothing but its reason.
    """
    c = F.col
    read = files.select("path", exif(F.substring(c("content"), 1, HEAD_BYTES)).alias("e"), xmp_attributes(head(c("content"))).alias("xmp"))
    adapted = F.coalesce(*[F.when(c("e.make") == make, tags(c("xmp"))) for make, tags in BY_MAKE.items()])
    both = read.select("path", "e.*", flight_tags(c("xmp")).alias("x"), adapted.alias("t"))
    apart = F.coalesce((F.abs(c("lat") - c("x.lat")) > POSITIONS_AGREE) | (F.abs(c("lon") - c("x.lon")) > POSITIONS_AGREE), F.lit(False))
    placed = c("lat").isNotNull()
    known = both.select(
        "path", "make", "model", "width", "height", "focal_mm", F.when(placed, c("lat")).otherwise(c("x.lat")).alias("lat"), F.when(placed, c("lon")).otherwise(c("x.lon")).alias("lon"),
        c("t.alt").alias("alt"), c("t.yaw").alias("yaw"), c("t.pitch").alias("pitch"), apart.alias("differ"), "problem", "orientation",
    )
    empty = lambda name: F.coalesce(c(name), F.lit("")) == ""
    faults = [
        (c("problem").isNotNull(), c("problem")), (F.coalesce("orientation", F.lit(1)) != 1, F.lit("turned")), (empty("make") | empty("model"), F.lit("no make or model")), (c("focal_mm").isNull(), F.lit("no focal length")),
        (c("lat").isNull() | c("lon").isNull(), F.lit("no position")), (~c("make").isin(*BY_MAKE), F.lit("unknown make")), (c("alt").isNull(), F.lit("no altitude")), (c("yaw").isNull(), F.lit("no heading")), (c("pitch").isNull(), F.lit("no pitch")),
    ]
    value = {n: F.when(c("problem").isNull(), c(n)) for n in ("lat", "lon", "alt", "yaw", "pitch")}
    return known.withColumn("reason", F.coalesce(*[F.when(fault, why) for fault, why in faults])).withColumns(value).drop("problem", "orientation")
