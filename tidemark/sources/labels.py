"""Label files, GeoJSON detections and photo metadata as tables; sinks for detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import parent_id

#: Bytes of a photo's head in which metadata is looked for.
HEAD_BYTES = 200_000


def label_lines(lines: DataFrame, column: str) -> DataFrame:
    """lines with local_id and ring for each well-formed ``class x1 y1 x2 y2 ...`` line; a malformed line is left out.

    A line needs a class, at least three points, and numbers throughout.
    """
    tokens = F.split(F.trim(column), r"\s+")
    numbers = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: t.try_cast("double"))
    parsed = lines.withColumn("local_id", F.element_at(tokens, 1).try_cast("int")).withColumn("v", numbers)
    good = F.col("local_id").isNotNull() & (F.size("v") >= 6) & (F.size("v") % 2 == 0) & ~F.exists("v", lambda x: x.isNull())
    points = F.transform(F.sequence(F.lit(0), (F.size("v") / 2).cast("int") - 1), lambda i: F.struct(F.get("v", 2 * i).alias("x"), F.get("v", 2 * i + 1).alias("y")))
    return parsed.filter(good).withColumn("ring", points).drop("v", column)


def yolo_labels(spark: SparkSession, folder: str) -> DataFrame:
    """parent_id, line_no, local_id, ring of the label files below a folder, as label_lines reads their lines."""
    text = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(folder, wholetext=True)
    name = F.regexp_replace(F.input_file_name(), r"^.*/labels/", "")
    lines = text.select(parent_id(name).alias("parent_id"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return label_lines(lines, "line").select("parent_id", "line_no", "local_id", "ring")


def class_names(settings: Column) -> Column:
    """(local_id, name) of JSON settings whose ``names`` are a list or a map from ids."""
    listed = F.from_json(settings, "names array<string>")["names"]
    mapped = F.from_json(settings, "names map<string,string>")["names"]
    pair = lambda i, n: F.struct(i.cast("int").alias("local_id"), n.alias("name"))
    of_map = F.transform(F.map_entries(mapped), lambda e: pair(e["key"], e["value"]))
    return F.when(F.get_json_object(settings, "$.names").startswith("["), F.transform(listed, lambda n, i: pair(i, n))).otherwise(of_map)


def beside(image: Column) -> Column:
    """The label file in the image's own folder."""
    return F.regexp_replace(image, r"\.[^./]*$", ".txt")


def mirrored(image: Column) -> Column:
    """The label file in the folder ``labels`` that stands beside the last folder ``images``."""
    return F.regexp_replace(beside(image), r"^(.*/)?images/(?!.*/images/)", "$1labels/")


FEATURE = "type string, features array<struct<type:string, geometry:struct<type:string, coordinates:array<array<array<double>>>>, properties:map<string,string>>>"


def geojson_detections(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """file, class_name, confidence, area_m2, source_photo, mode, ring for the polygon features of GeoJSON files.

    mode is ``batch`` for a file in which any feature names its photo, else ``ortho``. With strict, a feature of
    another geometry is an error.
    """
    read = spark.read.schema(FEATURE).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    each = read.select("file", F.exists("features", lambda f: f["properties"]["source_photo"].isNotNull()).alias("batch"), F.explode("features").alias("f"))
    polygon = F.col("f.geometry.type") == "Polygon"
    if strict:
        each = each.filter(F.when(polygon, True).otherwise(F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce("f.geometry.type", F.lit("null")))).cast("boolean")))
    p = F.col("f.properties")
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))
    open_ = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    number = lambda key: p[key].try_cast("double")
    return each.filter(polygon).select(
        "file", F.coalesce(p["class_name"], F.lit("unknown")).alias("class_name"), number("confidence").alias("confidence"), number("area_m2").alias("area_m2"),
        p["source_photo"].alias("source_photo"), F.when(F.col("batch"), "batch").otherwise("ortho").alias("mode"), open_.alias("ring"),
    )


def photo_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, and the XMP attributes (map) in the head of each JPEG below a folder; hidden parts are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(folder)
    shown = files.filter(~F.col("path").rlike(r"/\.[^/]+"))
    head = F.decode(F.substring("content", 1, HEAD_BYTES), "ISO-8859-1")
    return shown.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), xmp_attributes(head).alias("xmp"))


def xmp_attributes(text: Column) -> Column:
    """Attributes ``ns:Key="value"`` as a map; of a repeated key the last counts."""
    pattern = r'([A-Za-z0-9-]+:[A-Za-z0-9]+)="([^"]*)"'
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
    unique = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_arrays(F.transform(unique, lambda p: p["k"]), F.transform(unique, lambda p: p["v"]))


def flight_tags(xmp: Column) -> Column:
    """lat, lon, altitude, yaw, pitch from XMP attributes, null where missing or no number."""
    take = lambda *names: F.coalesce(*[F.try_element_at(xmp, F.lit(n)).try_cast("double") for n in names])
    tags = {"lat": ("drone-dji:GpsLatitude", "drone-dji:Latitude"), "lon": ("drone-dji:GpsLongitude", "drone-dji:GpsLongtitude", "drone-dji:Longitude"), "alt": ("drone-dji:RelativeAltitude",), "yaw": ("drone-dji:GimbalYawDegree",), "pitch": ("drone-dji:GimbalPitchDegree",)}
    return F.struct(*[take(*names).alias(key) for key, names in tags.items()])


def write_geojson_lines(found: DataFrame, path: str, ring: str = "ring", by: str | None = None) -> None:
    """One GeoJSON feature a line, rings closed, other columns as properties; by names a column to part folders by."""
    closed = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    rest = [c for c in found.columns if c not in (ring, by)]
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    value = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value")
    rows = found.select(*([by] if by else []), value)
    (rows.write.partitionBy(by) if by else rows.write).text(path)


def geojson_lines(spark: SparkSession, path: str, strict: bool = False, by: str | None = None) -> DataFrame:
    """The features of a folder of write_geojson_lines: by, class_name, confidence, area_m2, source_photo, mode, ring, properties.

    mode is ``batch`` where any feature of the same part names its photo, else ``ortho``. A feature of another
    geometry is left out, or an error with strict.
    """
    kind = "type string, geometry struct<type:string, coordinates:array<array<array<double>>>>, properties map<string,string>"
    read = spark.read.schema(kind + (f", {by} long" if by else "")).json(path)
    polygon = F.col("geometry.type") == "Polygon"
    if strict:
        read = read.filter(F.when(polygon, True).otherwise(F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce("geometry.type", F.lit("null")))).cast("boolean")))
    read = read.filter(polygon)
    p = F.col("properties")
    ring = F.transform(F.col("geometry.coordinates")[0], lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))
    open_ = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    number = lambda key: p[key].try_cast("double")
    rows = read.select(
        *([by] if by else []), F.coalesce(p["class_name"], F.lit("unknown")).alias("class_name"), number("confidence").alias("confidence"), number("area_m2").alias("area_m2"),
        p["source_photo"].alias("source_photo"), open_.alias("ring"), p.alias("properties"),
    )
    if by is None:
        return rows
    named = read.groupBy(by).agg(F.bool_or(p["source_photo"].isNotNull()).alias("named"))
    return rows.join(named, by).withColumn("mode", F.when(F.col("named"), "batch").otherwise("ortho")).drop("named")


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder with a sheet for each table, as JSON rows."""
    for name, rows in sheets.items():
        rows.write.json(f"{path}/sheet={name}")


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """sheet and the row as text, for all sheets."""
    return spark.read.text(path).select("sheet", F.col("value").alias("row"))


def write_snapshot(rows: DataFrame, path: str, version: str) -> None:
    """rows under their version, where nothing may stand yet, and as ``latest``, in place of an earlier one."""
    write_sheet(rows, f"{path}/{version}")
    kept = rows.sparkSession.read.option("header", True).option("sep", ";").schema(rows.schema).csv(f"{path}/{version}")
    kept.write.mode("overwrite").option("header", True).option("sep", ";").csv(f"{path}/latest")


def append_missing(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table under path doesn't hold yet; what is there stays as it is."""
    there = rows.sparkSession.read.schema(rows.schema).parquet(path).select(*keys).distinct()
    rows.join(there, keys, "left_anti").write.mode("append").parquet(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    """A ``;`` separated sheet with a header."""
    rows.write.option("header", True).option("sep", ";").csv(path)
