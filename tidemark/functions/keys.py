"""Keys from names and paths, and stable hashes."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def normal_name(names: pa.Array) -> pa.Array:
    """Class-name key: accents off, underscores to spaces, lower case, runs of white space to one."""

    def one(name: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        return " ".join(plain.replace("_", " ").lower().split())

    return pa.array([None if n is None else one(n) for n in names.to_pylist()], pa.string())


def site_of(batch: Column) -> Column:
    """What stands before the first space."""
    return F.split_part(batch, F.lit(" "), F.lit(1))


def parent_id(path: Column) -> Column:
    """A path without its suffix, separators and spaces as underscores."""
    return F.translate(F.regexp_replace(path, r"\.[^./\\]*$", ""), "/\\ ", "___")


def parent_of_tile(name: Column) -> Column:
    """A tile's parent: two trailing numeric segments off; another name as it is."""
    return F.when(name.rlike(r"^.*_\d+_\d+$"), F.regexp_extract(name, r"^(.*)_\d+_\d+$", 1)).otherwise(name)


def tile_origin(name: Column) -> Column:
    """(y, x) of a grid tile's name, null if it has none."""
    y, x = (F.nullif(F.regexp_extract(name, r"_y(\d+)_x(\d+)", g), F.lit("")).cast("int") for g in (1, 2))
    return F.struct(y.alias("y"), x.alias("x"))


def guessed_batch(name: Column) -> Column:
    """A batch for display: what stands before ``_images_``, else the name without its suffix; underscores as spaces."""
    before = F.when(F.contains(name, F.lit("_images_")), F.split_part(name, F.lit("_images_"), F.lit(1))).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.translate(before, "_", " ")


def anchored(path: Column, marker: str) -> Column:
    """A Windows or POSIX path from behind the last folder named marker; as it is if there is none. Separators become ``/``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), rf"^.*/{marker}/", "")


def safe_label(label: Column) -> Column:
    return F.regexp_replace(label, "[^A-Za-z0-9]+", "_")


def stable_rank(key: Column) -> Column:
    """60 bits of the key's SHA-256 as a bigint: the same everywhere, on every rerun."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def stable_unit(key: Column) -> Column:
    """stable_rank as a number from 0 to below 1."""
    return stable_rank(key).cast("double") / F.pow(F.lit(16.0), F.lit(15))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)
