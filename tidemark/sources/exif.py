"""What a camera writes into the head of a JPEG: segments, TIFF directories of either byte order, rational positions.

Heads come as rows of bytes; a batch is read at a time. A head that can't be read has a problem in place of values, never
an error. ``written_heads`` makes such heads, for tests and for tables without files.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.labels import flight_tags

# Fixed values of the file format: tags of the directories, sizes of the value kinds, markers of segments.
MAKE, MODEL, ORIENTATION, EXIF_DIRECTORY, GPS_DIRECTORY, FOCAL = 0x010F, 0x0110, 0x0112, 0x8769, 0x8825, 0x920A
LATITUDE_REF, LATITUDE, LONGITUDE_REF, LONGITUDE = 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
BYTE, TEXT, SHORT, LONG, RATIONAL, SIGNED_RATIONAL = 1, 2, 3, 4, 5, 10
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
ALONE = frozenset(range(0xD0, 0xD8)) | {0x01}
#: Entries of a directory and bytes of a text at most: more is damage.
MOST_ENTRIES, MOST_TEXT = 512, 4096

FIELDS = ("make", "string"), ("model", "string"), ("orientation", "int"), ("width", "int"), ("height", "int"), ("focal_mm", "double"), ("lat", "double"), ("lon", "double"), ("problem", "string")
SCHEMA = T.StructType([T.StructField(n, {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}[k]) for n, k in FIELDS])


class Damaged(ValueError):
    """Why a head can't be read."""


def segments(head: bytes) -> tuple[bytes | None, int | None, int | None]:
    """The TIFF block of the first Exif segment, width and height, as far as the head has them."""
    if head[:2] != b"\xff\xd8":
        raise Damaged("no JPEG")
    tiff, width, height, at = None, None, None, 2
    while at + 4 <= len(head):
        if head[at] != 0xFF:
            raise Damaged("damaged segment")
        marker = head[at + 1]
        if marker == 0xFF:  # padding
            at += 1
            continue
        if marker in ALONE:
            at += 2
            continue
        if marker in (0xD9, 0xDA):  # the picture itself
            break
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        if size < 2:
            raise Damaged("damaged segment")
        body = head[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0" and tiff is None:
            if len(body) < size - 2:
                raise Damaged("cut short")
            tiff = body[6:]
        elif marker in FRAMES and len(body) >= 5:
            height, width = struct.unpack(">HH", body[1:5])
        at += 2 + size
    return tiff, width, height


class Directory:
    """Values of a TIFF directory by tag."""

    def __init__(self, tiff: bytes, order: str, at: int):
        self.tiff, self.order, self.entries = tiff, order, {}
        count = self._unpack("H", at)[0]
        if count > MOST_ENTRIES:
            raise Damaged("damaged directory")
        for k in range(count):
            tag, kind, n = self._unpack("HHI", at + 2 + 12 * k)
            self.entries.setdefault(tag, (kind, n, at + 2 + 12 * k + 8))

    def _unpack(self, kinds: str, at: int) -> tuple:
        size = struct.calcsize("=" + kinds)
        if at < 0 or at + size > len(self.tiff):
            raise Damaged("damaged directory")
        return struct.unpack_from(self.order + kinds, self.tiff, at)

    def _place(self, tag: int, most: int) -> tuple[int, int, int] | None:
        if tag not in self.entries:
            return None
        kind, n, at = self.entries[tag]
        if kind not in SIZES or n > most:
            raise Damaged("damaged directory")
        return kind, n, at if SIZES[kind] * n <= 4 else self._unpack("I", at)[0]

    def text(self, tag: int) -> str | None:
        found = self._place(tag, MOST_TEXT)
        if found is None or found[0] != TEXT:
            return None
        raw = b"".join(self._unpack(f"{found[1]}s", found[2]))
        return raw.split(b"\0")[0].decode("latin-1").strip()

    def numbers(self, tag: int) -> list[float] | None:
        """Whole numbers or fractions; one over 0 is NaN."""
        found = self._place(tag, 16)
        if found is None:
            return None
        kind, n, at = found
        if kind in (RATIONAL, SIGNED_RATIONAL):
            pairs = self._unpack(("I" if kind == RATIONAL else "i") * 2 * n, at)
            return [a / b if b else float("nan") for a, b in zip(pairs[::2], pairs[1::2])]
        letter = {BYTE: "B", SHORT: "H", LONG: "I", 9: "i"}.get(kind)
        return list(map(float, self._unpack(letter * n, at))) if letter else None


def _degrees(parts: list[float] | None, ref: str | None, negative: str) -> float | None:
    if not parts or len(parts) < 3 or not ref or any(p != p for p in parts[:3]):
        return None
    return (parts[0] + parts[1] / 60 + parts[2] / 3600) * (-1 if ref == negative else 1)


def read_head(head: bytes | None) -> dict:
    """The fields of one head; problem says why there are none."""
    out: dict = dict.fromkeys(n for n, _ in FIELDS)
    try:
        tiff, out["width"], out["height"] = segments(head or b"")
        if tiff is None:
            raise Damaged("no Exif")
        order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
        if order is None or len(tiff) < 8 or struct.unpack_from(order + "H", tiff, 2)[0] != 42:
            raise Damaged("damaged directory")
        first = Directory(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0])
        number = lambda d, tag: (d.numbers(tag) or [None])[0]
        out["make"], out["model"] = first.text(MAKE), first.text(MODEL)
        turned = number(first, ORIENTATION)
        out["orientation"] = None if turned is None else int(turned)
        for tag, read in ((EXIF_DIRECTORY, "exif"), (GPS_DIRECTORY, "gps")):
            at = number(first, tag)
            if at is None:
                continue
            inner = Directory(tiff, order, int(at))
            if read == "exif":
                focal = number(inner, FOCAL)
                out["focal_mm"] = focal if focal == focal else None
            else:
                lat = _degrees(inner.numbers(LATITUDE), inner.text(LATITUDE_REF), "S")
                lon = _degrees(inner.numbers(LONGITUDE), inner.text(LONGITUDE_REF), "W")
                out["lat"], out["lon"] = (lat, lon) if lat is not None and lon is not None else (None, None)
    except Damaged as why:
        out = dict.fromkeys(out) | {"problem": str(why)}
    return out


@F.arrow_udf(SCHEMA)
def exif(heads: pa.Array) -> pa.Array:
    """make, model, orientation, width, height, focal_mm, lat, lon, problem of each head."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return pa.array([read_head(h) for h in heads.to_pylist()], pa.struct([(n, kinds[k]) for n, k in FIELDS]))


def _directory(entries: list[tuple[int, int, int, bytes]], at: int, order: str) -> bytes:
    """A directory that begins at a place of its block: entries of tag, kind, number, bytes."""
    head, rest = struct.pack(order + "H", len(entries)), b""
    beyond = at + 2 + 12 * len(entries) + 4
    for tag, kind, n, value in entries:
        head += struct.pack(order + "HHI", tag, kind, n)
        if len(value) > 4:
            head += struct.pack(order + "I", beyond + len(rest))
            rest += value + b"\0" * (len(value) % 2)
        else:
            head += value.ljust(4, b"\0")
    return head + b"\0\0\0\0" + rest


def write_head(make: str | None, model: str | None, focal: float | None, lat: float | None, lon: float | None, width: int, height: int, xmp: str, little: bool, orientation: int = 1) -> bytes:
    """A JPEG up to its frame header: an Exif segment, one with attributes, a frame of a size. None leaves a value out."""
    order = "<" if little else ">"
    text = lambda tag, s: [(tag, TEXT, len(s) + 1, s.encode("latin-1") + b"\0")] if s is not None else []
    fraction = lambda *pairs: b"".join(struct.pack(order + "II", *p) for p in pairs)

    def dms(v: float) -> bytes:
        whole = round(abs(v) * 3600 * 10_000)
        return fraction((whole // 36_000_000, 1), (whole // 600_000 % 60, 1), (whole % 600_000, 10_000))

    own = [(FOCAL, RATIONAL, 1, fraction((round(focal * 1000), 1000)))] if focal is not None else []
    place = [] if lat is None or lon is None else [(LATITUDE_REF, TEXT, 2, b"S\0" if lat < 0 else b"N\0"), (LATITUDE, RATIONAL, 3, dms(lat)), (LONGITUDE_REF, TEXT, 2, b"W\0" if lon < 0 else b"E\0"), (LONGITUDE, RATIONAL, 3, dms(lon))]
    first = text(MAKE, make) + text(MODEL, model) + [(ORIENTATION, SHORT, 1, struct.pack(order + "H", orientation))]
    size = len(_directory(first + [(EXIF_DIRECTORY, LONG, 1, b"0000"), (GPS_DIRECTORY, LONG, 1, b"0000")], 8, order))
    inner = _directory(own, 8 + size, order)
    links = [(EXIF_DIRECTORY, LONG, 1, struct.pack(order + "I", 8 + size)), (GPS_DIRECTORY, LONG, 1, struct.pack(order + "I", 8 + size + len(inner)))]
    tiff = (b"II*\0" if little else b"MM\0*") + struct.pack(order + "I", 8) + _directory(first + links, 8, order) + inner + _directory(place, 8 + size + len(inner), order)
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff) + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp.encode("latin-1", "replace")) + segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x22\0\x02\x11\x01\x03\x11\x01")


@F.arrow_udf(T.BinaryType())
def written_heads(make: pa.Array, model: pa.Array, focal: pa.Array, lat: pa.Array, lon: pa.Array, width: pa.Array, height: pa.Array, xmp: pa.Array, little: pa.Array, orientation: pa.Array) -> pa.Array:
    columns = (c.to_pylist() for c in (make, model, focal, lat, lon, width, height, xmp, little, orientation))
    return pa.array([write_head(*row) for row in zip(*columns)], pa.binary())


def camera_tags(xmp: Column) -> Column:
    """Flight tags of makers that write the Camera name space: its pitch is 0 straight down, -90 here."""
    number = lambda key: F.try_element_at(xmp, F.lit(key)).try_cast("double")
    return F.struct(
        number("drone-dji:GpsLatitude").alias("lat"), number("drone-dji:GpsLongitude").alias("lon"), number("Camera:AboveGroundAltitude").alias("alt"), number("Camera:Yaw").alias("yaw"), (number("Camera:Pitch") - 90).alias("pitch")
    )


#: For each make, as its photos name it, how attributes become lat, lon, alt, yaw and pitch. Another make is added here.
BY_MAKE: dict[str, Callable[[Column], Column]] = {"DJI": flight_tags, "senseFly": camera_tags}
