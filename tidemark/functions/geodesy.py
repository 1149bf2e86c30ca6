"""Scales and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the local tangent plane: metres in a degree of latitude, and of longitude at the equator.
METRES_LAT, METRES_LON = 110_540.0, 111_320.0
#: Half the width of the Web-Mercator plane, metres.
MERCATOR = 20037508.342789244


def from_dms(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)


def ground_sample(altitude: Column, sensor_mm: Column, focal_mm: Column, width_px: Column) -> Column:
    """Metres on the ground for each pixel."""
    return altitude * sensor_mm / (focal_mm * width_px)


def to_local(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin."""
    return (lon - lon0) * METRES_LON * F.cos(F.radians(lat0)), (lat - lat0) * METRES_LAT


def from_local(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return lon0 + x / (METRES_LON * F.cos(F.radians(lat0))), lat0 + y / METRES_LAT


def pixel_to_local(px: Column, py: Column, width: Column, height: Column, gsd: Column, yaw: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Ground position of a pixel of a nadir photo turned by yaw (degrees clockwise from north)."""
    right, up = (px - width / 2) * gsd, (height / 2 - py) * gsd
    turn = F.radians(yaw)
    return cx + right * F.cos(turn) + up * F.sin(turn), cy - right * F.sin(turn) + up * F.cos(turn)


def undistort(x: Column, y: Column, k1: Column, steps: int = 4) -> tuple[Column, Column]:
    """Inverse of p * (1 + k1 |p|^2) by fixed-point steps."""
    u, v = x, y
    for _ in range(steps):
        factor = 1 + k1 * (u * u + v * v)
        u, v = x / factor, y / factor
    return u, v


def utm_zone(lon: Column) -> Column:
    return ((lon + 180) / 6).cast("int") + 1


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def tile_of(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """XYZ tile column and row of a point."""
    n = F.pow(F.lit(2.0), zoom)
    turn = F.radians(lat)
    return F.floor((lon + 180) / 360 * n), F.floor((1 - F.log(F.tan(turn) + 1 / F.cos(turn)) / F.pi()) / 2 * n)


def tile_bounds(x: Column, y: Column, zoom: Column) -> tuple[Column, Column, Column, Column]:
    size = 2 * MERCATOR / F.pow(F.lit(2.0), zoom)
    return x * size - MERCATOR, MERCATOR - (y + 1) * size, (x + 1) * size - MERCATOR, MERCATOR - y * size


def native_zoom(gsd: Column, lat: Column, most: int = 21) -> Column:
    """The first zoom whose 256-pixel tiles are as fine as gsd, at most ``most``."""
    equator = 2 * MERCATOR / 256
    return F.least(F.lit(most), F.ceil(F.log2(equator * F.cos(F.radians(lat)) / gsd))).cast("int")


def affine(px: Column, py: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """A pixel's place by a raster's transform (origin x, step and skew of x, origin y, skew and step of y)."""
    x, a, b, y, d, e = transform
    return x + px * a + py * b, y + px * d + py * e


def pixel_area(a: Column, b: Column, d: Column, e: Column) -> Column:
    """Area of a pixel of an affine transform: its determinant."""
    return F.abs(a * e - b * d)


#: Fixed values of WGS 84 and of UTM: equatorial radius, flattening, scale, false easting and northing.
RADIUS, FLATTENING, UTM_SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def _series() -> tuple[float, float, tuple[float, ...], tuple[float, ...]]:
    """Rectifying radius, twice the root of n by 1 + n, and the coefficients of the transverse Mercator series both ways."""
    n = FLATTENING / (2 - FLATTENING)
    radius = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    to = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    return radius, 2 * n**0.5 / (1 + n), to, back


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone, to a millimetre within it."""
    radius, e, to, _ = _series()
    f, l = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(f)) - e * F.atanh(e * F.sin(f)))
    xi, eta = F.atan2(t, F.cos(l)), F.atanh(F.sin(l) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(to, 1):
        x, y = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta), y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return EAST + UTM_SCALE * radius * x, F.when(lat < 0, SOUTH).otherwise(0.0) + UTM_SCALE * radius * y


def from_utm(east: Column, north: Column, zone: Column, southern: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude of a point in a zone."""
    radius, e, _, back = _series()
    xi, eta = (north - F.when(southern, SOUTH).otherwise(0.0)) / (UTM_SCALE * radius), (east - EAST) / (UTM_SCALE * radius)
    x, y = xi, eta
    for k, b in enumerate(back, 1):
        x, y = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta), y - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    goal = F.sin(x) / F.cosh(y)  # sine of the conformal latitude
    f = F.asin(goal)
    for _ in range(6):  # the latitude by fixed-point steps
        f = F.asin(F.tanh(F.atanh(goal) + e * F.atanh(e * F.sin(f))))
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + zone * 6 - 183, F.degrees(f)
