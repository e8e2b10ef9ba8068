"""Web Mercator: tile and pixel coordinates in the dialects of tile servers, quadkeys, resolutions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.grid import col

# Fixed values of the projection.
MAX_LAT = 85.05112878
EARTH_RADIUS = 6378137.0
INCHES_PER_METRE = 1 / 0.0254


def _two(zoom) -> Column:
    return F.pow(F.lit(2.0), col(zoom))


def tile_xy(lon, lat, zoom) -> tuple[Column, Column]:
    """XYZ tile; the sine of the latitude is clamped to +-0.9999."""
    sine = F.least(F.greatest(F.sin(F.radians(col(lat))), F.lit(-0.9999)), F.lit(0.9999))
    x = F.floor(_two(zoom) * (col(lon) + 180.0) / 360.0)
    y = F.floor(_two(zoom) * (0.5 - F.ln((1.0 + sine) / (1.0 - sine)) / (4.0 * F.pi())))
    return x.cast("long"), y.cast("long")


def pixel_xy(lon, lat, zoom) -> tuple[Column, Column]:
    """Pixel of a map of 256 * 2^zoom, rounded half up and clipped: differs from tile_xy at tile edges."""
    size = 256.0 * _two(zoom)
    lat = F.least(F.greatest(col(lat), F.lit(-MAX_LAT)), F.lit(MAX_LAT))
    lon = F.least(F.greatest(col(lon), F.lit(-180.0)), F.lit(180.0))
    sine = F.sin(F.radians(lat))
    clip = lambda v: F.least(F.greatest(v * size + 0.5, F.lit(0.0)), size - 1.0).cast("long")
    return clip((lon + 180.0) / 360.0), clip(0.5 - F.ln((1.0 + sine) / (1.0 - sine)) / (4.0 * F.pi()))


def inverse(px, py, zoom) -> tuple[Column, Column]:
    """(lon, lat) of a pixel."""
    size = 256.0 * _two(zoom)
    x = F.least(F.greatest(col(px).cast("double"), F.lit(0.0)), size - 1.0) / size - 0.5
    y = 0.5 - F.least(F.greatest(col(py).cast("double"), F.lit(0.0)), size - 1.0) / size
    return 360.0 * x, 90.0 - 360.0 * F.atan(F.exp(-y * 2.0 * F.pi())) / F.pi()


def tile_west(x, zoom) -> Column:
    return col(x) / _two(zoom) * 360.0 - 180.0


def tile_north(y, zoom) -> Column:
    return 90.0 - 360.0 * F.atan(F.exp(-(0.5 - col(y) / _two(zoom)) * 2.0 * F.pi())) / F.pi()


def quadkey(tx, ty, zoom) -> Column:
    """A digit of two bits per level, the coarsest first."""
    return F.array_join(F.transform(F.sequence(col(zoom).cast("int") - 1, F.lit(0), F.lit(-1)), lambda i: (F.call_function("getbit", col(tx).cast("long"), i).cast("int") + 2 * F.call_function("getbit", col(ty).cast("long"), i).cast("int")).cast("string")), "")


def quadkey_xy(key) -> tuple[Column, Column]:
    digits = F.transform(F.sequence(F.lit(1), F.length(col(key))), lambda i: F.substring(col(key), i, F.lit(1)).cast("long"))
    fold = lambda bit: F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * 2 + bit(d))
    return fold(lambda d: F.pmod(d, F.lit(2))), fold(lambda d: F.floor(d / 2).cast("long"))


def parent_key(key, up: int) -> Column:
    return F.substring(col(key), F.lit(1), F.greatest(F.length(col(key)) - up, F.lit(0)))


def tms_y(ty, zoom) -> Column:
    return _two(zoom).cast("long") - col(ty) - 1


def ground_resolution(lat, zoom) -> Column:
    """Metres per pixel."""
    return F.cos(F.radians(F.least(F.greatest(col(lat), F.lit(-MAX_LAT)), F.lit(MAX_LAT)))) * 2.0 * F.pi() * F.lit(EARTH_RADIUS) / (256.0 * _two(zoom))


def map_scale(lat, zoom, dpi=96) -> Column:
    return ground_resolution(lat, zoom) * col(dpi) * F.lit(INCHES_PER_METRE)


def mercator_y(lat) -> Column:
    return F.ln(F.tan(F.pi() / 4.0 + F.radians(col(lat)) / 2.0))


def source_col(lon, x, step_x) -> Column:
    return (col(lon) - col(x)) / col(step_x)


def source_row(lat, y, step_y, height=None) -> Column:
    """Fractional row of an image; linear in latitude, or with a height in Mercator's y."""
    if height is None:
        return (col(lat) - col(y)) / col(step_y)
    bottom = mercator_y(col(y) + col(height) * col(step_y))
    return (mercator_y(lat) - mercator_y(y)) * col(height) / (bottom - mercator_y(y))


def bbox_overlap(a: dict, b: dict) -> Column:
    """Open intervals: boxes that share an edge only don't overlap."""
    return (col(a["w"]) < col(b["e"])) & (col(b["w"]) < col(a["e"])) & (col(a["s"]) < col(b["n"])) & (col(b["s"]) < col(a["n"]))


def sweref99tm(lat, lon) -> tuple[Column, Column]:
    """(northing, easting) in EPSG:3006: Gauss-Kruger on GRS 80, central meridian 15 degrees, scale 0.9996.

    The series to the fourth order in the third flattening are Krueger's; all terms are expressions.
    """
    f = 1 / 298.257222101
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e2 = f * (2 - f)
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - 15.0)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e2**0.5) * F.atanh(F.lit(e2**0.5) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    beta = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    north, east = xi, eta
    for k, b in enumerate(beta, 1):
        north = north + F.lit(b) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + F.lit(b) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return F.lit(0.9996 * a) * north, F.lit(0.9996 * a) * east + 500000.0


def url(template: str, tx, ty, zoom, scheme: str = "xyz", bbox: Column | None = None, width: int = 256, height: int = 256) -> Column:
    """Fill {x} {y} {z} {quadkey} {bbox} {width} {height} of a template for a scheme: xyz, tms, quadkey or wms."""
    y = tms_y(ty, zoom) if scheme == "tms" else col(ty)
    out = F.lit(template)
    values = {"x": col(tx).cast("string"), "y": y.cast("string"), "z": col(zoom).cast("string"), "width": F.lit(str(width)), "height": F.lit(str(height))}
    if scheme == "quadkey":
        values["quadkey"] = quadkey(tx, ty, zoom)
    if scheme == "wms":
        values["bbox"] = bbox
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
