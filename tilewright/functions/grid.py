"""The nested world grid: column functions between degrees, grid coordinates and tile names.

x counts from the date line eastwards, y from the south pole northwards; at level L there are 2^L
tiles each way. Rows are spaced by a scaled tangent of the latitude (not Mercator). A tile's name
gives its corner at level 16 in hexadecimal, so children of a tile share its name's prefix space.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid: the latitude factor and the level that names count in.
K = 2.3311223704144
NAME_LEVEL = 16


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _side(level) -> Column:
    return F.pow(F.lit(2.0), col(level))


def grid_x(lon, level) -> Column:
    return _side(level) * (0.5 + 0.5 * col(lon) / 180.0)


def grid_y(lat, level) -> Column:
    return _side(level) * (0.5 + 0.5 * F.tan(F.lit(K) * col(lat) / 180.0) / F.lit(K))


def lon_of_grid_x(x, level) -> Column:
    return (2.0 * col(x) / _side(level) - 1.0) * 180.0


def lat_of_grid_y(y, level) -> Column:
    return F.atan((2.0 * col(y) / _side(level) - 1.0) * F.lit(K)) * 180.0 / F.lit(K)


def tile_x(lon, level) -> Column:
    return F.floor(grid_x(lon, level)).cast("long")


def tile_y(lat, level) -> Column:
    return F.floor(grid_y(lat, level)).cast("long")


def _step(level) -> Column:
    return F.expr("1L") * F.pow(F.lit(2.0), F.lit(NAME_LEVEL) - col(level)).cast("long")


def square_name(tx, ty, level) -> Column:
    """Eight hexadecimal digits: XXXX_YYYY."""
    return F.format_string("%04x_%04x", col(tx) * _step(level), col(ty) * _step(level))


def tile_name(tx, ty, level, mask=False) -> Column:
    tail = F.when(col(mask), F.lit("_mask")).otherwise(F.lit(""))
    return F.concat(F.format_string("map_%02d_", col(level).cast("long")), square_name(tx, ty, level), tail, F.lit(".ttc"))


TILE_PATTERN = r"^map_([0-9]{2})_([0-9a-f]{4})_([0-9a-f]{4})(_mask)?\.ttc$"
SQUARE_PATTERN = r"^map_([0-9]{2})_([0-9a-f]{4})_([0-9a-f]{4})$"


def parse_tile_name(name, pattern: str = TILE_PATTERN) -> Column:
    """A struct (level, tx, ty, mask); null for names that are no tile's."""
    part = lambda k: F.regexp_extract(col(name), pattern, k)
    level = F.try_to_number(part(1), F.lit("99")).cast("int")
    hexed = lambda k: F.conv(part(k), 16, 10).cast("long")
    step = _step(level)
    ok = F.regexp_like(col(name), F.lit(pattern)) & level.between(1, NAME_LEVEL)
    fits = (F.pmod(hexed(2), step) == 0) & (F.pmod(hexed(3), step) == 0)
    masked = F.length(part(4)) > 0 if pattern == TILE_PATTERN else F.lit(False)
    return F.when(ok, F.when(fits, F.struct(level.cast("long").alias("level"), F.floor(hexed(2) / step).cast("long").alias("tx"), F.floor(hexed(3) / step).cast("long").alias("ty"), masked.alias("mask"))))


def square_edges(tx, ty, level) -> dict[str, Column]:
    """West, east, south and north of a tile."""
    return {
        "w": lon_of_grid_x(col(tx).cast("double"), level), "e": lon_of_grid_x(col(tx) + 1.0, level),
        "s": lat_of_grid_y(col(ty).cast("double"), level), "n": lat_of_grid_y(col(ty) + 1.0, level),
    }


def tile_range(w, e, s, n, level) -> dict[str, Column]:
    """Half-open ranges of tiles that a box touches, one tile at least."""
    x0, y0 = tile_x(w, level), tile_y(s, level)
    x1, y1 = F.ceil(grid_x(e, level)).cast("long"), F.ceil(grid_y(n, level)).cast("long")
    return {"x0": x0, "x1": F.greatest(x1, x0 + 1), "y0": y0, "y1": F.greatest(y1, y0 + 1)}


def square_center(n, w, s, e) -> tuple[Column, Column]:
    """(lat, lon): the great-circle midpoint of the north-west and south-east corners."""
    a, b = F.radians(col(n)), F.radians(col(s))
    d = F.radians(col(e) - col(w))
    bx, by = F.cos(b) * F.cos(d), F.cos(b) * F.sin(d)
    lat = F.atan2(F.sin(a) + F.sin(b), F.sqrt((F.cos(a) + bx) * (F.cos(a) + bx) + by * by))
    lon = F.radians(col(w)) + F.atan2(by, F.cos(a) + bx)
    return F.degrees(lat), F.degrees(lon)


def landmark_cell(lon, lat) -> tuple[Column, Column]:
    return tile_x(lon, 7), tile_y(lat, 7)


def km_per_degree(lat, north: float = 110.9, east: float = 111.32) -> tuple[Column, Column]:
    """Kilometres of a degree (east, north) at a latitude; each module of the engine names its own constants."""
    return F.lit(east) * F.cos(F.radians(col(lat))), F.lit(north)


PI = math.pi
