"""Edges of a covered area: distance to the nearest empty cell and the alpha ramp from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def box_distance(points: DataFrame, keys: list[str], cells: DataFrame, kx: float, ky: float, most_km: float) -> DataFrame:
    """km from points (px, py, in cells) to the nearest of cells (x, y), of points with one nearer than most_km.

    Points meet the cells within that reach only: an equi-join on the cells around a point.
    """
    rx, ry = int(most_km / kx) + 1, int(most_km / ky) + 1
    p = points.select(*keys, "px", "py", F.explode(F.sequence(F.floor("px") - rx, F.floor("px") + rx)).alias("x"))
    p = p.select(*keys, "px", "py", "x", F.explode(F.sequence(F.floor("py") - ry, F.floor("py") + ry)).alias("y"))
    gap = lambda c, v: F.greatest(F.col(c) - F.col(v), F.lit(0.0), F.col(v) - F.col(c) - 1)
    km = F.min(F.hypot(gap("x", "px") * kx, gap("y", "py") * ky))
    return p.join(cells.select("x", "y"), ["x", "y"]).groupBy(*keys).agg(km.alias("km")).where(F.col("km") < most_km)


def edge_alpha(points: DataFrame, keys: list[str], empty: DataFrame, kx: float, ky: float, fade_km: float, steps: int = 0) -> DataFrame:
    """alpha of points (px, py, in cells): distance to the nearest empty cell over the fade, null beyond it."""
    near = box_distance(points, keys, empty, kx, ky, fade_km)
    ramp = F.least(F.greatest(F.col("km") / fade_km, F.lit(0.0)), F.lit(1.0))
    ramp = F.bround(ramp * steps, 0) / steps if steps else ramp
    return points.select(*keys).join(near, keys, "left").select(*keys, F.when(F.col("km") < fade_km, ramp).alias("alpha"))
