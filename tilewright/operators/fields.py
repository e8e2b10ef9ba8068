"""Fields of texels: bilinear and nearest lookups, ranges under boxes, parents and stitching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bilinear(points: DataFrame, field: DataFrame, key: list[str], value: str, w: int, h: int) -> DataFrame:
    """points with fractional texel places fi, fj: the weighted sum of four texels, clamped at the edge."""
    i, j = F.least(F.greatest(F.col("fi"), F.lit(0.0)), F.lit(w - 1.0)), F.least(F.greatest(F.col("fj"), F.lit(0.0)), F.lit(h - 1.0))
    t = points.select(*key, i.alias("_fi"), j.alias("_fj")).withColumn("_i", F.least(F.floor("_fi"), F.lit(w - 2))).withColumn("_j", F.least(F.floor("_fj"), F.lit(h - 2)))
    u, v = F.col("_fi") - F.col("_i"), F.col("_fj") - F.col("_j")
    corner = lambda a, b, weight: F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), weight.alias("w"))
    t = t.select(*key, F.explode(F.array(corner(0, 0, (1 - u) * (1 - v)), corner(1, 0, u * (1 - v)), corner(0, 1, (1 - u) * v), corner(1, 1, u * v))).alias("c")).select(*key, "c.*")
    return t.join(field, ["i", "j"]).groupBy(*key).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def nearest(points: DataFrame, field: DataFrame, key: list[str], w: int, h: int) -> DataFrame:
    """The texel at the place rounded half to even, clamped."""
    clamp = lambda c, n: F.least(F.greatest(F.bround(c, 0), F.lit(0.0)), F.lit(n - 1.0)).cast("long")
    return points.select(*key, clamp("fi", w).alias("i"), clamp("fj", h).alias("j")).join(field, ["i", "j"])


def range_under(boxes: DataFrame, field: DataFrame, key: list[str], value: str, w: int, h: int) -> DataFrame:
    """Least and greatest of all texels that a lookup within a box (i0, i1, j0, j1, fractional) could touch."""
    low = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1)).cast("long")
    high = lambda c, n: F.least(F.greatest(F.floor(c) + 1, F.lit(0)), F.lit(n - 1)).cast("long")
    t = boxes.select(*key, F.explode(F.sequence(low("i0", w), high("i1", w))).alias("i"), low("j0", h).alias("_a"), high("j1", h).alias("_b"))
    t = t.select(*key, "i", F.explode(F.sequence("_a", "_b")).alias("j"))
    return t.join(field, ["i", "j"]).groupBy(*key).agg(F.min(value).alias("least"), F.max(value).alias("most"))


def parents(tiles: DataFrame) -> DataFrame:
    """Tiles (tx, ty) with their parent and quadrant; 2y + 1 is the northern row."""
    return tiles.withColumn("px", F.shiftright("tx", 1)).withColumn("py", F.shiftright("ty", 1)).withColumn("qx", F.col("tx").bitwiseAND(1)).withColumn("north", F.col("ty").bitwiseAND(1) == 1)


def stitch(grid: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Every place of a grid (x, y) with its pixel offset and whether a tile is there: gaps stay transparent."""
    t = tiles.select(F.col("tile_x").alias("x"), F.col("tile_y").alias("y")).distinct().withColumn("_t", F.lit(True))
    return grid.join(t, ["x", "y"], "left").select("x", "y", (F.col("x") * size).alias("px"), (F.col("y") * size).alias("py"), F.coalesce("_t", F.lit(False)).alias("present"))
