"""Generators of tiles: map tiles of a square at a zoom, output tiles of a region, ranges of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import grid, mercator
from tilewright.functions.grid import col


def image_tiles(boxes: DataFrame, zoom: int) -> DataFrame:
    """All map tiles of boxes (w, e, s, n), with local columns and rows from 1.

    A further column and row follow while the last one added ends short of the box, so that the
    range ends with the first tile whose west (north) edge is at or past the east (south) edge.
    """
    x0, y0 = mercator.tile_xy("w", "n", F.lit(zoom))
    x1, y1 = mercator.tile_xy("e", "s", F.lit(zoom))
    east = lambda x: mercator.tile_west(x, F.lit(zoom)) < F.col("e")
    south = lambda y: mercator.tile_north(y, F.lit(zoom)) > F.col("s")
    last_x = F.greatest(F.when(east(x1), x1 + 1).otherwise(x1), x0 + 1)
    last_y = F.greatest(F.when(south(y1), y1 + 1).otherwise(y1), y0 + 1)
    t = boxes.select("*", x0.alias("_x0"), y0.alias("_y0"), last_x.alias("_x1"), last_y.alias("_y1"))
    t = t.withColumn("tile_y", F.explode(F.sequence("_y0", "_y1"))).withColumn("tile_x", F.explode(F.sequence("_x0", "_x1")))
    t = t.withColumn("local_x", F.col("tile_x") - F.col("_x0") + 1).withColumn("local_y", F.col("tile_y") - F.col("_y0") + 1)
    return t.drop("_x0", "_y0", "_x1", "_y1")


def grid_tiles(boxes: DataFrame, level) -> DataFrame:
    """Output tiles of boxes at a level (a number or a column)."""
    r = grid.tile_range("w", "e", "s", "n", level)
    t = boxes.select("*", *[c.alias(f"_{k}") for k, c in r.items()])
    t = t.withColumn("tx", F.explode(F.sequence("_x0", F.col("_x1") - 1))).withColumn("ty", F.explode(F.sequence("_y0", F.col("_y1") - 1)))
    return t.drop("_x0", "_x1", "_y0", "_y1")


def widen(ranges: Column) -> Column:
    """An array of (level, x0, x1, y0, y1): each range covers at least its coarser neighbour's children.

    Ranges go from coarse to fine; only consecutive levels widen each other.
    """
    ordered = F.sort_array(ranges)

    def step(acc, r):
        last = F.element_at(acc, -1)
        next_ = (last["level"] + 1) == r["level"]
        low = lambda a: F.when(next_, F.least(r[a], last[a] * 2)).otherwise(r[a]).alias(a)
        high = lambda a: F.when(next_, F.greatest(r[a], last[a] * 2)).otherwise(r[a]).alias(a)
        return F.concat(acc, F.array(F.struct(r["level"].alias("level"), low("x0"), high("x1"), low("y0"), high("y1"))))

    return F.aggregate(F.slice(ordered, 2, F.size(ordered)), F.slice(ordered, 1, 1), step)


def pixel_centres(tx, ty, level, n: int) -> tuple[Column, Column]:
    """Longitudes of a tile's columns and latitudes of its rows (row 0 in the north), n each."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    e = grid.square_edges(tx, ty, level)
    lons = F.transform(steps, lambda i: e["w"] + (i + 0.5) * (e["e"] - e["w"]) / n)
    lats = F.transform(steps, lambda j: grid.lat_of_grid_y(col(ty) + 1.0 - (j + 0.5) / n, level))
    return lons, lats


def empty_neighbours(cells: DataFrame) -> DataFrame:
    """Cells (x, y) beside the given ones that are not among them."""
    t = cells.select("x", "y").distinct()
    near = t.select(F.explode(F.sequence(F.col("x") - 1, F.col("x") + 1)).alias("x"), "y")
    near = near.select("x", F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("y")).distinct()
    return near.join(t, ["x", "y"], "left_anti")
