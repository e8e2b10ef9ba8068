"""Joins of boxes and points by cells: an equi-join on a cell key with the exact test as residual.

A theta join of two frames would be a nested loop. Each box is exploded to the cells that it
touches, a point to its one; candidates meet by cell, and a pair that shares several cells is
reported in one of them only (the cell of its common corner), so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(lo: str, hi: str, cell: float):
    return F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))


def box_join(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (w, e, s, n) that overlap as open intervals; sides are named a and b."""
    cells = lambda t: t.withColumn("_cx", F.explode(_cells("w", "e", cell))).withColumn("_cy", F.explode(_cells("s", "n", cell)))
    l, r = cells(a).alias("a"), cells(b).alias("b")
    on = (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
    on &= (F.col("a.w") < F.col("b.e")) & (F.col("b.w") < F.col("a.e")) & (F.col("a.s") < F.col("b.n")) & (F.col("b.s") < F.col("a.n"))
    on &= F.col("a._cx") == F.floor(F.greatest(F.col("a.w"), F.col("b.w")) / cell)
    on &= F.col("a._cy") == F.floor(F.greatest(F.col("a.s"), F.col("b.s")) / cell)
    return l.join(r, on)


def crowded_box_join(a: DataFrame, b: DataFrame, cell: float, columns: list[Column]) -> DataFrame:
    """As box_join, of it the given columns, for boxes that overlap many others: a pair is tested in the cell of its common corner only.

    That corner has the west edge of one box and the south edge of one: so of each side boxes go with their
    west or all their columns, and their south or all their rows, in four joins. Where west or south edges are
    equal, they count as a's. With cells much smaller than boxes, nearly every pair that is tested is one.
    """
    out = None
    for west_of_a in (True, False):
        for south_of_a in (True, False):
            at = lambda own, lo, hi: F.array(F.floor(F.col(lo) / cell)) if own else _cells(lo, hi, cell)
            placed = lambda t, w, s: t.withColumn("_cx", F.explode(at(w, "w", "e"))).withColumn("_cy", F.explode(at(s, "s", "n")))  # noqa: B023, E731
            l, r = placed(a, west_of_a, south_of_a).alias("a"), placed(b, not west_of_a, not south_of_a).alias("b")
            on = (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
            on &= (F.col("a.w") < F.col("b.e")) & (F.col("b.w") < F.col("a.e")) & (F.col("a.s") < F.col("b.n")) & (F.col("b.s") < F.col("a.n"))
            on &= (F.col("a.w") >= F.col("b.w")) if west_of_a else (F.col("a.w") < F.col("b.w"))
            on &= (F.col("a.s") >= F.col("b.s")) if south_of_a else (F.col("a.s") < F.col("b.s"))
            met = l.join(r, on).select(*columns)
            out = met if out is None else out.union(met)
    return out


def point_in_box(points: DataFrame, boxes: DataFrame, cell: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """Points (named p) in half-open boxes (named b)."""
    p = points.withColumn("_cx", F.floor(F.col(x) / cell)).withColumn("_cy", F.floor(F.col(y) / cell)).alias("p")
    b = boxes.withColumn("_cx", F.explode(_cells("w", "e", cell))).withColumn("_cy", F.explode(_cells("s", "n", cell))).alias("b")
    on = (F.col("p._cx") == F.col("b._cx")) & (F.col("p._cy") == F.col("b._cy"))
    on &= (F.col(f"p.{x}") >= F.col("b.w")) & (F.col(f"p.{x}") < F.col("b.e")) & (F.col(f"p.{y}") >= F.col("b.s")) & (F.col(f"p.{y}") < F.col("b.n"))
    return p.join(b, on)


def in_parts(rows: DataFrame, at: list[str], by: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """rows with _part, by which groups of more than `most` rows are dealt out, and the parts (at, _parts) of such groups.

    Those are one at most for each `most` rows, so they may be broadcast.
    """
    large = F.broadcast(rows.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts")).where("_parts > 1"))
    part = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64(*by), "_parts")).otherwise(0).cast("long")
    return rows.join(large, at, "left").withColumn("_part", part).drop("_parts"), large


def for_parts(rows: DataFrame, at: list[str], large: DataFrame) -> DataFrame:
    """rows, one for each part of their group."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))
    return rows.join(large, at, "left").withColumn("_part", parts).drop("_parts")
