"""Window-style operators: runs, coasts, stretches, borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coast_column(pixels: DataFrame, land: str, ahead: int = 32, share: float = 0.75) -> DataFrame:
    """Per row the first column from which the next `ahead` are mostly land; null if that is the first column."""
    w = Window.partitionBy("y").orderBy("x").rowsBetween(0, ahead - 1)
    t = pixels.withColumn("_m", F.avg(F.col(land).cast("int")).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    first = F.min(F.when((F.col("_m") >= share) & (F.col("_n") == ahead), F.col("x")))
    return t.groupBy("y").agg(first.alias("x")).select("y", F.when(F.col("x") > 0, F.col("x")).alias("x"))


def coverage_edge(pixels: DataFrame, black: str, built: str, coast: DataFrame, gap: int = 32) -> DataFrame:
    """Walking west from the coast: y, the column where coverage ends (x) and whether that was seen (resolved).

    Coverage ends at the first run of at least `gap` black pixels of built data; shorter runs are holes. Where built
    data end first, the column is the last one built and the row is not resolved. x is null where there is no coast.
    """
    from tilewright.operators.raster import runs

    west = coast.where("x is not null").select("y", F.col("x").alias("_c"))
    # built data reach from the coast to the nearest column that is not built
    seen = pixels.select("y", "x", F.col(built).alias("_built"), F.col(black).alias("_black")).join(west, "y").where(F.col("x") < F.col("_c"))
    edge = seen.groupBy("y").agg(F.coalesce(F.max(F.when(~F.col("_built"), F.col("x"))) + 1, F.lit(0)).alias("_first"))
    dark = seen.join(edge, "y").where(F.col("x") >= F.col("_first"))
    found = runs(dark, "_black").where(F.col("x1") - F.col("x0") + 1 >= gap).groupBy("y").agg(F.max("x1").alias("_x1"))
    out = coast.select("y", "x").withColumnRenamed("x", "_c").join(edge, "y", "left").join(found, "y", "left")
    x = F.when(F.col("_c").isNull(), None).otherwise(F.coalesce(F.col("_x1") + 1, "_first", F.lit(0)))
    return out.select("y", x.alias("x"), F.col("_x1").isNotNull().alias("resolved"))


def stretches(rows: DataFrame, gap: float = 0.02, least: int = 20) -> DataFrame:
    """Rows (lat, lon) of one line split where latitudes jump; those with enough rows, with bounds and modal longitude."""
    w = Window.partitionBy("line").orderBy("lat")
    t = rows.withColumn("_b", F.when(F.col("lat") - F.lag("lat").over(w) > gap, 1).otherwise(0)).withColumn("part", F.sum("_b").over(w))
    t = t.groupBy("line", "part").agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("lo"), F.max("lat").alias("hi"), F.mode("lon", True).alias("lon"))
    return t.where(F.col("n") >= least)


def longest_join(points: DataFrame, rings: bool = False, order: DataFrame | None = None) -> DataFrame:
    """Per line the widest gap in kilometres between strokes as they are chained; of rings also that which closes them. order: of strokes.chain_order, if it is there."""
    from tilewright.operators.lines import KM_NORTH, _east
    from tilewright.operators.strokes import chain_order

    end = lambda n: F.struct(F.col(f"{n}_lat").alias("lat"), F.col(f"{n}_lon").alias("lon"))
    turned = lambda n, m: F.when(F.col("flipped"), end(m)).otherwise(end(n))
    ends = (chain_order(points) if order is None else order).select("line", "place", turned("first", "last").alias("a"), turned("last", "first").alias("b"))
    km = lambda p, q: F.sqrt(F.pow((q["lon"] - p["lon"]) * _east((q["lat"] + p["lat"]) / 2), F.lit(2.0)) + F.pow((q["lat"] - p["lat"]) * KM_NORTH, F.lit(2.0)))
    gaps = ends.withColumn("gap", km(F.lag("b").over(Window.partitionBy("line").orderBy("place")), F.col("a")))
    out = gaps.groupBy("line").agg(F.max("gap").alias("gap"), F.min_by("a", "place").alias("_first"), F.max_by("b", "place").alias("_last"))
    gap = F.coalesce("gap", F.lit(0.0))
    return out.select("line", (F.greatest(gap, km(F.col("_last"), F.col("_first"))) if rings else gap).alias("gap"))


def snap_border(pixels: DataFrame, around: int, reach: int = 24, least: float = 4.0) -> DataFrame:
    """Per row the column near `around` with the strongest step between the four columns on either side."""
    w = Window.partitionBy("y").orderBy("x")
    step = F.abs(F.avg("g").over(w.rowsBetween(0, 3)) - F.avg("g").over(w.rowsBetween(-4, -1)))
    t = pixels.withColumn("step", step).where(F.col("x").between(around - reach, around + reach) & (F.col("x") >= 4))
    t = t.groupBy("y").agg(F.max(F.struct("step", (-F.col("x")).alias("x"))).alias("m"))
    return t.where(F.col("m.step") >= least).select("y", (-F.col("m.x")).alias("x"), "m.step")
