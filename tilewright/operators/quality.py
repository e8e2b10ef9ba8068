"""Aggregations: quality metrics, histograms, percentiles, pooling and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.grid import col


def mean_error(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """mae, mse and psnr (dB) over the three channels of two rasters."""
    t = a.alias("a").join(b.alias("b"), keys)
    diff = [F.col(f"a.{c}") - F.col(f"b.{c}") for c in "rgb"]
    mae = F.avg(sum((F.abs(x) for x in diff), F.lit(0)) / 3.0)
    mse = F.avg(sum((x * x for x in diff), F.lit(0)) / 3.0)
    return t.agg(mae.alias("mae"), mse.alias("mse"), F.when(mse > 0, 10 * F.log10(255.0 * 255.0 / mse)).alias("psnr"))


def mip_bytes(n) -> Column:
    """Bytes of each level of a square texture whose side is a column: 4 x 4 blocks of 8 bytes, down to one pixel."""
    level = lambda k: F.greatest(F.lit(1).cast("long"), F.ceil(F.floor(col(n) / F.pow(F.lit(2.0), k)) / 4))
    return F.transform(F.sequence(F.lit(0), F.floor(F.log2(col(n).cast("double"))).cast("int")), lambda k: 8 * level(k) * level(k))


def mip_sizes(n: int) -> list[int]:
    """Bytes of each level of a BC1 mip chain of an n x n texture, down to one block."""
    out = []
    while n:
        out.append(max(1, -(-n // 4)) ** 2 * 8)
        n //= 2
    return out


def histogram(df: DataFrame, value: str, width: float, bins: int, marked: str, keys: list[str] | None = None) -> DataFrame:
    """Rows and marked rows by bin (the last one open), with running shares."""
    keys = keys or []
    t = df.groupBy(*keys, F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).cast("long").alias("bin"))
    t = t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(marked)).alias("marked"))
    upto = Window.partitionBy(*keys).orderBy("bin") if keys else Window.orderBy("bin")  # one row per bin
    return t.withColumn("share", F.sum("marked").over(upto) / F.sum("n").over(upto))


def percentiles(df: DataFrame, value: str, at: list[float], keys: list[str], least_rows: int = 0) -> DataFrame:
    t = df.groupBy(*keys).agg(F.percentile(value, F.lit(at)).alias("p"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows)
    return t.select(*keys, "n", *[F.col("p")[k].alias(f"p{round(100 * a)}") for k, a in enumerate(at)])


def body_targets(texels: DataFrame, small_km2: float = 1.5, blue: float = 15.0, no_fix: float = 1000.0) -> DataFrame:
    """Per body its tone (15th percentile per channel) and area; bodies that are not blue enough are
    rejected; small ones take the tone of all texels of accepted ones."""
    t = texels.groupBy("body").agg(*[F.percentile(c, 0.15).alias(c) for c in "rgb"], F.sum("km2").alias("km2"))
    t = t.withColumn("ok", F.col("b") - F.col("r") >= blue)
    overall = texels.join(t.where("ok").select("body"), "body", "left_semi").agg(*[F.percentile(c, 0.15).alias(f"all_{c}") for c in "rgb"])
    tone = lambda c: F.when(~F.col("ok"), no_fix).when(F.col("km2") < small_km2, F.col(f"all_{c}")).otherwise(F.col(c)).alias(c)
    return t.crossJoin(F.broadcast(overall)).select("body", "km2", *[tone(c) for c in "rgb"])  # overall is one row


def stitch_bounds(tiles: DataFrame, per: int) -> DataFrame:
    """Bounds and used columns and rows of each stitched image of per x per tiles."""
    t = tiles.withColumn("set_x", F.floor((F.col("local_x") - 1) / per)).withColumn("set_y", F.floor((F.col("local_y") - 1) / per))
    return t.groupBy("set_x", "set_y").agg(F.min("tile_x").alias("x0"), F.max("tile_x").alias("x1"), F.min("tile_y").alias("y0"), F.max("tile_y").alias("y1"), F.max((F.col("local_x") - 1) % per + 1).alias("cols"), F.max((F.col("local_y") - 1) % per + 1).alias("rows"), F.count_distinct("local_y").alias("rows_used"))


def stitch_cap(width: int, height: int) -> int:
    """Tiles each way that one stitched image may have: four bytes a pixel within 80 % of 2^31 - 1."""
    return int(((2**31 - 1) * 0.8 / (width * height * 4)) ** 0.5)


def best_level(tiles: DataFrame, share: Column, enough: float = 0.98) -> DataFrame:
    """Of candidate levels (up) the first that fills enough tiles, else the one that fills most."""
    t = tiles.groupBy("up").agg(F.avg((share < 0.01).cast("int")).alias("filled"))
    return t.agg(F.coalesce(F.min(F.when(F.col("filled") >= enough, F.col("up"))), F.max_by("up", F.struct("filled", -F.col("up")))).alias("up"))


def gradient_profile(pixels: DataFrame, width: int, least: int) -> DataFrame:
    """Mean absolute change of green along rows by bin of columns."""
    step = F.abs(F.col("g") - F.lag("g").over(Window.partitionBy("y").orderBy("x")))
    t = pixels.withColumn("_d", step).where("_d is not null")
    return t.groupBy(F.floor(F.col("x") / width).alias("bin")).agg(F.avg("_d").alias("g"), F.count(F.lit(1)).alias("n")).where(F.col("n") > least)


def patch_offsets(pixels: DataFrame, least: int = 5) -> DataFrame:
    """For each pair of touching labels the median step per channel over their border, and its weight."""
    right = pixels.select("y", (F.col("x") - 1).alias("x"), *[F.col(c).alias(f"n_{c}") for c in ("label", "r", "g", "b")])
    below = pixels.select((F.col("y") - 1).alias("y"), "x", *[F.col(c).alias(f"n_{c}") for c in ("label", "r", "g", "b")])
    t = pixels.join(right.unionByName(below), ["y", "x"]).where("label <> n_label")
    sign = F.when(F.col("label") < F.col("n_label"), 1).otherwise(-1)
    t = t.select(F.least("label", "n_label").alias("p"), F.greatest("label", "n_label").alias("q"), *[(sign * (F.col(f"n_{c}") - F.col(c))).alias(c) for c in "rgb"])
    t = t.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, 0.5).alias(c) for c in "rgb"]).where(F.col("n") >= least)
    return t.withColumn("weight", F.sqrt("n"))


def solve_offsets(pairs: list, fixed: int) -> dict[int, list[float]]:
    """Least squares over the pairs' median steps: one unknown per label, the fixed one zero. Few labels: on the driver."""
    import numpy as np

    names = sorted({x for r in pairs for x in (r["p"], r["q"])} - {fixed})
    at = {n: k for k, n in enumerate(names)}
    a, y = np.zeros((len(pairs), len(names))), np.zeros((len(pairs), 3))
    for i, r in enumerate(pairs):
        for n, s in ((r["q"], -1.0), (r["p"], 1.0)):
            if n != fixed:
                a[i, at[n]] += s * r["weight"]
        y[i] = [r[c] * r["weight"] for c in "rgb"]
    found = np.linalg.lstsq(a, y, rcond=None)[0] if names else np.zeros((0, 3))
    return {fixed: [0.0, 0.0, 0.0]} | {n: found[k].tolist() for n, k in at.items()}
