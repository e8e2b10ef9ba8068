"""Rasters at the pixel tier: one row per pixel (y, x, r, g, b, ...), row 0 in the north.

For small tiles and tests; operators.blocks holds the same kernels over whole tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def test_pattern(spark: SparkSession, n: int, noise: DataFrame | None = None) -> DataFrame:
    """Four quadrants: a gradient, a flat colour, integer noise, a checkerboard; with holes in `have`.

    noise: (i, h, n) of pixels y * n + x, the noise itself and what shifts the holes; else an integer hash.
    """
    t = spark.range(n * n).selectExpr("id AS i", f"id div {n} AS y", f"id % {n} AS x")
    if noise is None:
        t = t.selectExpr("y", "x", "(x*73856093 + y*19349663) % 16777216 AS h", "0L AS n")
    else:
        t = t.join(noise, "i", "left").selectExpr("y", "x", "coalesce(h, 0L) AS h", "coalesce(n, 0L) AS n")
    t = t.selectExpr("y", "x", "h", "n", f"CASE WHEN x >= {n // 2} THEN 1 ELSE 0 END + CASE WHEN y >= {n // 2} THEN 2 ELSE 0 END AS q", "(x div 8 + y div 8) % 2 AS c")
    return t.selectExpr(
        "y", "x", "CASE q WHEN 0 THEN x*4 WHEN 1 THEN 37 WHEN 2 THEN h % 256 ELSE c*255 END AS r",
        "CASE q WHEN 0 THEN y*4 WHEN 1 THEN 121 WHEN 2 THEN (h div 256) % 256 ELSE 255 - c*255 END AS g",
        "CASE q WHEN 0 THEN (x + y)*2 WHEN 1 THEN 200 WHEN 2 THEN (h div 65536) % 256 ELSE c*128 END AS b", "(x*7 + y*13 + n) % 11 > 2 AS have",
    )


def adjusted(pixels: DataFrame, brightness: int = 0, contrast: int = 0, saturation: float = 0) -> DataFrame:
    """Brightness and contrast as linear levels (-127 to 127), then saturation (-100 to 100) about the grey of a pixel.

    Brightness moves the range, contrast stretches or narrows it evenly at both ends; results are cut to whole numbers.
    """
    clipped = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))

    def levels(c: str):
        v = F.col(c).cast("double")
        if brightness:
            v = clipped(v + brightness)
        if contrast > 0:
            v = F.floor(clipped((v - contrast) * 255.0 / (255 - 2 * contrast)))
        elif contrast < 0:
            v = F.floor(clipped(v * (255.0 + 2 * contrast) / 255 - contrast))
        return v.cast("double")

    out = pixels.select("*", *[levels(c).alias(f"_{c}") for c in "rgb"])
    if saturation:
        grey = 0.299 * F.col("_r") + 0.587 * F.col("_g") + 0.114 * F.col("_b")
        out = out.withColumn("_grey", grey).select("*", *[clipped(F.col("_grey") + (F.col(f"_{c}") - F.col("_grey")) * (1 + 0.6 * saturation / 100)).alias(f"s_{c}") for c in "rgb"])
        out = out.drop("_r", "_g", "_b", "_grey").withColumnsRenamed({f"s_{c}": f"_{c}" for c in "rgb"})
    return out.drop("r", "g", "b").select("*", *[F.floor(f"_{c}").alias(c) for c in "rgb"]).drop("_r", "_g", "_b")


def halve(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """2 x 2 box in integers, (sum + 2) div 4; coverage if two of four are covered."""
    keys = keys or []
    out = pixels.groupBy(*keys, F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"))
    box = lambda c: F.floor((F.sum(c) + 2) / 4).cast("long").alias(c)
    return out.agg(box("r"), box("g"), box("b"), (F.sum(F.col("have").cast("int")) >= 2).alias("have"))


def pyramid(pixels: DataFrame, levels: int) -> DataFrame:
    """The raster and its halvings, with a column `up` that counts them."""
    out, now = pixels.withColumn("up", F.lit(0)), pixels
    for k in range(1, levels + 1):
        now = halve(now)
        out = out.unionByName(now.withColumn("up", F.lit(k)))
    return out


def box_mean(pixels: DataFrame, value: str, k: int, n: int, out: str = "mean") -> DataFrame:
    """Separable k x k mean with edges padded by their own values; k is made odd, 3 at least."""
    k = max(3, k | 1)
    p = k // 2

    def along(df: DataFrame, c: str, part: str, order: str) -> DataFrame:
        frame = Window.partitionBy(part).orderBy(order)
        near = frame.rowsBetween(-p, p)
        edge = Window.partitionBy(part)
        first, last = F.min_by(c, order).over(edge), F.max_by(c, order).over(edge)
        before, after = F.greatest(p - F.col(order), F.lit(0)), F.greatest(F.col(order) + p - (n - 1), F.lit(0))
        return df.withColumn(c, (F.sum(c).over(near) + before * first + after * last) / float(k))

    df = pixels.withColumn(out, F.col(value).cast("double"))
    return along(along(df, out, "y", "x"), out, "x", "y")


def dilate(pixels: DataFrame, mask: str, r: int, erode: bool = False) -> DataFrame:
    """Square dilation (or erosion) of a boolean column by r pixels, separable."""
    pick = F.min if erode else F.max
    x, y = Window.partitionBy("y").orderBy("x").rowsBetween(-r, r), Window.partitionBy("x").orderBy("y").rowsBetween(-r, r)
    return pixels.withColumn(mask, pick(mask).over(x)).withColumn(mask, pick(mask).over(y))


def runs(pixels: DataFrame, mask: str) -> DataFrame:
    """Runs of true in each row: y, x0, x1 (inclusive)."""
    w = Window.partitionBy("y").orderBy("x")
    t = pixels.where(F.col(mask)).withColumn("_g", F.col("x") - F.row_number().over(w))
    return t.groupBy("y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def bc1_blocks(pixels: DataFrame) -> DataFrame:
    """4 x 4 blocks: by, bx, c0, c1 (565 of the maxima and minima, the larger first) and 32 bits of indices.

    One pass: a block is a group whose sixteen pixels are collected, a bounded array, and coded there.
    """
    from tilewright.functions.colour import pack565, unpack565

    block = pixels.groupBy(F.expr("y div 4").alias("by"), F.expr("x div 4").alias("bx"))
    agg = [f(c).alias(f"{n}{c}") for n, f in (("hi_", F.max), ("lo_", F.min)) for c in "rgb"]
    pixel = F.struct(F.expr("(y % 4)*4 + x % 4").alias("i"), "r", "g", "b")
    t = block.agg(*agg, F.sort_array(F.collect_list(pixel)).alias("px"))
    t = t.withColumn("p", pack565("hi_r", "hi_g", "hi_b")).withColumn("q", pack565("lo_r", "lo_g", "lo_b"))
    t = t.withColumn("c0", F.greatest("p", "q")).withColumn("c1", F.least("p", "q"))
    e0, e1 = unpack565("c0"), unpack565("c1")
    third = lambda a, b: F.floor((2 * a + b) / 3).cast("long")
    palette = [e0, e1, tuple(third(a, b) for a, b in zip(e0, e1, strict=True)), tuple(third(b, a) for a, b in zip(e0, e1, strict=True))]
    t = t.withColumn("pal", F.array(*[F.struct(*[c.alias(n) for c, n in zip(e, "rgb", strict=True)]) for e in palette]))

    def index(px):
        d = F.transform(F.col("pal"), lambda e: (px["r"] - e["r"]) * (px["r"] - e["r"]) + (px["g"] - e["g"]) * (px["g"] - e["g"]) + (px["b"] - e["b"]) * (px["b"] - e["b"]))
        return F.array_position(d, F.array_min(d)) - 1

    bits = F.aggregate(F.transform("px", lambda px: index(px) * F.pow(F.lit(4.0), px["i"]).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return t.select("by", "bx", "c0", "c1", bits.alias("bits"))


def bc1_pixels(blocks: DataFrame) -> DataFrame:
    """The inverse: y, x, r, g, b."""
    from tilewright.functions.colour import unpack565

    e0, e1 = unpack565("c0"), unpack565("c1")
    third = lambda a, b: F.floor((2 * a + b) / 3).cast("long")
    t = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    k = F.pmod(F.floor(F.col("bits") / F.pow(F.lit(4.0), F.col("i"))).cast("long"), F.lit(4))
    colours = [F.when(k == 0, a).when(k == 1, b).when(k == 2, third(a, b)).otherwise(third(b, a)) for a, b in zip(e0, e1, strict=True)]
    return t.select((F.col("by") * 4 + F.expr("i div 4")).alias("y"), (F.col("bx") * 4 + F.expr("i % 4")).alias("x"), *[c.alias(n) for c, n in zip(colours, "rgb", strict=True)])
