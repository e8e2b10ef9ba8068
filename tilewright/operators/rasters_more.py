"""Further pixel-tier operators: sampling, correction, water, fills, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.colour import corrected, is_black


def paint_stripes(pixels: DataFrame, stripes: list[tuple[int, int, int]]) -> DataFrame:
    """Columns [a, b) of a stripe get its colour; stripes are few and become one expression."""
    stripe = F.lit(None).cast("long")
    for k, a, b in stripes:
        stripe = F.when((F.col("x") >= a) & (F.col("x") < b), k).otherwise(stripe)
    t = pixels.withColumn("_s", stripe)
    return t.withColumn("r", F.coalesce(F.col("_s") * 40, F.col("r"))).withColumn("mask", F.when(F.col("_s") % 2 == 0, 255).otherwise(0)).drop("_s")


def flip_rows(pixels: DataFrame, n: int) -> DataFrame:
    return pixels.withColumn("y", F.lit(n - 1) - F.col("y"))


def max_pool(pixels: DataFrame, k: int = 4) -> DataFrame:
    """Masks of k x k pixels: 255 where any is covered, rows from the south."""
    t = pixels.groupBy(F.floor(F.col("y") / k).alias("my"), F.floor(F.col("x") / k).alias("mx"))
    return t.agg(F.when(F.bool_or("have"), 255).otherwise(0).alias("mask"))


def coverage(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """none, tile or tile+mask of each tile."""
    t = tiles.groupBy(*keys).agg(F.bool_or("have").alias("any"), F.bool_and("have").alias("all"))
    return t.select(*keys, F.when(~F.col("any"), "none").when(F.col("all"), "tile").otherwise("tile+mask").alias("kind"))


def first_source(pixels: DataFrame, keys: list[str], black_is_missing: bool = False) -> DataFrame:
    """Of several sources' pixels at a place the first by priority that is covered."""
    ok = F.col("have")
    if black_is_missing:
        ok &= ~((F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0))
    return pixels.where(ok).groupBy(*keys).agg(F.min_by(F.struct("r", "g", "b"), "priority").alias("c"), F.min("priority").alias("priority")).select(*keys, "c.*", "priority")


def water_apply(pixels: DataFrame, scale: Column, offset: Column) -> DataFrame:
    out = pixels
    for c in "rgb":
        out = out.withColumn(c, corrected(c, scale, offset))
    return out


def no_imagery(pixels: DataFrame, grow: int) -> DataFrame:
    """Black pixels, grown by a square."""
    from tilewright.operators.raster import dilate

    return dilate(pixels.withColumn("hole", is_black("r", "g", "b")), "hole", grow)


def fill_layers(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Each pixel from the first layer (by `up`) that has it; none if all are holes."""
    return layers.groupBy(*keys).agg(F.min_by(F.struct("r", "g", "b", "up"), F.when(~F.col("hole"), F.col("up"))).alias("c")).select(*keys, "c.*")


def mosaic_reduce(pixels: DataFrame, k: int = 16) -> DataFrame:
    t = pixels.groupBy(F.floor(F.col("y") / k).alias("my"), F.floor(F.col("x") / k).alias("mx"))
    return t.agg(*[F.avg(c).alias(c) for c in "rgb"], F.avg(F.col("have").cast("int")).alias("share"))


def sampled(centres: DataFrame, source: DataFrame, col_: Column, row: Column, width: int, height: int) -> DataFrame:
    """Nearest lookup: an equi-join on the computed column and row, where they lie inside."""
    t = centres.withColumn("_c", F.floor(col_)).withColumn("_r", F.floor(row))
    t = t.where((F.col("_c") >= 0) & (F.col("_c") < width) & (F.col("_r") >= 0) & (F.col("_r") < height))
    s = source.select(F.col("x").alias("_c"), F.col("y").alias("_r"), "r", "g", "b", "have")
    return t.join(s, ["_c", "_r"]).drop("_c", "_r")


def pixel_hash(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of a tile's pixels in row order. A tile is of bounded size, so its pixels may meet."""
    line = F.format_string("%d,%d,%d;", "r", "g", "b")
    t = pixels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x", line.alias("v")))).alias("px"))
    return t.select(*keys, F.sha2(F.array_join(F.transform("px", lambda p: p["v"]), ""), 256).alias("sha"))


def components(pixels: DataFrame, mask: str) -> DataFrame:
    """4-connected labels: runs of rows are nodes, touching runs of neighbouring rows edges, labels the least node.

    Labels spread along edges and by pointer jumping (a run takes the label of the run that its label
    names) until nothing changes.
    """
    from tilewright.operators.raster import runs

    r = runs(pixels, mask).withColumn("id", F.shiftleft(F.col("y").cast("long"), 32) + F.col("x0")).checkpoint()
    a, b = r.alias("a"), r.alias("b")
    e = a.join(b, (F.col("a.y") + 1 == F.col("b.y")) & (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1"))).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).checkpoint()
    labels = r.select("id", F.col("id").alias("label")).checkpoint()
    before = None
    while True:
        near = e.join(labels, e["v"] == labels["id"]).groupBy("u").agg(F.min("label").alias("m"))
        labels = labels.join(near, labels["id"] == near["u"], "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("m"))
        labels = labels.join(up, "label").select("id", F.least("label", "m").alias("label")).checkpoint()
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]  # labels only fall
        if total == before:
            return r.join(labels, "id").select("y", "x0", "x1", "label")
        before = total
