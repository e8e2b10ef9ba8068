"""Tiles without imagery filled from lower zooms, a square from one level as far as that goes.

A lower tile covers its children exactly, so a tile and its ancestor meet by the leading part of the key:
(x >> up, y >> up). Choosing the level is a loop over the levels up, at most MOST_UP of them, that goes on
only with squares that are not decided: an ancestor is joined with the list of its children that ask for
it and tells each one's share of black; a square takes the first level that has imagery for ENOUGH of its
tiles, else the one that has most. Filling is a loop too: tiles of squares whose level is reached take the
enlarged part, and those in which holes are left, and only those, go on to the next level.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import blocks, labels
from tilewright.session import stored

#: Levels that are tried, share of tiles that decides a level, share of black that a tile may have, what is black.
MOST_UP, ENOUGH, BLACK_SHARE, BLACK = 5, 0.98, 0.01, 4


def holes(rgb: np.ndarray, radius: int = 0) -> np.ndarray:
    """Pixels without imagery, and those within a square of the radius about them."""
    black = (rgb <= BLACK).all(-1)
    return labels.widened(black, radius) if radius and black.any() else black


def part(rgb: np.ndarray, x: int, y: int, up: int) -> np.ndarray:
    """What a tile's descendant (x, y), `up` levels deeper, has of it; a pixel at least."""
    side = len(rgb)
    a, b = ((k & ((1 << up) - 1)) * side >> up for k in (x, y))
    size = max(1, side >> up)
    return rgb[b : b + size, a : a + size]


def _asked(wanted: DataFrame, tiles: DataFrame, zoom: int, up: int) -> DataFrame:
    """Ancestors with the list (tx, ty, square) of those that ask for them: at most 4^up."""
    child = F.struct("square", F.col("x").alias("tx"), F.col("y").alias("ty"))
    asked = wanted.groupBy(F.shiftright("x", up).alias("x"), F.shiftright("y", up).alias("y")).agg(F.collect_list(child).alias("children"))
    return asked.join(tiles.where(F.col("zoom") == zoom - up).select("x", "y", "rgb"), ["x", "y"])


def levels(wanted: DataFrame, tiles: DataFrame, zoom: int, side: int, most_up: int = MOST_UP) -> DataFrame:
    """The level up (square, up) that each square of wanted tiles (square, x, y of the zoom) is filled from. tiles: zoom, x, y, rgb."""
    need = stored(wanted.groupBy("square").agg(F.count(F.lit(1)).alias("n")), "fill-squares")
    open_, decided, counted = need, None, None
    for up in range(1, min(most_up, zoom - 1) + 1):

        def shares(batches, up=up):
            for pdf in batches:
                out = []
                for rgb, children in zip(pdf["rgb"], pdf["children"], strict=True):
                    a = np.frombuffer(rgb, np.uint8).reshape(side, side, 3)
                    out += [(c["square"], float(holes(part(a, c["tx"], c["ty"], up)).mean())) for c in children]
                yield type(pdf)(out, columns=["square", "share"])

        left = wanted.join(open_.select("square"), "square", "left_semi")
        share = _asked(left, tiles, zoom, up).mapInPandas(shares, f"square {dict(wanted.dtypes)['square']}, share double")
        have = share.where(F.col("share") < BLACK_SHARE).groupBy("square").agg(F.count(F.lit(1)).alias("have"))
        now = open_.join(have, "square", "left").select("square", "n", F.coalesce("have", F.lit(0)).alias("have"), F.lit(up).alias("up"))
        now = stored(now, "fill-counts")
        counted = now if counted is None else counted.unionByName(now)
        first = now.where(F.col("have") >= ENOUGH * F.col("n")).select("square", "up")
        decided = first if decided is None else decided.unionByName(first)
        open_ = now.join(first.select("square"), "square", "left_anti").select("square", "n")
        if not open_.limit(1).count():
            break
    best = counted.groupBy("square").agg(F.max_by("up", F.struct("have", -F.col("up"))).alias("best"))
    return best.join(decided.groupBy("square").agg(F.min("up").alias("up")), "square", "left").select("square", F.coalesce("up", "best").alias("up"))


FILLED = "x long, y long, rgb binary, up int, holes long"


def fill(wanted: DataFrame, tiles: DataFrame, zoom: int, side: int, most_up: int = MOST_UP) -> DataFrame:
    """Wanted tiles (square, x, y) that some level has imagery for: square and FILLED.

    up is the level that a tile was first filled from, holes what no level had. A tile without any ancestor
    is left out.
    """
    most = min(most_up, zoom - 1)
    kind = dict(wanted.dtypes)["square"]
    wanted = stored(wanted.select("square", F.col("x").cast("long"), F.col("y").cast("long")), "fill-wanted")
    start = stored(levels(wanted, tiles, zoom, side, most_up).withColumnRenamed("up", "start"), "fill-levels")
    state = wanted.join(start, "square").selectExpr("square", "x", "y", "start", "CAST(NULL AS BINARY) AS rgb", "CAST(NULL AS BINARY) AS hole", "0 AS up")
    done = None
    for up in range(1, most + 1):

        def layer(batches, up=up):
            for pdf in batches:
                out = []
                for r in pdf.itertuples():
                    rgb, hole, first = r.rgb, r.hole, r.up
                    if r.ancestor is not None:
                        new = blocks.enlarge(part(np.frombuffer(r.ancestor, np.uint8).reshape(side, side, 3), r.x, r.y, up), max(1, side // max(1, side >> up)))
                        gone = holes(new, 2 << up)
                        if rgb is not None:
                            old, was = np.frombuffer(rgb, np.uint8).reshape(side, side, 3), np.frombuffer(hole, np.uint8).reshape(side, side) > 0
                            new, gone = np.where((was & ~gone)[..., None], new, old), was & gone
                        rgb, hole, first = new.astype(np.uint8).tobytes(), gone.astype(np.uint8).tobytes(), first or up
                    out.append((r.square, r.x, r.y, r.start, rgb, hole, first))
                yield type(pdf)(out, columns=["square", "x", "y", "start", "rgb", "hole", "up"])

        ready = state.where(F.col("start") <= up)
        above = tiles.where(F.col("zoom") == zoom - up).select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("rgb").alias("ancestor"))
        met = ready.withColumns({"px": F.shiftright("x", up), "py": F.shiftright("y", up)}).join(above, ["px", "py"], "left")
        now = stored(met.mapInPandas(layer, f"square {kind}, x long, y long, start int, rgb binary, hole binary, up int"), "fill-layer")
        whole = F.col("hole").isNotNull() & (F.locate("1", F.hex("hole")) == 0)
        ended = now if up == most else now.where(whole)
        done = ended if done is None else done.unionByName(ended)
        if up < most:
            state = state.where(F.col("start") > up).unionByName(now.where(~whole))
            if not state.limit(1).count():
                break
    out = done.where("rgb is not null")
    return out.select("square", "x", "y", "rgb", "up", F.length(F.replace(F.hex("hole"), F.lit("0"), F.lit(""))).cast("long").alias("holes"))


def mercator_blocks(tiles: DataFrame, side: int = 256, priority: int = 1 << 40) -> DataFrame:
    """Map tiles (zoom, x, y, rgb) as image blocks of operators.convert: what no image has is looked up in them, last of all.

    A tile's rows are Mercator rows between its edges, as convert reads those of an image that is not linear.
    """
    size = F.pow(F.lit(2.0), F.col("zoom"))
    lon = lambda x: x / size * 360 - 180
    lat = lambda y: F.degrees(F.atan(F.sinh(F.lit(np.pi) * (1 - 2 * y / size))))
    t = tiles.select(lon(F.col("x")).alias("w"), lon(F.col("x") + 1).alias("e"), lat(F.col("y") + 1).alias("s"), lat(F.col("y")).alias("n"), "rgb")
    zero, pixels = F.lit(0).cast("long"), F.lit(side).cast("long")
    return t.select(
        F.lit(priority).cast("long").alias("priority"), F.col("w").alias("x"), F.col("n").alias("y"), ((F.col("e") - F.col("w")) / side).alias("step_x"), ((F.col("s") - F.col("n")) / side).alias("step_y"),
        pixels.alias("height"), zero.alias("row"), zero.alias("col"), pixels.alias("rows"), pixels.alias("cols"), "rgb", "w", "e", "s", "n",
    )
