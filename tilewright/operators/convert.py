"""Conversion: georeferenced images and a job's regions to texture files.

Images are cut into blocks, so that a tile is sent only the blocks that it overlaps; an image itself is a
row while it is cut, as Spark's image source gives it whole. Tiles and blocks meet by cells of their
boxes; each tile of the deepest level is sampled from its blocks in one task, coarser levels are halved
from it, one shuffle on the parent's key each. Blocks that meet a small tile are composed where they meet it,
as far as that makes them fewer bytes: however many images lie over each other, a tile gets a few pictures.

Where there is a coast or lakes, stored fields (operators.texel_field) decide about a tile before it
meets any block: past the margin or wholly in a lake it is none, and goes; on one side of all lines it is
sampled as without them; only a tile that a line crosses brings the field's blocks and is cut by pixel.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import colour, grid
from tilewright.operators import blocks, lines, rangejoin, texel_field, tiles
from tilewright.session import stored

BLOCK = "priority long, x double, y double, step_x double, step_y double, height long, row long, col long, rows long, cols long, rgb binary, w double, e double, s double, n double"


#: No source; bytes of a tile's composed pixels up to which blocks are composed before they are brought together.
NONE, THIN = np.iinfo(np.int64).max, 1 << 20


def _mercator(lat):
    return np.log(np.tan(np.pi / 4 + np.asarray(lat, float) * np.pi / 360))


def _row_of(lat, y: float, step_y: float, height: int, linear: bool):
    """Fractional rows of an image for latitudes."""
    if linear:
        return (np.asarray(lat) - y) / step_y
    top = _mercator(y)
    return (_mercator(lat) - top) * height / (_mercator(y + height * step_y) - top)


def _lat_of(row: float, y: float, step_y: float, height: int, linear: bool) -> float:
    if linear:
        return y + row * step_y
    top = float(_mercator(y))
    at = top + row / height * (float(_mercator(y + height * step_y)) - top)
    return math.degrees(2 * math.atan(math.exp(at)) - math.pi / 2)


def image_blocks(images: DataFrame, side: int = 256, linear: bool = False) -> DataFrame:
    """Images (rgb, height, width; priority; x, y, step_x, step_y of the upper left corner) to blocks with their boxes."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                a, out = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3), []
                for row in range(0, r.height, side):
                    for col in range(0, r.width, side):
                        part = a[row : row + side, col : col + side]
                        lats = [_lat_of(k, r.y, r.step_y, r.height, linear) for k in (row, row + part.shape[0])]
                        lons = [r.x + k * r.step_x for k in (col, col + part.shape[1])]
                        out.append((r.priority, r.x, r.y, r.step_x, r.step_y, r.height, row, col, *part.shape[:2], part.tobytes(), min(lons), max(lons), min(lats), max(lats)))
                yield pd.DataFrame(out, columns=[f.split()[0] for f in BLOCK.split(", ")])

    columns = ["priority", "x", "y", "step_x", "step_y", "height", "width", "rgb"]
    return images.select(*columns).mapInPandas(run, BLOCK)


def wanted_tiles(regions: DataFrame, level: int) -> DataFrame:
    """The tiles of `level` under all tiles that regions (level, w, e, s, n) ask for: tx, ty and their edges."""
    asked = tiles.grid_tiles(regions.select("level", "w", "e", "s", "n"), F.col("level"))
    span = F.pow(F.lit(2.0), F.lit(level) - F.col("level")).cast("long")
    under = lambda c: F.explode(F.sequence(F.col(c) * F.col("_span"), (F.col(c) + 1) * F.col("_span") - 1)).alias(c)
    t = asked.select("tx", "ty", span.alias("_span")).distinct()
    t = t.select(under("tx"), "ty", "_span").select("tx", under("ty")).distinct()
    return t.select("tx", "ty", *[c.alias(k) for k, c in grid.square_edges("tx", "ty", level).items()])


#: Fields are kept by squares of this level: a field's size is bounded, whatever the job's.
FIELD_LEVEL = 9


def line_field(wanted: DataFrame, level: int, coast: DataFrame | None, ring: DataFrame | None, margin_km: float, texel_km: float = texel_field.TEXEL_KM) -> DataFrame:
    """The stored field (fx, fy, and texel_field.FIELD) of the squares that wanted tiles lie in."""
    up = max(0, level - FIELD_LEVEL)
    squares = wanted.select(F.shiftright("tx", up).alias("fx"), F.shiftright("ty", up).alias("fy")).distinct()
    squares = squares.select("*", *[c.alias(k) for k, c in grid.square_edges("fx", "fy", level - up).items()])
    if ring is not None and "line" not in ring.columns:
        ring = ring.withColumn("line", F.lit(0))
    return stored(texel_field.build(squares, ["fx", "fy"], coast, ring, margin_km, texel_km), "line-field")


def _with_field(wanted: DataFrame, level: int) -> DataFrame:
    up = max(0, level - FIELD_LEVEL)
    return wanted.withColumns({"fx": F.shiftright("tx", up), "fy": F.shiftright("ty", up)})


def verdicts(wanted: DataFrame, level: int, coast: DataFrame | None, lakes: DataFrame | None, margin_km: float = lines.MARGIN_KM) -> DataFrame:
    """wanted (tx, ty, w, e, s, n) that are not wholly cut away, with cut_coast and cut_lakes: whether that line crosses them.

    coast and lakes are stored fields; a lake's margin is 0, and what is inside is cut away.
    """
    out = wanted
    for name, field, margin, land in (("coast", coast, margin_km, True), ("lakes", lakes, 0.0, False)):
        if field is None:
            out = out.withColumn(f"cut_{name}", F.lit(False))
            continue
        ranges = texel_field.under_boxes(_with_field(wanted, level).select("fx", "fy", "tx", "ty", "w", "e", "s", "n"), field, ["fx", "fy"], ["tx", "ty"])
        gone = F.col("least") > margin if land else F.col("most") <= margin
        crossed = F.col("most") > margin if land else F.col("least") <= margin
        out = out.join(ranges.where(~gone).select("tx", "ty", crossed.alias(f"cut_{name}")), ["tx", "ty"])
    return out


def _masks(tiles: DataFrame, level: int, coast: DataFrame | None, lakes: DataFrame | None, water: DataFrame | None) -> DataFrame | None:
    """What tiles need beside image blocks: rows (tx, ty, kind, a grid, its bytes) of field blocks under tiles that a line crosses, and of water fields."""
    parts = []
    columns = ["west", "south", "lon_step", "lat_step", "i0", "j0", "nx", "ny", "width", "height", "field"]
    for kind, field in (("coast", coast), ("lakes", lakes)):
        if field is not None:
            crossed = _with_field(tiles.where(f"cut_{kind}"), level).select("fx", "fy", "tx", "ty", "w", "e", "s", "n")
            parts.append(texel_field.blocks_under(crossed, field, ["fx", "fy"], ["tx", "ty"]).select("tx", "ty", F.lit(kind).alias("kind"), *columns))
    if water is not None:
        # a water field: its box and size, scale and three offsets of each texel, row 0 in the north
        met = rangejoin.box_join(tiles.select("tx", "ty", "w", "e", "s", "n"), water, 360 / 2**FIELD_LEVEL).select("a.tx", "a.ty", *[F.col(f"b.{c}").alias(f"f_{c}") for c in "wesn"], "b.size", "b.factors")
        parts.append(met.select("tx", "ty", F.lit("water").alias("kind"), F.col("f_w").alias("west"), F.col("f_n").alias("south"), ((F.col("f_e") - F.col("f_w")) / F.col("size")).alias("lon_step"), ((F.col("f_s") - F.col("f_n")) / F.col("size")).alias("lat_step"),
                                F.lit(0).cast("long").alias("i0"), F.lit(0).cast("long").alias("j0"), F.col("size").cast("int").alias("nx"), F.col("size").cast("int").alias("ny"), F.col("size").cast("long").alias("width"), F.col("size").cast("long").alias("height"), F.col("factors").alias("field")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _signed(parts: list, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """A field at all pairs of the given latitudes and longitudes, from the blocks that hold it."""
    g = parts[0]
    inside = lambda x, n: np.clip(x, 0, n - 1)
    x, y = inside((lon - g.west) / g.lon_step, g.width), inside((lat - g.south) / g.lat_step, g.height)
    i, j = np.minimum(x.astype(int), g.width - 2), np.minimum(y.astype(int), g.height - 2)
    out = np.full((len(lat), len(lon)), np.nan)
    for b in parts:
        f = np.frombuffer(b.field, "<f4").reshape(b.ny, b.nx).astype(float)
        c, r = np.flatnonzero((i >= b.i0) & (i < b.i0 + b.nx - 1)), np.flatnonzero((j >= b.j0) & (j < b.j0 + b.ny - 1))
        if not len(c) or not len(r):
            continue
        u, v = x[c] - i[c], (y[r] - j[r])[:, None]
        at = lambda dj, di: f[np.ix_(j[r] - b.j0 + dj, i[c] - b.i0 + di)]  # noqa: B023, E731
        lower, upper = at(0, 0) + (at(0, 1) - at(0, 0)) * u, at(1, 0) + (at(1, 1) - at(1, 0)) * u
        out[np.ix_(r, c)] = lower + (upper - lower) * v
    return out


def _factors(b, lon: np.ndarray, lat: np.ndarray) -> np.ndarray | None:
    """Scale and offsets (lat x lon x 4, single precision) of a water field, or None where it changes nothing about these places."""
    f = np.frombuffer(b.field, "<f4").reshape(b.ny, b.nx, 4)
    x, y = (lon - b.west) / b.lon_step - 0.5, (lat - b.south) / b.lat_step - 0.5
    c0, c1 = max(int(np.floor(x.min())) - 1, 0), min(int(np.ceil(x.max())) + 1, b.nx - 1)
    r0, r1 = max(int(np.floor(y.min())) - 1, 0), min(int(np.ceil(y.max())) + 1, b.ny - 1)
    if (f[r0 : r1 + 1, c0 : c1 + 1] == np.array([1, 0, 0, 0], np.float32)).all():
        return None
    x, y = np.clip(x, 0, b.nx - 1), np.clip(y, 0, b.ny - 1)
    i, j = np.minimum(x.astype(int), max(b.nx - 2, 0)), np.minimum(y.astype(int), max(b.ny - 2, 0))
    u, v = (x - i).astype(np.float32)[None, :, None], (y - j).astype(np.float32)[:, None, None]
    right, below = np.minimum(i + 1, b.nx - 1), np.minimum(j + 1, b.ny - 1)
    top = f[np.ix_(j, i)] + (f[np.ix_(j, right)] - f[np.ix_(j, i)]) * u
    bottom = f[np.ix_(below, i)] + (f[np.ix_(below, right)] - f[np.ix_(below, i)]) * u
    return top + (bottom - top) * v


def sampled(
    wanted: DataFrame, level: int, cut: DataFrame, n: int, linear: bool = False, coast: DataFrame | None = None, lakes: DataFrame | None = None, water: DataFrame | None = None,
    margin_km: float = lines.MARGIN_KM, black_is_missing: bool = False,
) -> DataFrame:
    """Tiles of n x n pixels: each the nearest source pixel, of the first image by priority; toned by the curve.

    cut: blocks of images. coast, lakes: stored fields; a pixel farther out at sea than the margin, or in a
    lake, is not covered, and a tile without others is not made. water: fields (w, e, s, n, size, factors) of
    scale and offsets, applied to the source before the curve. black_is_missing: exact black leaves the
    pixel to the next image.
    """
    tone = np.array(colour.curve(), np.uint8)
    columns = [f.split()[0] for f in BLOCK.split(", ")][:11]
    own = [c for c in columns if c not in ("priority", "rgb")]
    thin = n * n * 19 <= THIN

    def places(tx: int, ty: int):
        lon = (2 * (tx + (np.arange(n) + 0.5) / n) / 2**level - 1) * 180
        return lon, 180 / grid.K * np.arctan(grid.K * (2 * (ty + 1 - (np.arange(n) + 0.5) / n) / 2**level - 1))

    def composed(pdf, lon, lat):
        """Of each pixel the first source by priority, then by the block's row and column: its colour, priority (NONE: no source) and block."""
        rgb, best, block = np.zeros((n, n, 3), np.uint8), np.full((n, n), NONE), np.zeros((n, n), np.int64)

        def offer(where, part, priority, of, seen):
            now, held = best[where], block[where]
            take = seen & ((priority < now) | ((priority == now) & (of < held)))
            rgb[where] = np.where(take[..., None], part, rgb[where])
            best[where], block[where] = np.where(take, priority, now), np.where(take, of, held)

        if thin:
            done = pdf["priorities"].notna().to_numpy()
            for r in pdf[done].itertuples():
                priority = np.frombuffer(r.priorities, np.int64).reshape(n, n)
                offer(np.ix_(np.arange(n), np.arange(n)), np.frombuffer(r.rgb, np.uint8).reshape(n, n, 3), priority, np.frombuffer(r.blocks, np.int64).reshape(n, n), priority < NONE)
            pdf = pdf[~done]
        # blocks of one place are looked up together, the first by priority in front
        for (x, y, step_x, step_y, height, row, col, rows, cols), g in pdf.sort_values("priority", kind="stable").groupby(own, sort=False):
            c = np.floor((lon - x) / step_x).astype(int) - col
            r = np.floor(_row_of(lat, y, step_y, height, linear)).astype(int) - row
            i, j = np.flatnonzero((c >= 0) & (c < cols)), np.flatnonzero((r >= 0) & (r < rows))
            if not len(i) or not len(j):
                continue
            some = max(1, (16 << 20) // (rows * cols * 3))  # bounded memory
            for at in range(0, len(g), some):
                part = np.frombuffer(b"".join(g["rgb"].iloc[at : at + some]), np.uint8).reshape(-1, rows, cols, 3)[:, r[j][:, None], c[i]]
                seen = part.any(-1) if black_is_missing else np.ones(part.shape[:3], bool)
                k = seen.argmax(0)
                pick = k, np.arange(len(j))[:, None], np.arange(len(i))
                offer(np.ix_(j, i), part[pick], g["priority"].to_numpy()[at : at + some][k], np.int64(row << 32 | col), seen[pick])
        return rgb, best, block

    def thinned(batches):
        """What of a batch a tile can have, if that is less than the blocks themselves."""
        import pandas as pd

        for pdf in batches:
            pdf = pdf.assign(priorities=None, blocks=None)
            for (tx, ty), g in pdf.groupby(["tx", "ty"], sort=False):
                if g["rgb"].str.len().sum() <= n * n * 19:
                    yield g
                    continue
                rgb, best, block = composed(g, *places(int(tx), int(ty)))
                yield pd.DataFrame([{**{c: 0 for c in own}, "tx": tx, "ty": ty, "priority": 0, "rgb": rgb.tobytes(), "priorities": best.tobytes(), "blocks": block.tobytes()}])[list(pdf.columns)]

    def run(pdf, masks=None):
        import pandas as pd

        if not len(pdf):
            return pd.DataFrame({c.split()[0]: [] for c in blocks.TILE.split(", ")})
        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        lon, lat = places(tx, ty)
        of = {} if masks is None else {kind: list(rows.itertuples()) for kind, rows in masks.groupby("kind")}
        free = np.ones((n, n), bool)
        if "coast" in of:
            free &= _signed(of["coast"], lon, lat) <= margin_km
        if "lakes" in of:
            free &= ~(_signed(of["lakes"], lon, lat) <= 0)
        factors = next((f for f in (_factors(b, lon, lat) for b in of.get("water", [])) if f is not None), None)
        rgb, best, _ = composed(pdf, lon, lat)
        have = free & (best < NONE)
        if masks is not None and not have.any():
            return pd.DataFrame({c.split()[0]: [] for c in blocks.TILE.split(", ")})
        if factors is not None:
            rgb = np.clip(np.floor(rgb * factors[..., :1] + factors[..., 1:] + np.float32(0.5)), 0, 255).astype(np.uint8)
        return pd.DataFrame({"level": [level], "tx": [tx], "ty": [ty], "rgb": [np.where(have[..., None], tone[rgb], 0).astype(np.uint8).tobytes()], "covered": [have.astype(np.uint8).tobytes()]})

    left = verdicts(wanted, level, coast, lakes, margin_km)
    met = rangejoin.box_join(left, cut, 360 / 2**level).select("a.tx", "a.ty", *[f"b.{c}" for c in columns])
    if thin:
        met = met.mapInPandas(thinned, f"tx long, ty long, {', '.join(BLOCK.split(', ')[:11])}, priorities binary, blocks binary")
    masks = _masks(left, level, coast, lakes, water)
    if masks is None:
        return met.groupBy("tx", "ty").applyInPandas(lambda pdf: run(pdf), blocks.TILE)
    masks = masks.select(*[F.col(c).alias(c) for c in masks.columns])  # both sides come from the same tiles
    return met.groupBy("tx", "ty").cogroup(masks.groupBy("tx", "ty")).applyInPandas(run, blocks.TILE)


def convert(
    regions: DataFrame, images: DataFrame, n: int, linear: bool = False, coast: DataFrame | None = None, ring: DataFrame | None = None, margin_km: float = lines.MARGIN_KM,
    lakes: DataFrame | None = None, water: DataFrame | None = None, black_is_missing: bool = False, texel_km: float = texel_field.TEXEL_KM,
) -> DataFrame:
    """Texture files (level, tx, ty, texture, mask) of all levels from a job's deepest to its coarsest.

    coast, ring and lakes are segments; lakes, like rings, have a `line` each.
    """
    least, most = regions.agg(F.min("level"), F.max("level")).first()
    wanted = wanted_tiles(regions, most)
    cut_by = line_field(wanted, most, coast, ring, margin_km, texel_km) if coast is not None or ring is not None else None
    lake_field = line_field(wanted, most, None, lakes, 0.0, texel_km) if lakes is not None else None
    deepest = stored(sampled(wanted, most, image_blocks(images, linear=linear), n, linear, cut_by, lake_field, water, margin_km, black_is_missing), "sampled")
    return blocks.textures(blocks.pyramid(deepest, n, most - least), n)
