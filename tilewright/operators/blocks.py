"""Rasters at the block tier: one row per tile, pixels as bytes; numpy kernels in Arrow batches.

Tiles are (level, tx, ty, rgb, covered) with n x n pixels, row 0 in the north. A kernel sees whole
tiles, four of them for a parent, and never more; a pyramid is a chain of shuffles on the parent's
key, so any number of tiles passes through.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = "level long, tx long, ty long, rgb binary, covered binary"


def halve(rgb: np.ndarray) -> np.ndarray:
    """2 x 2 box in integers; an odd last row or column is left out, a single one kept."""
    h, w = rgb.shape[0] // 2 * 2 or 1, rgb.shape[1] // 2 * 2 or 1
    a = rgb[:h, :w].astype(np.uint16)
    if h == 1 or w == 1:
        return a.astype(np.uint8) if h == w == 1 else ((a[:, ::2] + a[:, 1::2] + 1) // 2 if h == 1 else (a[::2] + a[1::2] + 1) // 2).astype(np.uint8)
    return ((a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2] + 2) // 4).astype(np.uint8)


def halve_covered(have: np.ndarray) -> np.ndarray:
    a = have.astype(np.uint8)
    return a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2] >= 2


BC1 = np.dtype([("c0", "<u2"), ("c1", "<u2"), ("bits", "<u4")])
#: Parts, in thirds, of the two ends in each of a block's four colours. Fixed values of the format.
THIRDS = ((3, 0), (0, 3), (2, 1), (1, 2))


def _lanes(rgb: np.ndarray) -> list[np.ndarray]:
    """A block's 16 texels in order, each as an image of that texel of all blocks."""
    return [rgb[k // 4 :: 4, k % 4 :: 4].astype(np.int32) for k in range(16)]


def _colours(c0: np.ndarray, c1: np.ndarray) -> list[np.ndarray]:
    """The four colours of blocks whose ends are given in 5, 6 and 5 bits."""
    ends = []
    for c in (c0.astype(np.int32), c1.astype(np.int32)):
        red, green, blue = c >> 11, (c >> 5) & 63, c & 31
        ends.append(np.stack([red * 8 + red // 4, green * 4 + green // 16, blue * 8 + blue // 4], -1))
    return [(a * ends[0] + b * ends[1]) // 3 for a, b in THIRDS]


def encode_bc1(rgb: np.ndarray) -> bytes:
    """4 x 4 blocks: two 565 ends, the larger first, and 16 two-bit indices; edges are repeated."""
    tall, wide = -rgb.shape[0] % 4, -rgb.shape[1] % 4
    lanes = _lanes(np.pad(rgb, ((0, tall), (0, wide), (0, 0)), mode="edge"))
    out = np.zeros(lanes[0].shape[:2], BC1)
    ends = []
    for bound in (np.maximum, np.minimum):
        e = lanes[0]
        for lane in lanes[1:]:
            e = bound(e, lane)
        ends.append((e[..., 0] // 8) * 2048 + (e[..., 1] // 4) * 32 + e[..., 2] // 8)
    out["c0"], out["c1"] = np.maximum(*ends), np.minimum(*ends)
    colours = _colours(out["c0"], out["c1"])
    for k, lane in enumerate(lanes):
        index, nearest = np.zeros(lane.shape[:2], np.uint32), None
        for i, colour in enumerate(colours):
            far = np.square(lane - colour).sum(-1)
            if nearest is None:
                nearest = far
            else:
                index[far < nearest] = i
                nearest = np.minimum(nearest, far)
        out["bits"] |= index << np.uint32(2 * k)
    return out.tobytes()


def decode_bc1(data: bytes, h: int, w: int) -> np.ndarray:
    blocks = np.frombuffer(data, BC1).reshape(-(-h // 4), -(-w // 4))
    colours = _colours(blocks["c0"], blocks["c1"])
    out = np.empty((4 * blocks.shape[0], 4 * blocks.shape[1], 3), np.uint8)
    for k in range(16):
        index = (blocks["bits"] >> np.uint32(2 * k)) & 3
        for i, colour in enumerate(colours):
            at = index == i
            out[k // 4 :: 4, k % 4 :: 4][at] = colour[at]
    return out[:h, :w]


def mip_chain(rgb: np.ndarray) -> bytes:
    """All levels, each encoded, down to one pixel."""
    out = [encode_bc1(rgb)]
    while max(rgb.shape[:2]) > 1:
        rgb = halve(rgb)
        out.append(encode_bc1(rgb))
    return b"".join(out)


def mask_chain(mask: np.ndarray) -> bytes:
    """All levels of an 8-bit mask: a texel is the largest of the four below it."""
    out = [mask.tobytes()]
    while max(mask.shape) > 1:
        mask = np.maximum.reduce([mask[y::2, x::2] for y in (0, 1) for x in (0, 1)])
        out.append(mask.tobytes())
    return b"".join(out)


def parents(tiles: DataFrame, n: int) -> DataFrame:
    """Parents of tiles of n x n pixels: children halved into their quadrants."""

    def run(key, pdf):
        import pandas as pd

        rgb, have = np.zeros((n, n, 3), np.uint8), np.zeros((n, n), bool)
        for r in pdf.itertuples():
            x, y = (r.tx & 1) * n // 2, (1 - (r.ty & 1)) * n // 2  # the odd row is the northern one
            rgb[y : y + n // 2, x : x + n // 2] = halve(np.frombuffer(r.rgb, np.uint8).reshape(n, n, 3))
            have[y : y + n // 2, x : x + n // 2] = halve_covered(np.frombuffer(r.covered, np.uint8).reshape(n, n) > 0)
        return pd.DataFrame({"level": [key[0]], "tx": [key[1]], "ty": [key[2]], "rgb": [rgb.tobytes()], "covered": [have.astype(np.uint8).tobytes()]})

    keys = [(F.col("level") - 1).alias("pl"), F.shiftright("tx", 1).alias("px"), F.shiftright("ty", 1).alias("py")]
    return tiles.groupBy(*keys).applyInPandas(run, TILE)


def pyramid(tiles: DataFrame, n: int, levels: int) -> DataFrame:
    """Tiles and their ancestors; each level is checkpointed, for the next one reads it."""
    out, now = tiles, tiles
    for _ in range(levels):
        now = parents(now, n).checkpoint()
        out = out.unionByName(now)
    return out


def from_pixels(pixels: DataFrame, n: int) -> DataFrame:
    """Pixel-tier rows with level, tx, ty to blocks; a tile's pixels are bounded by n * n."""
    px = F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b", "have")))

    def run(batches):
        for pdf in batches:
            rgb = [np.array([[p["r"], p["g"], p["b"]] for p in px], np.uint8).tobytes() for px in pdf["px"]]
            have = [np.array([p["have"] for p in px], np.uint8).tobytes() for px in pdf["px"]]
            yield pdf[["level", "tx", "ty"]].assign(rgb=rgb, covered=have)

    return pixels.groupBy("level", "tx", "ty").agg(px.alias("px")).mapInPandas(run, TILE)


def textures(tiles: DataFrame, n: int) -> DataFrame:
    """Container files of tiles: name kind (tile or tile+mask), texture and mask bytes; tiles without coverage make none."""

    def run(batches):
        from tilewright.sources.containers import DXT1, L8, texture_file

        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                have = np.frombuffer(r.covered, np.uint8).reshape(n, n) > 0
                if not have.any():
                    continue
                rgb = np.frombuffer(r.rgb, np.uint8).reshape(n, n, 3)[::-1]  # files have the south first
                mask = None
                if not have.all():
                    pooled = (have.reshape(n // 4, 4, n // 4, 4).any((1, 3)) * np.uint8(255))[::-1]
                    mask = texture_file(mask_chain(pooled), n // 4, L8, r.level)
                rows.append((r.level, r.tx, r.ty, texture_file(mip_chain(rgb), n, DXT1, r.level), mask))
            yield type(pdf)(rows, columns=["level", "tx", "ty", "texture", "mask"])

    return tiles.mapInPandas(run, "level long, tx long, ty long, texture binary, mask binary")


def png(rgb: np.ndarray) -> bytes:
    """An RGB image as PNG."""
    h, w = rgb.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def sharpen(rgb: np.ndarray, amount: float) -> np.ndarray:
    """Adds `amount` hundredths of what a Gaussian of 1.5 pixels takes away. The formula is this engine's own."""
    r = np.arange(-4, 5)
    k = np.exp(-(r**2) / (2 * 1.5**2))
    k /= k.sum()
    a = rgb.astype(np.float32)
    p = np.pad(a, ((4, 4), (4, 4), (0, 0)), mode="edge")
    soft = sum(w * p[i : i + a.shape[0]] for i, w in enumerate(k))
    soft = sum(w * soft[:, i : i + a.shape[1]] for i, w in enumerate(k))
    return np.clip(a + (a - soft) * amount / 100 + 0.5, 0, 255).astype(np.uint8)


def enlarge(rgb: np.ndarray, factor: int) -> np.ndarray:
    """Bilinear enlargement, mirrored at the edges."""
    p = np.pad(rgb.astype(np.float32), ((1, 1), (1, 1), (0, 0)), mode="symmetric")

    def along(a, n):
        at = (np.arange(n * factor) + 0.5) / factor + 0.5
        k = np.floor(at).astype(int)
        t = (at - k)[:, None, None]
        return a[k] * (1 - t) + a[k + 1] * t

    out = along(p, rgb.shape[0])
    return np.clip(along(out.transpose(1, 0, 2), rgb.shape[1]).transpose(1, 0, 2) + 0.5, 0, 255).astype(np.uint8)
