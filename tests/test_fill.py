"""Filling from lower zooms against a tile by tile version; the sea from map tiles against single lookups."""

import math

import numpy as np

from tilewright.functions import colour, grid
from tilewright.operators import blocks, convert, fill
from tilewright.plans import fields as plans

SIDE, ZOOM = plans.FILL_SIDE, plans.FILL_ZOOM


def tile_by_tile(wanted, tiles, most=fill.MOST_UP):
    """wanted: square -> [(x, y)]; tiles: (zoom, x, y) -> image."""
    out = {}

    def black(a):
        return (a <= 4).all(-1)

    def about(mask, r):
        return np.array([[mask[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].any() for x in range(mask.shape[1])] for y in range(mask.shape[0])])

    for square, keys in wanted.items():
        counts = {}
        for up in range(1, most + 1):
            n = 0
            for x, y in keys:
                p = tiles.get((ZOOM - up, x >> up, y >> up))
                n += p is not None and black(fill.part(p, x, y, up)).mean() < 0.01
            counts[up] = n
            if n >= 0.98 * len(keys):
                start = up
                break
        else:
            start = max(counts, key=lambda u: (counts[u], -u))
        for x, y in keys:
            image = hole = first = None
            for up in range(start, most + 1):
                p = tiles.get((ZOOM - up, x >> up, y >> up))
                if p is None:
                    continue
                size = SIDE >> up
                cut = p[(y % 2**up) * SIDE // 2**up :][: max(1, size), (x % 2**up) * SIDE // 2**up :][:, : max(1, size)]
                layer = blocks.enlarge(cut, SIDE // max(1, size))
                gone = about(black(layer), 2 << up)
                if image is None:
                    image, hole, first = layer, gone, up
                else:
                    image, hole = np.where((hole & ~gone)[..., None], layer, image), hole & gone
                if not hole.any():
                    break
            if image is not None:
                out[square, x, y] = first, int(hole.sum()), image
    return out


def test_the_query_tile_by_tile(spark, sf_dir):
    wanted, tiles = plans.fill_wanted(spark, sf_dir), plans.fill_tiles(spark, sf_dir)
    groups = {}
    for r in wanted.collect():
        groups.setdefault(r["square"], []).append((r["x"], r["y"]))
    images = {(r["zoom"], r["x"], r["y"]): np.frombuffer(r["rgb"], np.uint8).reshape(SIDE, SIDE, 3) for r in tiles.collect()}
    want = tile_by_tile(groups, images)
    got = {(r["square"], r["x"], r["y"]): r for r in fill.fill(wanted, tiles, ZOOM, SIDE).collect()}
    assert set(got) == set(want)
    assert len({r["up"] for r in got.values()}) > 1 and any(r["holes"] for r in got.values())
    for key, (up, left, image) in want.items():
        assert (got[key]["up"], got[key]["holes"]) == (up, left), key
        assert (np.frombuffer(got[key]["rgb"], np.uint8).reshape(SIDE, SIDE, 3) == image).all()


def test_no_tiles_and_none_wanted(spark, sf_dir):
    wanted, tiles = plans.fill_wanted(spark, sf_dir), plans.fill_tiles(spark, sf_dir)
    assert fill.fill(wanted, tiles.limit(0), ZOOM, SIDE).count() == 0
    assert fill.fill(wanted.limit(0), tiles, ZOOM, SIDE).count() == 0


def test_the_sea_comes_last(spark):
    level, tx, ty, n, zoom, side = 11, 620, 820, 32, 12, 16
    lon = lambda x: (2 * x / 2**level - 1) * 180
    lat = lambda y: 180 / grid.K * math.atan(grid.K * (2 * y / 2**level - 1))
    rng = np.random.default_rng(8)
    wanted = spark.createDataFrame([(tx, ty, lon(tx), lon(tx + 1), lat(ty), lat(ty + 1))], "tx long, ty long, w double, e double, s double, n double")
    image = rng.integers(5, 256, (64, 32, 3)).astype(np.uint8)
    image[:20] = 0
    step = (lon(tx + 1) - lon(tx)) / 64  # covers the western half, black in the north
    images = spark.createDataFrame([(bytearray(image.tobytes()), 64, 32, 0, lon(tx), lat(ty + 1), step, (lat(ty) - lat(ty + 1)) / 64)], "rgb binary, height int, width int, priority int, x double, y double, step_x double, step_y double")
    size = 2**zoom
    merc = lambda v: (0.5 - math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) / (2 * math.pi)) * size
    xs = range(int((lon(tx) + 180) / 360 * size), int((lon(tx + 1) + 180) / 360 * size) + 1)
    ys = range(int(merc(lat(ty + 1))), int(merc(lat(ty))) + 1)
    sea = {(x, y): rng.integers(0, 256, (side, side, 3)).astype(np.uint8) for x in xs for y in ys}
    tiles = spark.createDataFrame([(zoom, x, y, bytearray(a.tobytes())) for (x, y), a in sea.items()], "zoom int, x long, y long, rgb binary")
    cut = convert.image_blocks(images).unionByName(fill.mercator_blocks(tiles, side))
    got = convert.sampled(wanted, level, cut, n, black_is_missing=True).first()
    rgb = np.frombuffer(got["rgb"], np.uint8).reshape(n, n, 3)
    tone, far = colour.curve(), 0
    m = lambda v: math.log(math.tan(math.pi / 4 + v * math.pi / 360))
    for j in range(n):
        la = 180 / grid.K * math.atan(grid.K * (2 * (ty + 1 - (j + 0.5) / n) / 2**level - 1))
        row = math.floor((m(la) - m(lat(ty + 1))) * 64 / (m(lat(ty)) - m(lat(ty + 1))))
        for i in range(n):
            lo = (2 * (tx + (i + 0.5) / n) / 2**level - 1) * 180
            px = image[row, i * 2 + 1] if i < 16 else np.zeros(3, int)
            if not px.any():
                a, b = (lo + 180) / 360 * size, merc(la)
                px = sea[int(a), int(b)][int(b % 1 * side), int(a % 1 * side)]
                far += 1
            assert [tone[int(p)] for p in px] == rgb[j, i].tolist() or not px.any(), (i, j)
    assert 500 < far < n * n
