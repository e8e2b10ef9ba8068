"""The sampler against a version that goes pixel by pixel."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import colour, grid
from tilewright.operators import convert, texel_field
from tilewright.plans import fields as plans

LEVEL, N = 13, 16


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    tiles, coast, lakes = plans.job_fields(spark, sf_dir)
    images = plans.source_images(spark, sf_dir).orderBy("priority").collect()
    water = plans.water_fields(spark, sf_dir).collect()
    return tiles, coast, lakes, images, water


def looked_up(spark, field, places):
    """Values of a field at (fx, fy, id, lon, lat)."""
    frame = spark.createDataFrame(places, "fx long, fy long, id long, lon double, lat double")
    return {r["id"]: r["km"] for r in texel_field.at_points(frame, field, ["fx", "fy"]).collect()}


def factors_at(f, lon, lat):
    a = np.frombuffer(f["factors"], "<f4").reshape(8, 8, 4)
    x = min(max((lon - f["w"]) / (f["e"] - f["w"]) * 8 - 0.5, 0), 7)
    y = min(max((lat - f["n"]) / (f["s"] - f["n"]) * 8 - 0.5, 0), 7)
    i, j = min(int(x), 6), min(int(y), 6)
    u, v = np.float32(x - i), np.float32(y - j)
    top, bottom = a[j, i] + (a[j, i + 1] - a[j, i]) * u, a[j + 1, i] + (a[j + 1, i + 1] - a[j + 1, i]) * u
    return top + (bottom - top) * v


def test_pixel_by_pixel(spark, parts):
    tiles, coast, lakes, images, water = parts
    # a test's sample of the tiles that an image touches
    chosen = [t for t in tiles.orderBy(F.xxhash64("tx", "ty")).collect() if any(im["x"] < t["e"] and t["w"] < im["x"] + 0.1 and im["y"] - 0.2 < t["n"] and t["s"] < im["y"] for im in images)][:45]
    frame = spark.createDataFrame(chosen, tiles.schema)
    one = spark.createDataFrame(water[:1], "w double, e double, s double, n double, size int, factors binary")
    cut = convert.image_blocks(spark.createDataFrame(images, "priority long, rgb binary, height int, width int, x double, y double, step_x double, step_y double"), side=16)
    got = {(r["tx"], r["ty"]): r for r in convert.sampled(frame, LEVEL, cut, N, False, coast, lakes, one, 5.556, True).collect()}
    tone, merc = colour.curve(), lambda y: math.log(math.tan(math.pi / 4 + y * math.pi / 360))
    places = []
    for t, tile in enumerate(chosen):
        for j in range(N):
            lat = 180 / grid.K * math.atan(grid.K * (2 * (tile["ty"] + 1 - (j + 0.5) / N) / 2**LEVEL - 1))
            for i in range(N):
                places.append((tile["tx"] >> 4, tile["ty"] >> 4, (t * N + j) * N + i, (2 * (tile["tx"] + (i + 0.5) / N) / 2**LEVEL - 1) * 180, lat))
    sea, lake = looked_up(spark, coast, places), looked_up(spark, lakes, places)
    f, seen = water[0], 0
    for t, tile in enumerate(chosen):
        touched = f["w"] < tile["e"] and tile["w"] < f["e"] and f["s"] < tile["n"] and tile["s"] < f["n"]
        rgb, have = np.zeros((N, N, 3), int), np.zeros((N, N), bool)
        for j in range(N):
            for i in range(N):
                k = (t * N + j) * N + i
                _, _, _, lon, lat = places[k]
                if sea[k] > 5.556 or lake[k] <= 0:
                    continue
                for im in images:
                    c = math.floor((lon - im["x"]) / im["step_x"])
                    r = math.floor((merc(lat) - merc(im["y"])) * 32 / (merc(im["y"] + 32 * im["step_y"]) - merc(im["y"])))
                    if 0 <= c < 32 and 0 <= r < 32:
                        px = np.frombuffer(im["rgb"], np.uint8).reshape(32, 32, 3)[r, c]
                        if px.any():
                            if touched:
                                q = factors_at(f, lon, lat)
                                px = [int(min(max(math.floor(np.float32(p) * q[0] + q[1 + n] + np.float32(0.5)), 0), 255)) for n, p in enumerate(px)]
                            rgb[j, i], have[j, i] = [tone[int(p)] for p in px], True
                            break
        at = tile["tx"], tile["ty"]
        assert (at in got) == bool(have.any()), at
        if at in got:
            seen += 1
            assert (np.frombuffer(got[at]["covered"], np.uint8).reshape(N, N) > 0).tolist() == have.tolist()
            far = np.abs(np.frombuffer(got[at]["rgb"], np.uint8).reshape(N, N, 3).astype(int) - rgb)
            assert far.max() <= 4 and (far > 0).mean() < 0.001  # a rounding of single precision, through the curve
    assert 20 < seen < 45


def test_tiles_past_the_cut_meet_no_block(spark, parts):
    tiles, coast, lakes, images, _ = parts
    kept = convert.verdicts(tiles, LEVEL, coast, lakes, 1.0)
    assert 0 < kept.count() < tiles.count()
    assert 0 < kept.where("cut_coast").count() < kept.count() and kept.where("cut_lakes").count() > 0
    cut = convert.image_blocks(spark.createDataFrame(images, "priority long, rgb binary, height int, width int, x double, y double, step_x double, step_y double"), side=16)
    plan = convert.sampled(tiles, LEVEL, cut, N, False, coast, lakes, None, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    # the ranges under the field are joined to tiles below the join with image blocks
    below = plan[plan.index("step_x") :]
    assert "least" in below


def test_without_lines_all_is_sampled(spark, parts):
    tiles, _, _, images, _ = parts
    cut = convert.image_blocks(spark.createDataFrame(images, "priority long, rgb binary, height int, width int, x double, y double, step_x double, step_y double"), side=16)
    rows = convert.sampled(tiles, LEVEL, cut, N).collect()
    assert rows and all(len(r["rgb"]) == N * N * 3 for r in rows)


def test_many_images_over_each_other_are_composed_before_the_shuffle(spark, monkeypatch):
    """Two hundred images at two places, mostly black: as with all their blocks in one group, and few rows are brought together."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(200):
        a = rng.integers(1, 255, (32, 32, 3)).astype(np.uint8)
        a[rng.random((32, 32)) < 0.97] = 0
        rows.append((k * 7 % 200, a.tobytes(), 32, 32, -71.5 + k % 2 * 0.03, -32.5, 0.1 / 32, -0.2 / 32))
    images = spark.createDataFrame(rows, "priority long, rgb binary, height int, width int, x double, y double, step_x double, step_y double")
    cut = convert.image_blocks(images, side=16).cache()
    tx, ty = (spark.range(1).select(f(F.lit(v), LEVEL).alias("t")).first()["t"] for f, v in ((grid.tile_x, -71.45), (grid.tile_y, -32.55)))
    tiles = spark.createDataFrame([(tx, ty)], "tx long, ty long")
    tiles = tiles.select("tx", "ty", *[c.alias(k) for k, c in grid.square_edges("tx", "ty", LEVEL).items()])
    get = lambda: [tuple(r) for r in convert.sampled(tiles, LEVEL, cut, N, black_is_missing=True).collect()]
    composed = convert.sampled(tiles, LEVEL, cut, N, black_is_missing=True)
    assert "thinned" in composed._jdf.queryExecution().optimizedPlan().toString()
    got = get()
    monkeypatch.setattr(convert, "THIN", 0)
    assert got == get() and len(got) == 1
    # pixel by pixel
    e = {k: v for k, v in tiles.first().asDict().items()}
    rgb, have = np.frombuffer(got[0][3], np.uint8).reshape(N, N, 3), np.frombuffer(got[0][4], np.uint8).reshape(N, N)
    tone, by = np.array(colour.curve(), np.uint8), sorted(rows)
    for i in range(0, N, 5):
        lat = 180 / grid.K * math.atan(grid.K * (2 * (ty + 1 - (i + 0.5) / N) / 2**LEVEL - 1))
        for j in range(0, N, 5):
            lon, want = e["w"] + (e["e"] - e["w"]) * (j + 0.5) / N, None
            for _, data, _, _, x, y, step_x, step_y in by:
                c, r = math.floor((lon - x) / step_x), math.floor(convert._row_of(lat, y, step_y, 32, False))
                p = np.frombuffer(data, np.uint8).reshape(32, 32, 3)[r, c] if 0 <= c < 32 and 0 <= r < 32 else np.zeros(3, np.uint8)
                if p.any():
                    want = tone[p]
                    break
            assert bool(have[i, j]) == (want is not None) and (want is None or (rgb[i, j] == want).all())
