"""Water over squares against one joined raster."""

import numpy as np
import pytest

from tilewright.functions import colour, grid
from tilewright.operators import blocks, labels
from tilewright.operators import water_squares as ws
from tilewright.plans import fields as plans
from tilewright.sources import containers

LEVEL, N = 9, 16


def cut(spark, whole, n=N, x0=100, y0=300, name="wet", skip=()):
    """A joined raster as squares; row 0 is the north."""
    rows = []
    for j in range(whole.shape[0] // n):
        for i in range(whole.shape[1] // n):
            if (i, j) not in skip:
                rows.append((x0 + i, y0 - j, whole[j * n : j * n + n, i * n : i * n + n].tobytes()))
    return spark.createDataFrame(rows, f"tx long, ty long, {name} binary")


def join(rows, shape, kind, column, n=N, x0=100, y0=300):
    out = np.zeros(shape, kind)
    for r in rows:
        i, j = r["tx"] - x0, y0 - r["ty"]
        out[j * n : j * n + n, i * n : i * n + n] = np.frombuffer(r[column], kind).reshape(n, n, *shape[2:])
    return out


def in_order(label):
    """Labels numbered in the order of the numbers they have."""
    names = np.unique(label[label > 0])
    return np.where(label > 0, np.searchsorted(names, label) + 1, 0)


def test_rims_are_exchanged(spark):
    whole = np.random.default_rng(1).integers(0, 256, (3 * N, 4 * N)).astype(np.uint8)
    h = 5
    padded = np.pad(whole, h)
    got = ws.exchanged(cut(spark, whole), {"wet": "u1"}, N, h).collect()
    assert len(got) == 12
    for r in got:
        i, j = r["tx"] - 100, 300 - r["ty"]
        assert (np.frombuffer(r["wet"], "u1").reshape(N + 2 * h, -1) == padded[j * N : j * N + N + 2 * h, i * N : i * N + N + 2 * h]).all()


@pytest.mark.parametrize(("share", "open_by"), [(0.55, 0), (0.62, 0), (0.9, 1), (0.97, 2)])
def test_bodies_are_those_of_the_joined_raster(spark, share, open_by):
    whole = np.random.default_rng(7).random((4 * N, 3 * N)) < share
    got = join(ws.bodies(cut(spark, whole.astype(np.uint8)), "wet", N, LEVEL, open_by).collect(), whole.shape, np.int64, "label")
    want = labels.water_bodies(whole, open_by)
    assert ((got > 0) == whole).all()
    # the same texels have the same body
    pairs = {(a, b) for a, b in zip(got[whole].tolist(), want[whole].tolist(), strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    if not open_by:
        assert (in_order(got) == want).all()


def test_a_body_that_winds_through_all_squares_has_one_label(spark):
    whole = np.zeros((4 * N, 4 * N), np.uint8)
    whole[::4] = 1  # rows, joined at their ends by turns
    for k in range(0, 4 * N - 4, 4):
        whole[k : k + 4, -1 if k // 4 % 2 else 0] = 1
    got = join(ws.bodies(cut(spark, whole), "wet", N, LEVEL, 0).collect(), whole.shape, np.int64, "label")
    assert len(np.unique(got[whole > 0])) == 1


def test_a_missing_square_parts_what_it_would_join(spark):
    whole = np.ones((N, 3 * N), np.uint8)
    got = ws.bodies(cut(spark, whole, skip={(1, 0)}), "wet", N, LEVEL, 1).collect()
    assert len({int(np.frombuffer(r["label"], "<i8").max()) for r in got}) == 2


def test_survey_of_the_query(spark, sf_dir):
    squares = plans.water_squares(spark, sf_dir)
    n, rows = plans.WATER_SIDE, squares.collect()
    high = 300 - min(r["ty"] for r in rows) + 1
    shape = (high * n, 4 * n)
    wet = join(rows, shape, np.uint8, "wet", n, 200) > 0
    own = join(rows, (*shape, 3), np.float32, "own", n, 200)
    want = labels.water_bodies(wet, 1)
    k = 5
    m = ws._box(np.pad(wet.astype(float), k // 2)[..., None], k)
    local = ws._box(np.pad(own * wet[..., None], ((2, 2), (2, 2), (0, 0))), k) / np.maximum(m, 1e-6)
    label, out = ws.survey(squares, n, plans.WATER_LEVEL, k, 1)
    got = join(label.collect(), shape, np.int64, "label", n, 200)
    found = {r["body"]: r for r in out.collect()}
    assert set(found) == set(np.unique(got[wet]).tolist())
    lat = lambda y: 180 / grid.K * np.arctan(grid.K * (2 * y / 2**9 - 1))
    assert len(found) == want.max() > 3
    for body, r in found.items():
        at = got == body
        assert (want[at] == want[at][0]).all() and r["texels"] == at.sum()
        assert r["squares"] == len({(y // n, x // n) for y, x in np.argwhere(at).tolist()})
        area = 0.0
        for y, x in np.argwhere(at).tolist():
            north, south = lat(301 - y // n), lat(300 - y // n)
            area += (north - south) * 111.32 / n * 360 / 2**9 / n * 111.32 * np.cos(np.radians(north + (south - north) * (y % n + 0.5) / n))
        assert r["km2"] == pytest.approx(area)
        for c, name in enumerate("rgb"):
            values = np.sort(local[at][:, c])
            # the first value that more than the share of them reach
            assert r[name] == pytest.approx(values[int(np.floor(0.15 * len(values)))], abs=2 / ws.STEPS)
        assert r["water"] == (r["b"] - r["r"] >= 15)


def test_textures_are_read_back(spark):
    n, w = 32, 64
    y, x = np.mgrid[0:w, 0:w]
    rgb = np.stack([20 + x, 30 + y, 60 + (x + y) // 2], -1).astype(np.uint8)
    rgb[:8, :8] = 0
    tone = np.array(colour.curve(), np.uint8)
    built = np.where(rgb.any(2)[..., None], tone[rgb], 0).astype(np.uint8)
    texture = containers.texture_file(blocks.mip_chain(built[::-1]), w, containers.DXT1, 9)
    got = ws.assembled(spark.createDataFrame([(140, 290, bytearray(texture))], "tx long, ty long, texture binary"), n).first()
    own, have = np.frombuffer(got["own"], "<f4").reshape(n, n, 3), np.frombuffer(got["have"], "u1").reshape(n, n)
    lat = lambda v: 180 / grid.K * np.arctan(grid.K * (2 * v / 2**9 - 1))
    lats = lat(291) + (lat(290) - lat(291)) * (np.arange(n) + 0.5) / n
    rows = ((291 - (np.tan(lats * grid.K / 180) / grid.K + 1) / 2 * 2**9) * w).astype(int)
    want = rgb[rows][:, np.arange(n) * 2 + 1]
    assert (have[:4, :4] == 0).all() and have[5:, 5:].all()
    assert np.abs(own - want)[have > 0].mean() < 4 and np.abs(own - want)[have > 0].max() < 20


def test_reference_is_looked_up_by_key(spark):
    n, zoom, side = 16, 9, 8
    rng = np.random.default_rng(5)
    squares = [(140, 290), (141, 290)]
    size = 2**zoom * side
    lat = lambda v: 180 / grid.K * np.arctan(grid.K * (2 * v / 2**9 - 1))
    want, keys = {}, {}
    for tx, ty in squares:
        for j in range(n):
            for i in range(n):
                lon = ((tx + (i + 0.5) / n) / 2**9 * 2 - 1) * 180
                la = lat(ty + 1) + (lat(ty) - lat(ty + 1)) * (j + 0.5) / n
                px, py = (lon + 180) / 360 * size, (0.5 - np.log(np.tan(np.pi / 4 + np.radians(la) / 2)) / (2 * np.pi)) * size
                key = int(px // side), int(py // side)
                tile = keys.setdefault(key, rng.integers(1, 256, (side, side, 3)).astype(np.uint8))
                want[tx, ty, j, i] = key, tile[int(py % side), int(px % side)]
    lost = sorted(keys)[1]
    tiles = spark.createDataFrame([(*k, bytearray(v.tobytes())) for k, v in keys.items() if k != lost] + [(0, 0, bytearray(side * side * 3))], "x long, y long, rgb binary")
    got = ws.referenced(spark.createDataFrame([*squares, (300, 200)], "tx long, ty long"), tiles, n, zoom, 9, side).collect()
    assert len(got) == 3
    for r in got:
        ref, ok = np.frombuffer(r["ref"], "u1").reshape(n, n, 3), np.frombuffer(r["got"], "u1").reshape(n, n)
        for (tx, ty, j, i), (key, px) in want.items():
            if (tx, ty) == (r["tx"], r["ty"]):
                assert bool(ok[j, i]) == (key != lost)
                assert key == lost or (ref[j, i] == px).all()
    assert not any(np.frombuffer(r["got"], "u1").any() for r in got if r["tx"] == 300)
