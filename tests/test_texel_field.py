"""Stored fields against distances and sides computed one by one."""

import math
import random

import pytest

from tilewright.operators import texel_field as tf

BOX = (-71.85, -71.15, -33.15, -32.25)


def coast(n=150, seed=4):
    """Single-valued in latitude, wiggling about -71.5."""
    r = random.Random(seed)
    pts = [(-71.5 + 0.12 * math.sin(k / 9) + r.uniform(-0.01, 0.01), -33.6 + k * 1.8 / n) for k in range(n + 1)]
    return [(*a, *b) for a, b in zip(pts, pts[1:], strict=False)]


def ring(lon, lat, r, n, seed):
    rnd = random.Random(seed)
    pts = [(lon + (q := r * rnd.uniform(0.8, 1.0)) * math.cos(2 * math.pi * k / n), lat + q * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [(*a, *b) for a, b in zip(pts, pts[1:] + pts[:1], strict=True)]


RINGS = [ring(-71.75, -32.6, 0.04, 60, 1), ring(-71.74, -32.61, 0.03, 40, 2), ring(-71.8, -33.0, 0.004, 12, 3)]


def km(lon, lat, s):
    east = lambda y: 111.32 * math.cos(math.radians(y))
    px, py = (lon - s[0]) * east((lat + s[1]) / 2), (lat - s[1]) * 110.9
    dx, dy = (s[2] - s[0]) * east((s[3] + s[1]) / 2), (s[3] - s[1]) * 110.9
    t = 0 if dx == dy == 0 else max(0, min(1, (px * dx + py * dy) / (dx * dx + dy * dy)))
    return math.hypot(px - t * dx, py - t * dy)


def crossed(lon, lat, segs):
    return sum((s[1] <= lat) != (s[3] <= lat) and s[0] + (lat - s[1]) / (s[3] - s[1]) * (s[2] - s[0]) > lon for s in segs)


def signed(lon, lat, shore, rings, clamp):
    d = min([clamp, *(km(lon, lat, s) for part in ([shore] if shore else []) + rings for s in part)])
    land = bool(shore) and crossed(lon, lat, shore) % 2 == 0 or any(crossed(lon, lat, r) % 2 for r in rings)
    return -d if land else d


def frames(spark, shore, rings):
    columns = "a_lon double, a_lat double, b_lon double, b_lat double"
    a = spark.createDataFrame(shore, columns) if shore else None
    b = spark.createDataFrame([(k, *s) for k, r in enumerate(rings) for s in r], f"line long, {columns}") if rings else None
    return a, b


@pytest.fixture(scope="module")
def field(spark):
    a, b = frames(spark, coast(), RINGS)
    boxes = spark.createDataFrame([("A", *BOX), ("B", -71.6, -71.4, -32.9, -32.8)], "sq string, w double, e double, s double, n double")
    return tf.build(boxes, ["sq"], a, b, texel_km=0.2).cache()


def texels(field, sq):
    """All texels of a field by (i, j), with their places; where blocks overlap they must agree."""
    import numpy as np

    out, grid = {}, None
    for r in field.where(f"sq = '{sq}'").collect():
        f, grid = np.frombuffer(r["field"], "<f4").reshape(r["ny"], r["nx"]), r
        for j in range(r["ny"]):
            for i in range(r["nx"]):
                at = r["bi"] * tf.BLOCK + i, r["bj"] * tf.BLOCK + j
                assert out.setdefault(at, float(f[j, i])) == float(f[j, i])
    return out, grid


def test_every_texel_is_the_direct_distance(field):
    for sq in "AB":
        got, g = texels(field, sq)
        assert set(got) == {(i, j) for i in range(g["width"]) for j in range(g["height"])}
        places = list(got) if sq == "B" else random.Random(1).sample(list(got), 4000)
        for i, j in places:
            want = signed(g["west"] + i * g["lon_step"], g["south"] + j * g["lat_step"], coast(), RINGS, 12.112)
            assert got[i, j] == pytest.approx(want, abs=2e-6), (i, j)


def test_grid_has_slack_and_a_bound(spark):
    boxes = spark.createDataFrame([(*BOX,), (-71.15, -71.85, -32.25, -33.15)], "w double, e double, s double, n double")
    for most in (1 << 24, 5000):
        for g in tf.grids(boxes, 0.08, most).collect():
            assert g["width"] * g["height"] <= most
            assert g["west"] < BOX[0] and g["west"] + (g["width"] - 1) * g["lon_step"] > BOX[1]
            assert g["south"] < BOX[2] and g["south"] + (g["height"] - 1) * g["lat_step"] > BOX[3]
    assert g["texel_km"] > 0.08


def test_sides_of_20000_points_and_lookups(spark, field):
    r = random.Random(7)
    points = [("A", k, r.uniform(BOX[0], BOX[1]), r.uniform(BOX[2], BOX[3])) for k in range(20_000)] + [("B", -1, -70.0, -30.0), ("B", -2, -71.5, -32.85)]
    got = {x["id"]: x["km"] for x in tf.at_points(spark.createDataFrame(points, "sq string, id long, lon double, lat double"), field, ["sq"]).collect()}
    assert len(got) == len(points)
    texel, g = texels(field, "A")
    shore, wrong = coast(), 0
    for _, k, lon, lat in points[:-2]:
        x, y = (lon - g["west"]) / g["lon_step"], (lat - g["south"]) / g["lat_step"]
        i, j = min(int(x), g["width"] - 2), min(int(y), g["height"] - 2)
        u, v = x - i, y - j
        a = texel[i, j] + (texel[i + 1, j] - texel[i, j]) * u
        b = texel[i, j + 1] + (texel[i + 1, j + 1] - texel[i, j + 1]) * u
        assert got[k] == pytest.approx(a + (b - a) * v, abs=1e-9)
        if abs(got[k]) > 3 * 0.2 and k % 4 == 0:  # nearer than that, a texel may hide the line
            wrong += (got[k] < 0) != (signed(lon, lat, shore, RINGS, 12.112) < 0)
    assert wrong == 0


def test_ranges_are_those_of_all_texels(spark, field):
    texel, g = texels(field, "A")
    r = random.Random(9)
    boxes = [("A", k, (w := r.uniform(-71.9, -71.1)), w + r.choice([0.001, 0.05, 0.4]), (s := r.uniform(-33.2, -32.2)), s + r.choice([0.001, 0.03, 0.5])) for k in range(150)]
    boxes += [("A", 900, -72.0, -71.0, -34.0, -32.0), ("A", 901, -75.0, -74.0, -34.0, -33.9)]
    got = {x["id"]: (x["least"], x["most"]) for x in tf.under_boxes(spark.createDataFrame(boxes, "sq string, id long, w double, e double, s double, n double"), field, ["sq"], ["id"]).collect()}
    clamp = lambda x, n: max(0, min(n - 1, x))
    for _, k, w, e, s, n in boxes:
        i0, i1 = clamp(math.floor((w - g["west"]) / g["lon_step"]), g["width"]), clamp(math.floor((e - g["west"]) / g["lon_step"]) + 1, g["width"])
        j0, j1 = clamp(math.floor((s - g["south"]) / g["lat_step"]), g["height"]), clamp(math.floor((n - g["south"]) / g["lat_step"]) + 1, g["height"])
        values = [texel[i, j] for i in range(i0, i1 + 1) for j in range(j0, j1 + 1)]
        assert got[k] == (min(values), max(values)), k


def test_only_islands_or_only_a_coast(spark):
    boxes = spark.createDataFrame([(-71.85, -71.65, -32.7, -32.5)], "w double, e double, s double, n double")
    for shore, rings in ((None, RINGS), (coast(), [])):
        a, b = frames(spark, shore, rings)
        f = tf.build(boxes.selectExpr("'A' AS sq", "*"), ["sq"], a, b, texel_km=0.5)
        got, g = texels(f, "A")
        for (i, j), v in got.items():
            assert v == pytest.approx(signed(g["west"] + i * g["lon_step"], g["south"] + j * g["lat_step"], shore, rings, 12.112), abs=2e-6)


def test_a_block_with_very_many_segments_in_bounded_memory():
    import tracemalloc

    import numpy as np

    n = 40_000
    t = np.arange(n + 1) * 2 * np.pi / n
    ring = np.stack([-71.75 + 0.05 * np.cos(t), -32.7 + 0.05 * np.sin(t)])
    segs = np.r_[ring[:, :-1], ring[:, 1:]]
    lons, lats = -71.9 + np.arange(257) * 0.0009, -32.8 + np.arange(257) * 0.0007
    tracemalloc.start()
    km = tf._nearest(lons, lats, segs, 12.112)
    land = tf._land(lons, lats, segs, np.zeros(n, int), {}, False)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    rows = slice(None, None, 64)
    x, y = (a.ravel() for a in np.meshgrid(lons[rows], lats[rows]))
    every = np.concatenate([tf._distance(x[:, None], y[:, None], segs[:, k : k + 5_000, None].transpose(0, 2, 1)).min(1)[None] for k in range(0, n, 5_000)]).min(0)
    assert np.array_equal(km[rows, rows].ravel(), np.minimum(every, 12.112))
    inside = np.hypot((lons - -71.75)[None, :], (lats - -32.7)[:, None])
    assert land[inside < 0.0499].all() and not land[inside > 0.0501].any()


def test_points_of_a_block_in_parts(spark, monkeypatch):
    from tilewright.operators import lines

    ring = spark.createDataFrame([(0, -71.1, -33.1, -70.9, -33.1), (0, -70.9, -33.1, -71.0, -32.9), (0, -71.0, -32.9, -71.1, -33.1)], "line long, a_lon double, a_lat double, b_lon double, b_lat double")
    box = spark.createDataFrame([(-71.2, -70.8, -33.2, -32.8)], "w double, e double, s double, n double")
    field = tf.build(box, [], None, ring, texel_km=0.5).cache()
    points = spark.createDataFrame([(k, -71.2 + k * 0.0007, -33.2 + k % 97 * 0.004) for k in range(500)], "k long, lon double, lat double")
    whole = {r["k"]: r["km"] for r in tf.at_points(points, field, []).collect()}
    monkeypatch.setattr(tf, "POINTS", 60)
    parts = tf.at_points(points, field, [])
    assert {r["k"]: r["km"] for r in parts.collect()} == whole and len(whole) == 500
    assert abs(whole[0] - lines.signed(points.limit(1), ["k"], None, ring, 12.112).first()["km"]) < 0.5
