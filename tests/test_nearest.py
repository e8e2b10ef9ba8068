import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.operators import nearest


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 600), st.sampled_from([0.0, -33.0, 80.0]), st.sampled_from(["any", "line", "short"]))
def test_nearest_and_crossed_against_all_pairs(seed, n, lat0, kind):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(2, n)) * 0.15
    if kind == "line":  # all of them at almost one distance
        a = np.stack([np.linspace(0, 0.1, n)] * 2)
    segs = np.r_[a, np.roll(a, -1, 1) if kind != "short" else a + rng.normal(size=(2, n)) * 1e-4]
    segs[[1, 3]] += lat0
    lon, lat = rng.normal(size=200) * 0.15, lat0 + rng.normal(size=200) * 0.15
    for flat in (False, True):
        tree = nearest.Tree(segs, flat)
        km, which = tree.nearest(lon, lat, 12.0)
        every = np.stack([tree._away(lon, lat, segs[:, [k]]) for k in range(n)])
        assert np.array_equal(km, np.minimum(every.min(0), 12.0))
        near = which >= 0
        assert np.array_equal(every[which[near], np.flatnonzero(near)], km[near]) and (km[~near] == 12.0).all()
        assert np.array_equal(tree.nearest(lon, lat, 5.0, enough=5.0)[0] < 5.0, km < 5.0)
    on = (segs[1] <= lat[:, None]) != (segs[3] <= lat[:, None])
    with np.errstate(all="ignore"):
        at = segs[0] + (lat[:, None] - segs[1]) / (segs[3] - segs[1]) * (segs[2] - segs[0])
    assert np.array_equal(nearest.crossed(lon, lat, segs), (on & (at > lon[:, None])).sum(1))


def test_few_pairs_where_thousands_of_segments_are_at_almost_one_distance():
    n, pairs = 60_000, []

    class Counted(nearest.Tree):
        def _away(self, lon, lat, seg):
            pairs.append(np.broadcast(lon, seg[0]).size)
            return super()._away(lon, lat, seg)

    t = np.arange(n + 1) * 24 / n
    ring = np.stack([-71.75 + 0.05 * (abs((t + 6) % 24 - 12) - 6) / 6, -32.7 + 0.05 * (abs(t % 24 - 12) - 6) / 6])
    lon, lat = np.random.default_rng(1).uniform(-0.1, 0.1, (2, 2000)) + [[-71.75], [-32.7]]
    Counted(np.r_[ring[:, :-1], ring[:, 1:]]).nearest(lon, lat, 12.112)
    assert sum(pairs) < 800 * len(lon)


def test_sides_of_a_fine_ring_and_long_segments(spark):
    """A cell dealt out in parts, a segment askew over many cells, points in cells without any line."""
    from tilewright.operators import lines

    rng = np.random.default_rng(5)
    t = np.arange(1201) * 2 * np.pi / 1200
    ring = np.stack([0.3 + 0.1 * np.cos(t), 60.3 + 0.1 * np.sin(t)])
    ring = np.r_[ring[:, :-1], ring[:, 1:]]
    coast = np.array([[1.0, 59.0, -1.5, 60.1], [-1.5, 60.1, 1.2, 61.5]]).T
    p = np.stack([rng.uniform(-2, 2, 400), rng.uniform(59.1, 61.4, 400)])
    names = ["a_lon", "a_lat", "b_lon", "b_lat"]
    frame = lambda s: spark.createDataFrame([tuple(map(float, x)) for x in s.T], names)
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p.T)], "k long, lon double, lat double")
    was, lines.POINTS = lines.POINTS, 7
    try:
        got = {r["k"]: r for r in lines.sides(points, ["k"], frame(coast), frame(ring), 12.0).collect()}
        alone = {r["k"]: r["km"] for r in lines.distances(points, ["k"], frame(ring), 12.0).collect()}
    finally:
        lines.POINTS = was
    km = lambda segs: np.minimum(np.stack([nearest.Tree(segs)._away(*p, s) for s in segs.T[:, :, None]]).min(0), 12.0)
    assert len(got) == 400 and np.allclose([got[k]["km"] for k in range(400)], km(np.c_[coast, ring]))
    assert np.allclose([alone[k] for k in range(400)], km(ring))
    assert [got[k]["coast"] for k in range(400)] == (nearest.crossed(*p, coast) % 2 == 0).tolist()
    assert [got[k]["ring"] for k in range(400)] == (nearest.crossed(*p, ring) % 2 == 1).tolist()
