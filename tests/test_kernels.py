"""Kernels against other formulations, round trips and invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.functions import colour, grid, mercator
from tilewright.operators import blocks, catalog, fields, lines, ordered, quality, raster, strokes
from tilewright.plans import views
from tilewright.sources import containers, tables, text_jobs
from tilewright.streaming import downloads


def test_tile_names(spark):
    rows = [("map_09_4580_9180.ttc", 9, 139, 291, False), ("map_09_4580_9180_mask.ttc", 9, 139, 291, True), ("map_14_4dc0_6680.ttc", 14, 4976, 6560, False), ("map_12_3230_6bd0.ttc", 12, 803, 1725, False)]
    df = spark.createDataFrame([(r[0],) for r in rows] + [("map_09_4581_9180.ttc",), ("x.ttc",), ("map_99_0000_0000.ttc",)], "name string")
    got = {r["name"]: r["t"] for r in df.select("name", grid.parse_tile_name("name").alias("t")).collect()}
    for name, *want in rows:
        assert list(got[name]) == want
    assert got["x.ttc"] is None and got["map_09_4581_9180.ttc"] is None and got["map_99_0000_0000.ttc"] is None


def test_known_points(spark):
    df = spark.createDataFrame([(-33.4556, -70.5478, 155, 205), (-27.1648, -109.4219, 100, 215)], "lat double, lon double, x long, y long")
    assert df.where((grid.tile_x("lon", 9) != F.col("x")) | (grid.tile_y("lat", 9) != F.col("y"))).count() == 0


def test_sweref(spark):
    # the projection's false origin: the central meridian at the equator
    n, e = mercator.sweref99tm(F.lit(0.0), F.lit(15.0))
    r = spark.range(1).select(n.alias("n"), e.alias("e")).first()
    assert abs(r["n"]) < 1e-6 and abs(r["e"] - 500000) < 1e-6
    # on the central meridian northing is the scaled arc of the ellipse; beside it a degree is that of the parallel
    f, a = 1 / 298.257222101, 6378137.0
    e2, phi = f * (2 - f), np.linspace(0, np.radians(60), 200_001)
    arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    n, _ = mercator.sweref99tm(F.lit(60.0), F.lit(15.0))
    _, e = mercator.sweref99tm(F.lit(60.0), F.lit(15.01))
    r = spark.range(1).select(n.alias("n"), e.alias("e")).first()
    assert abs(r["n"] - 0.9996 * arc) < 1e-3
    parallel = a / np.sqrt(1 - e2 * np.sin(phi[-1]) ** 2) * np.cos(phi[-1]) * np.radians(0.01)
    assert abs(r["e"] - 500000 - 0.9996 * parallel) < 1e-2


def test_block_tier_equals_pixel_tier(spark, sf_dir):
    px = views.get(spark, sf_dir, "raster")
    rgb = np.zeros((64, 64, 3), np.uint8)
    for r in px.collect():
        rgb[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    half = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in raster.halve(px).collect()}
    a = blocks.halve(rgb)
    assert all(tuple(a[k]) == v for k, v in half.items()) and len(half) == 32 * 32
    b = np.frombuffer(blocks.encode_bc1(rgb), np.dtype([("c0", "<u2"), ("c1", "<u2"), ("bits", "<u4")]))
    coded = {(r["by"], r["bx"]): (r["c0"], r["c1"], r["bits"]) for r in raster.bc1_blocks(px).collect()}
    assert all(tuple(int(x) for x in b[by * 16 + bx]) == v for (by, bx), v in coded.items())
    back = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in raster.bc1_pixels(raster.bc1_blocks(px)).collect()}
    d = blocks.decode_bc1(b.tobytes(), 64, 64)
    assert all(tuple(d[k]) == v for k, v in back.items())


def test_bc1_quality():
    y, x = np.mgrid[:64, :64]
    grad = np.stack([x * 4, y * 4, (x + y) * 2], 2).astype(np.uint8)
    out = blocks.decode_bc1(blocks.encode_bc1(grad), 64, 64).astype(float)
    assert 10 * np.log10(255**2 / ((out - grad) ** 2).mean()) > 30
    flat = np.full((16, 16, 3), (33, 121, 206), np.uint8)
    assert (blocks.decode_bc1(blocks.encode_bc1(flat), 16, 16) == flat).all()


def test_sizes():
    assert len(blocks.mip_chain(np.zeros((64, 64, 3), np.uint8))) == sum(quality.mip_sizes(64))
    assert sum(quality.mip_sizes(2048)) == 2796216


def test_pyramid_of_blocks(spark, sf_dir):
    t = views.get(spark, sf_dir, "raster").selectExpr("12L AS level", "x div 16 AS tx", "3 - y div 16 AS ty", "y % 16 AS y", "x % 16 AS x", "r", "g", "b", "have")
    p = blocks.pyramid(blocks.from_pixels(t, 16), 16, 2)
    assert {r["level"]: r["count"] for r in p.groupBy("level").count().collect()} == {12: 16, 11: 4, 10: 1}


@settings(deadline=None, max_examples=30)
@given(st.lists(st.tuples(st.floats(0, 100), st.floats(0, 100)), min_size=3, max_size=60), st.floats(0.1, 20))
def test_thinning_keeps_ends_and_stays_near(points, tolerance):
    xy = np.array(points)
    keep = strokes.keep_within(xy, tolerance)
    assert keep[0] and keep[-1]
    at = np.flatnonzero(keep)
    for a, b in zip(at, at[1:], strict=False):
        d = xy[b] - xy[a]
        for p in xy[a + 1 : b]:
            t = np.clip((p - xy[a]) @ d / max(d @ d, 1e-30), 0, 1)
            assert np.hypot(*(p - xy[a] - t * d)) <= tolerance + 1e-9


def test_winding_agrees_with_parity(spark, sf_dir):
    from tilewright.plans import registry

    a = registry.queries()["geo_winding"](spark, sf_dir)
    b = registry.queries()["geo_parity"](spark, sf_dir)
    assert a.join(b, "event_id").where("inside <> ring").count() == 0


def test_tone_curve():
    c = colour.curve()
    assert len(c) == 256 and (c[0], c[1], c[16], c[128], c[255]) == (0, 10, 30, 170, 247)
    assert [i for i in range(255) if c[i + 1] < c[i]] == [208, 225]  # it is measured, and falls in two places
    inv = colour.inverse_curve(c)
    assert inv == sorted(inv) and inv[5] == 0.5 and inv[255] == 255 and inv[11] == 3  # the last place of a run
    assert all(abs(c[round(inv[c[i]])] - c[i]) <= 1 for i in range(256))


def test_containers(spark):
    f = containers.field_file(0, 4, 4, 0, np.ones((4, 4)), np.zeros((4, 4, 3)))
    assert containers.parse_field(f)["size"] == 4
    with pytest.raises(ValueError):
        containers.parse_field(f[:-1])
    t = containers.target_file(0, 1, 1, 0, np.ones((2, 3, 3)))
    assert containers.parse_targets(t)["tone"].shape == (2, 3, 3)
    x = containers.texture_file(b"abc", 8, containers.L8, 12)
    got = containers.parse_texture(x)
    assert (got["payload"], got["stored"], got["level"], got["levels"]) == (b"abc", True, 12, 4)
    h = containers.texture_headers(spark.createDataFrame([("p", bytearray(x))], "path string, content binary")).first()
    assert (h["width"], h["length"], h["magic"], h["kind"]) == (8, 3, 0x303A, 0)
    with pytest.raises(ValueError):
        containers.parse_texture(x[:-1])
    with pytest.raises(ValueError):
        containers.parse_texture(b"none")


def test_texture_header_by_offset():
    """The header's fields at the places that the format gives them, of a colour tile and of its mask."""
    n = 2048
    assert containers.chain_size(n, n, 12, containers.DXT1) == 2796216 and containers.chain_size(512, 512, 10, containers.L8) == 349525
    for kind, size, levels, tail in ((10, n, 12, (0xFFFFFFFF, 0xFFFFFFFF)), (0, 512, 10, (0x00FFFFFF, 0))):
        payload = bytes(containers.chain_size(size, size, levels, kind))
        data = containers.texture_file(payload, size, kind, 9)
        at = lambda o: int.from_bytes(data[o : o + 4], "little")  # noqa: E731, B023
        assert [at(o) for o in range(0, 0x2C, 4)] == [0x303A, 0x100, 9, len(payload), len(payload), size, size, levels, kind, *tail]
        assert not any(data[0x2C:0x100]) and len(data) == 0x100 + len(payload)
    coded = containers.chunk(b"coded bytes", 1000)
    number = lambda o, k: int.from_bytes(coded[o : o + k], "little")
    assert [number(0, 4), number(4, 4), number(8, 8), number(0x10, 8)] == [0x40, 0xA810BEF4, 1000, 0x40 + 11]
    assert [number(0x28, 8), number(0x30, 4), number(0x34, 4)] == [0x17F34DF32797945C, 21, 20] and coded[0x40:] == b"coded bytes"
    got = containers.parse_texture(containers.texture_file(coded, 64, 10, 9, plain=1000))
    assert (got["stored"], got["coded"], got["chunk_plain"], got["plain"]) == (False, b"coded bytes", 1000, 1000)


@given(st.binary(max_size=300), st.booleans())
def test_landmark_trees(content, deflated):
    data = containers.tree_file(content, deflated)
    assert containers.tree_content(data) == content
    found = containers.walk(data)
    assert [n["depth"] for n in found] == [0, 1, 2, 2, 2, 2, 2] and len(data) % 8 == 0
    assert data[8:16].hex() == "c3e386cb206d5fec" and int.from_bytes(data[16:24], "little") == len(data)
    with pytest.raises(ValueError):
        containers.tree_content(data.replace(containers.name_hash("SizeCompressed"), bytes(8)))


def test_name_hash_closes_with_nul():
    assert containers.fnv1a64(b"") == 0xCBF29CE484222325
    assert containers.name_hash("a") == containers.fnv1a64(b"a\0").to_bytes(8, "little")


def test_coast_is_carried_on(spark):
    """Beyond its ends the sides go on, whichever way the coast was drawn; distance knows the added pieces too."""
    drawn = [(-71.5, -33.0), (-71.4, -32.5), (-71.6, -32.1)]
    spots = [(-75.0, -31.0), (-75.0, -34.0), (-70.0, -31.0), (-70.0, -34.0), (-75.0, -32.5), (-70.0, -32.5), (-71.51, -33.9), (-71.59, -31.2)]
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(spots)], "k int, lon double, lat double")
    for pts in (drawn, drawn[::-1]):
        segs = spark.createDataFrame([(k, *p, *q) for k, (p, q) in enumerate(zip(pts, pts[1:], strict=False))], "seq int, a_lon double, a_lat double, b_lon double, b_lat double")
        whole = lines.extended(segs, -34.5, -30.5)
        assert whole.count() == 4 and lines.extended(segs, -32.9, -32.2).count() == 2
        km = {r["k"]: r["km"] for r in lines.signed(points, ["k"], whole, None, 12.0).collect()}
        assert [km[k] < 0 for k in range(8)] == [False, False, True, True, False, True, False, True]
        assert km[6] == pytest.approx(0.01 * lines.KM_EAST * np.cos(np.radians(33.9)), rel=1e-2) and -km[7] < 1.0
        assert km[0] == 12.0


def test_square_verdicts(spark):
    coast = spark.createDataFrame([(0, -71.5, -33.0, -71.5, -32.0)], "seq int, a_lon double, a_lat double, b_lon double, b_lat double")
    rows = [("in", -71.6, -71.4, -32.6, -32.4, -5.0, 9.0), ("land", -71.0, -70.9, -32.6, -32.4, -12.0, -12.0), ("sea", -73.0, -72.9, -32.6, -32.4, 12.0, 12.0), ("past", -71.0, -70.9, -32.1, -31.9, -12.0, -12.0)]
    squares = spark.createDataFrame(rows, "k string, w double, e double, s double, n double, least double, most double")
    got = {r["k"]: r["verdict"] for r in lines.square_verdicts(squares, coast, None, 5.556).collect()}
    assert got == {"in": "CUT", "land": "LAND", "sea": "SEA", "past": "OUTSIDE"}
    got = {r["k"]: r["verdict"] for r in lines.square_verdicts(squares, None, coast, 5.556).collect()}
    assert got == {"in": "CUT", "land": "FAR", "sea": "FAR", "past": "FAR"}


def test_places_are_deduped(spark):
    """Against the greedy rule over all pairs of a name."""
    rng = np.random.default_rng(5)
    rows = [(k, ["Ana", "ana", "Bo"][k % 3], float(rng.uniform(-33.3, -32.7)), float(rng.uniform(-71.2, -70.8)), int(rng.integers(0, 9)), k % 2 == 0) for k in range(200)]
    got = {r["place_id"] for r in strokes.dedupe_places(spark.createDataFrame(rows, "place_id long, name string, lat double, lon double, population long, division boolean")).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[5], r[0])):
        if not any(q[1].lower() == r[1].lower() and np.hypot((r[2] - q[2]) * 111.32, (r[3] - q[3]) * 111.32 * np.cos(np.radians(r[2]))) < 8 for q in kept):
            kept.append(r)
    assert got == {r[0] for r in kept} and 5 < len(got) < 190


def test_longest_join_of_chained_strokes(spark):
    rows = [(0, 0, 0, -33.0, -71.0), (0, 0, 1, -33.0, -70.9), (0, 1, 0, -33.0, -70.5), (0, 1, 1, -33.0, -70.85), (1, 2, 0, -20.0, -70.0), (1, 2, 1, -20.0, -69.0)]
    df = spark.createDataFrame(rows, "line long, stroke long, seq long, lat double, lon double")
    deg = 111.32 * np.cos(np.radians(33))
    open_, ring = ({r["line"]: r["gap"] for r in ordered.longest_join(df, rings).collect()} for rings in (False, True))
    assert open_[0] == pytest.approx(0.05 * deg) and open_[1] == 0
    assert ring[0] == pytest.approx(0.5 * deg) and ring[1] == pytest.approx(111.32 * np.cos(np.radians(20)))


def test_job_of_the_first_folder(spark):
    paths = ["a/aa.tmc", "zz.tmc", "B/b.TMC"], ["b/a.tmc", "a/c/z.tmc", "A/b/y.tmc"], ["a/b/c/d/x.tmc"], ["q/Z.tmc", "q/a.tmc"]
    df = spark.createDataFrame([(f"r{k}", p) for k, ps in enumerate(paths) for p in ps], "root string, path string")
    got = {r["root"]: r["path"] for r in catalog.find_job(df).collect()}
    assert got == {"r0": "zz.tmc", "r1": "A/b/y.tmc", "r3": "q/a.tmc"}


def test_install_plans(spark):
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    plan = lambda *a: sorted(map(tuple, catalog.install_plan(*a).collect()))
    there = names("map_a.ttc", "old.TTC", "notes.txt")
    assert plan(names("MAP_A.ttc"), there) == [("copy", "MAP_A.ttc"), ("delete", "old.TTC")]
    assert plan(names("MAP_A.ttc"), there, 11) == [("copy", "MAP_A.ttc")]
    assert plan(there.limit(0), there) == []


def test_mask_chain():
    m = np.zeros((8, 8), np.uint8)
    m[5, 2] = 255
    data = blocks.mask_chain(m)
    assert len(data) == containers.chain_size(8, 8, 4, containers.L8)
    assert data[64 + 2 * 4 + 1] == 255 and data[80 + 1 * 2 + 0] == 255 and data[84] == 255 and sum(data) == 4 * 255


def test_jobs_without_regions_raise(spark):
    df = spark.createDataFrame([(1, "<[file][][]>")], "id long, text string")
    with pytest.raises(Exception, match="without regions"):
        text_jobs.regions(df, "id").collect()
    with pytest.raises(Exception, match="incomplete"):
        text_jobs.georeferences(df, "id").collect()


def test_line_file_round_trip(spark):
    text = ["# coast", "# land E", "# margin_km 3.5", "-33.5 -71.25", "-33.25 -71.5", "", "-33.0 -71.5", "# island 3", "-32.5 -71.75", "-32.25 -71.75"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(text)], "file long, n long, line string")
    p = text_jobs.line_points(df)
    assert p.count() == 4 and {r["island"] for r in p.collect()} == {-1, 3}
    again = text_jobs.point_lines(p).select("file", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    q = text_jobs.line_points(again)
    cols = ["island", "seq", "lat", "lon"]
    assert sorted(map(tuple, p.select(cols).collect())) == sorted(map(tuple, q.select(cols).collect()))
    s = text_jobs.line_settings(df).first()
    assert (s["land"], s["margin_km"]) == ("E", 3.5)


def test_images_round_trip(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(blocks.png(rgb))
    r = tables.read_images(spark, str(tmp_path)).first()
    assert bytes(r["rgb"]) == rgb.tobytes() and (r["height"], r["width"]) == (5, 7)


def test_sharpen_and_enlarge():
    a = np.zeros((12, 12, 3), np.uint8)
    a[3:8, 3:8] = 200
    assert (blocks.sharpen(a, 0) == a).all() and blocks.enlarge(a, 2).shape == (24, 24, 3)


def test_settings():
    s = tables.Settings.load({"zoom": 15, "source": None, "unknown": 1})
    assert (s.zoom, s.source, tables.Settings.load(s.save())) == (15, "google", s)


def test_offsets_are_solved():
    pairs = [{"p": 0, "q": 1, "weight": 2.0, "r": 3.0, "g": 0.0, "b": -1.0}, {"p": 1, "q": 2, "weight": 1.0, "r": 1.0, "g": 2.0, "b": 0.0}]
    got = quality.solve_offsets(pairs, 0)
    assert np.allclose(got[1], [-3, 0, 1]) and np.allclose(got[2], [-4, -2, 1])


def test_stitch_gaps(spark):
    g = spark.createDataFrame([(0, 0), (1, 0)], "x long, y long")
    t = spark.createDataFrame([(1, 0)], "tile_x long, tile_y long")
    assert [(r["px"], r["present"]) for r in fields.stitch(g, t, 256).orderBy("x").collect()] == [(0, False), (256, True)]


def test_restartable_download(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"f{k}").write_bytes(b"x")
        spark.createDataFrame([(f"file://{tmp_path}/f{k}",), (f"file://{tmp_path}/f0",)], "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
        from tilewright.operators.fetch import file_source

        downloads.run(spark, str(tmp_path / "inbox"), str(tmp_path / "out"), str(tmp_path / "cp"), file_source)
        assert spark.read.parquet(str(tmp_path / "out")).where("http = 200").count() == k + 1


def test_water_bodies():
    from tilewright.operators.labels import components, water_bodies

    two = np.zeros((20, 20), bool)
    two[2:6, 2:6] = two[10:15, 10:15] = True
    assert components(two).max() == 2
    u = np.zeros((20, 20), bool)
    u[2:15, 2] = u[2:15, 10] = u[14, 2:11] = True
    assert components(u).max() == 1
    corner = np.zeros((10, 10), bool)
    corner[:5, :5] = corner[5:, 5:] = True
    assert components(corner).max() == 2
    channel = np.zeros((30, 40), bool)
    channel[5:25, 2:15] = channel[5:25, 25:38] = channel[15, 15:25] = True
    assert water_bodies(channel, 0).max() == 1
    parted = water_bodies(channel, 2)
    assert parted.max() == 2 and ((parted > 0) == channel).all()
    assert components(np.zeros((5, 5), bool)).max() == 0 and components(np.ones((5, 5), bool)).max() == 1


def test_components_by_runs_agree(spark, sf_dir):
    from tilewright.operators.labels import components
    from tilewright.operators.rasters_more import components as by_runs

    px = views.get(spark, sf_dir, "raster")
    mask = np.zeros((64, 64), bool)
    for r in px.collect():
        mask[r["y"], r["x"]] = r["have"]
    runs = by_runs(px, "have").collect()
    want = components(mask)
    assert len({r["label"] for r in runs}) == want.max()
    assert len({(r["label"], int(want[r["y"], r["x0"]])) for r in runs}) == want.max()


def test_chain_takes_every_stroke(spark):
    """geo_chain on a table of 500 strokes against the greedy rule, stroke by stroke."""
    from tilewright.plans import registry

    d = "/root/testdata/sf0.01"
    points = {}
    for r in views.get(spark, d, "stroke_point").orderBy("stroke", "seq").collect():
        points.setdefault(r["stroke"], []).append((r["lat"], r["lon"]))
    got = {}
    for r in registry.queries()["geo_chain"](spark, d).orderBy("line", "place", "seq").collect():
        got.setdefault((r["line"], r["place"], r["stroke"], r["flipped"]), []).append((r["lat"], r["lon"]))
    assert len(points) > 60 and sorted(k[2] for k in got) == sorted(points)
    for (_, _, stroke, flipped), p in got.items():
        assert p == (points[stroke][::-1] if flipped else points[stroke])
    for line in range(5):
        flat = {k: strokes._plane(*np.array(points[k]).T) for k in sorted(points) if k % 5 == line}
        rest = list(flat)
        chain = [(rest.pop(0), False)]
        while rest:
            tips = [(flat[chain[-1][0]][0 if chain[-1][1] else -1], True), (flat[chain[0][0]][-1 if chain[0][1] else 0], False)]
            ways = [(float(np.hypot(*(tip - flat[k][e]))), k, late, e) for k in rest for tip, late in tips for e in (0, -1)]
            _, k, late, e = min(ways, key=lambda w: w[0])
            rest.remove(k)
            chain = [*chain, (k, e == -1)] if late else [(k, e == 0), *chain]
        assert chain == [k[2:] for k in sorted(got) if k[0] == line]


def test_chain_of_many_strokes_meets_few_ends():
    """Chained by a grid of the free ends: the greedy rule, without all ends at every step."""
    from tilewright.operators import strokes

    rng = np.random.default_rng(4)
    for n, grain in ((1, 1), (2, 1), (150, 10), (150, 0.001)):
        ends = np.round(rng.random((n, 2, 2)) * 100 / grain) * grain  # of the coarse ones many lie on one place
        order, free = [(0, False)], np.arange(n) > 0
        end = lambda k, flip, last: ends[k][int(last != flip)]
        while free.any():
            away = np.stack([end(*order[-1], True), end(*order[0], False)])[None, :, None] - ends[:, None]  # noqa: B023
            d = np.where(free[:, None, None], np.hypot(away[..., 0], away[..., 1]), np.inf)
            at, head, last = (int(k) for k in np.unravel_index(d.argmin(), d.shape))
            free[at] = False
            order = [(at, not last), *order] if head else [*order, (at, bool(last))]
        assert strokes._chained(ends) == order
    met = []

    class Counted(strokes._Free):
        def nearest(self, x, y):
            met.append(min(self.laid, 50))
            return super().nearest(x, y)

    was, strokes._Free = strokes._Free, Counted
    try:
        assert sorted(k for k, _ in strokes._chained(rng.random((5_000, 2, 2)))) == list(range(5_000))
    finally:
        strokes._Free = was
    assert len(met) < 2 * 5_000


def test_crowded_boxes_meet_once(spark):
    from tilewright.operators import rangejoin

    rng = np.random.default_rng(6)
    low = np.round(rng.uniform(-3, 3, (300, 2)), 1)  # many edges are equal
    high = low + np.round(rng.uniform(0.1, 3, (300, 2)), 1)
    t = spark.createDataFrame([(k, *map(float, (w, e, s, n))) for k, ((w, s), (e, n)) in enumerate(zip(low, high, strict=True))], "k long, w double, e double, s double, n double")
    met = rangejoin.crowded_box_join(t, t, 0.5, [F.col("a.k").alias("j"), F.col("b.k").alias("k")])
    got = sorted(tuple(r) for r in met.collect())
    hit = (low[:, None] < high[None]).all(2) & (low[None] < high[:, None]).all(2)
    assert got == sorted(map(tuple, np.argwhere(hit).tolist()))


def test_pairs_of_squares_and_files_are_not_shuffled(spark):
    """What a square gets is told where it meets a file; only squares go on to those that meet none, twins and empty ones too."""
    from tilewright.operators import lines

    files = spark.createDataFrame([(1, 7, True, 0.0, 20.0, 1.0, 2.0, 1.0, 2.0), (1, 8, False, 0.0, 0.0, 5.0, 6.0, 5.0, 6.0)], "file long, line long, has_coast boolean, lo double, hi double, rw double, re double, rs double, rn double")
    rows = [(1, 1, 1.0, 1.5, 1.0, 1.5), (2, 1, 5.0, 5.5, 5.0, 5.5), (3, 1, 9.0, 9.5, 30.0, 30.5), (3, 1, 9.0, 9.5, 30.0, 30.5), (4, 2, 1.0, 1.5, 1.0, 1.5), (5, 1, 0.0, 0.5, None, 0.5), (6, 1, 0.0, 0.5, 19.8, 20.4)]
    out = lines.for_squares(spark.createDataFrame(rows, "square long, file long, w double, e double, s double, n double"), files, ["file"])
    got = sorted((r["square"], r["line"] or 0, r["part"]) for r in out.collect())
    assert got == [(1, 7, "coast and islands"), (2, 7, "coast"), (2, 8, "islands"), (3, 0, "none"), (3, 0, "none"), (4, 0, "none"), (5, 0, "none"), (6, 7, "outside")]
    assert out._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
