"""Cut lines, patch labels and fetching against plain formulations of their rules."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.operators import cutlines, fetch, labels, lines
from tilewright.plans import views

M = 5.556


def _km(p, drawn):
    """Distance of one point to the nearest segment, segment by segment."""
    scale = cutlines.KM_EAST * np.cos(np.radians(p[1])), cutlines.KM_NORTH
    best = np.inf
    for line, closed, _ in drawn:
        q = (line - p) * scale
        ends = list(zip(q, np.roll(q, -1, 0), strict=True))
        for a, b in ends if closed else ends[:-1]:
            d = b - a
            t = min(max(-(a @ d) / max(d @ d, 1e-30), 0), 1)
            best = min(best, float(np.hypot(*(a + t * d))))
    return best


def _ring(lon, lat, km, n=24, back=False):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)[:: -1 if back else 1]
    return np.stack([lon + km * np.cos(t) / (cutlines.KM_EAST * np.cos(np.radians(lat))), lat + km * np.sin(t) / cutlines.KM_NORTH], 1)


def test_cut_of_a_straight_coast():
    coast = np.stack([np.full(11, -71.0), np.linspace(-33, -32.5, 11)], 1)
    for hand, side in ((-1, -1), (1, 1)):
        (cut,) = cutlines.cut_pieces([(coast, False, hand)], M)
        assert (np.sign(cut[:, 0] + 71) == side).all() and (np.diff(cut[:, 1]) >= -1e-9).all()
        assert all(abs(_km(p, [(coast, False, hand)]) - M) < 0.011 for p in cut)
    assert cutlines.cut_pieces([(coast, False, 1)], 0.0)[0] is coast and cutlines.cut_pieces([(coast[:1], False, 1)], M) == []


def test_cut_of_a_bay_has_its_corner():
    # a bay narrower than twice the margin: the offset folds there, and the cut passes its mouth in one piece
    x, y = np.array([0.0, 0.0, 0.12, 0.0, 0.0]) - 71, np.array([0.0, 0.3, 0.34, 0.38, 0.7]) - 33
    line = [(np.stack([x, y], 1), False, -1)]
    (cut,) = cutlines.cut_pieces(line, M)
    far = [_km(p, line) for p in cut]
    assert min(far) >= M * 0.9985 and max(far) < M * 1.01
    step = np.hypot(*(np.diff(cut, axis=0) * cutlines._scale(cut[:-1])).T)
    assert step.max() < M * 0.5


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(-0.2, 0.2), st.floats(0.01, 0.2)), min_size=3, max_size=12))
def test_no_point_of_a_cut_lies_within_the_margin(steps):
    line = [(np.stack([np.array([a for a, _ in steps]) - 71, np.cumsum([b for _, b in steps]) - 33], 1), False, -1)]
    for cut in cutlines.cut_pieces(line, M):
        assert min(_km(p, line) for p in cut) > M * 0.99


def test_cuts_of_rings():
    for back in (False, True):
        ring = _ring(-71, -33, 3, back=back)
        hand = cutlines.ring_sea(ring)
        (cut,) = cutlines.cut_pieces([(ring, True, hand)], M)
        assert (cut[0] == cut[-1]).all() and all(abs(_km(p, [(ring, True, hand)]) - M) < 0.02 for p in cut)
    two = [(r, True, cutlines.ring_sea(r)) for r in (_ring(-71, -33, 3), _ring(-70.87, -33, 3))]
    cuts = cutlines.cut_pieces(two, M)  # their margins overlap: each keeps its outer part, open
    assert len(cuts) == 2 and all((c[0] != c[-1]).any() for c in cuts)
    assert min(_km(p, two) for c in cuts for p in c) > M * 0.99
    big, islet = _ring(-71, -33, 4, 60), _ring(-71, -33, 0.5)
    cuts = cutlines.cut_pieces([(big, True, 1), (islet, True, 1)], M)
    assert len(cuts) == 1  # the islet's cut lies inside the other line's margin


def test_cut_of_a_line_over_a_pole():
    """A degree east has no length at a pole: offsets there were endless, and their steps more than any memory."""
    seq = np.arange(80)
    line = [(np.stack([-71.5 + (seq * 37 % 23 - 11) * 0.004, 89.8 + seq * 0.006], 1), False, -1)]
    cuts = cutlines.cut_pieces(line, M)
    tree = cutlines.Tree(np.concatenate([line[0][0][:-1], line[0][0][1:]], 1).T, flat=True)
    assert cuts and all(np.isfinite(c).all() and c[:, 0].max() < -71.5 for c in cuts)
    assert min(cutlines.nearest(c, tree, 3 * M)[0].min() for c in cuts) > M * 0.99


def test_cut_lines_by_file(spark, sf_dir):
    from tilewright.plans import registry

    got = registry.queries()["geo_cut_line"](spark, sf_dir).orderBy("piece", "seq").collect()
    coast = np.array([[r["lon"], r["lat"]] for r in views.get(spark, sf_dir, "coast_point").orderBy("seq").collect()])
    island = np.array([[r["lon"], r["lat"]] for r in views.get(spark, sf_dir, "ring_point").orderBy("seq").collect()])
    drawn = [(coast, False, -1), (island, True, 1)]
    assert len(got) > 50 and min(_km(np.array([r["lon"], r["lat"]]), drawn) for r in got) > lines.MARGIN_KM * 0.99
    rows = [(1, 0, "left", 0, -33.0, -71.0), (1, 0, "left", 1, -32.9, -71.0), (2, 0, None, 0, -33.0, -71.0)]
    t = cutlines.cut_lines(spark.createDataFrame(rows, "file long, line long, sea string, seq long, lat double, lon double"), M)
    assert {r["file"] for r in t.collect()} == {1}  # a line of one point has no cut
    assert cutlines.cut_lines(spark.createDataFrame([], "file long, line long, sea string, seq long, lat double, lon double"), M).count() == 0


def _reach(allowed, y, x):
    """Pixels reached from a seed, pixel by pixel."""
    todo, seen = ([(y, x)] if allowed[y, x] else []), set()
    while todo:
        y, x = todo.pop()
        if (y, x) in seen or not (0 <= y < allowed.shape[0] and 0 <= x < allowed.shape[1]) or not allowed[y, x]:
            continue
        seen.add((y, x))
        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    out = np.zeros(allowed.shape, bool)
    for p in seen:
        out[p] = True
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 14), st.integers(1, 14), st.integers(0, 2**32 - 1), st.floats(0.2, 0.9))
def test_components_and_filling(h, w, seed, share):
    mask = np.random.default_rng(seed).random((h, w)) < share
    got, want, k = labels.components(mask), np.zeros((h, w), int), 0
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not want[y, x]:
                k += 1
                want[_reach(mask, y, x)] = k
    assert (got == want).all()
    outside = _reach(np.pad(~mask, 1, constant_values=True), 0, 0)[1:-1, 1:-1]
    assert (labels.filled(mask) == ~outside).all()
    for r in (1, 2, 3):
        wide = np.array([[mask[max(y - r, 0) : y + r + 1, max(x - r, 0) : x + r + 1].any() for x in range(w)] for y in range(h)])
        assert (labels.widened(mask, r) == wide).all()
    diamond = np.array([[any(mask[b, a] and abs(a - x) + abs(b - y) <= 2 for b in range(h) for a in range(w)) for x in range(w)] for y in range(h)])
    assert (labels.spread(mask, 2) == diamond).all()


def test_smoothing_repeats_edges():
    a = np.random.default_rng(3).random((9, 7, 3))
    p = np.pad(a, ((2, 2), (2, 2), (0, 0)), mode="edge")
    want = np.array([[p[y : y + 5, x : x + 5].mean((0, 1)) for x in range(7)] for y in range(9)])
    assert np.allclose(labels.smoothed(a, 5), want)


def _scene():
    """Terrain of grey, a patch of red with lava in it, a lake, and noise of a step or two."""
    rgb = np.full((80, 80, 3), 120.0)
    rgb[20:50, 20:50] = (160, 110, 110)
    rgb[30:36, 30:36] = 20
    rgb[60:78, 60:78] = (20, 60, 120)
    land = np.ones((80, 80), bool)
    land[60:78, 60:78] = False
    return np.clip(rgb + np.random.default_rng(5).integers(-2, 3, rgb.shape), 0, 255), land


def test_wand_fills_what_it_encloses():
    rgb, _ = _scene()
    have = np.ones((80, 80), bool)
    m = labels.wand(rgb, have, 25, 25, 15)
    soft = labels.smoothed(rgb, 3)
    like = (np.linalg.norm(soft - soft[23:28, 23:28].mean((0, 1)), axis=2) < 15) & have
    reached = np.pad(_reach(like, 25, 25), 1)
    whole = ~_reach(~reached, 0, 0)[1:-1, 1:-1]
    assert (m == labels.spread(whole, 1)).all()
    assert m[33, 33] and m[20:50, 20:50].all() and m.sum() < 34 * 34 and not labels.wand(rgb, ~have, 25, 25, 15)[25, 25]


def test_patch_labels_by_their_rules():
    rgb, land = _scene()
    red = np.zeros((80, 80), bool)
    red[20:50, 20:50] = True
    lava = red.copy()
    lava[30:36, 30:36] = False
    leak = lava.copy()
    leak[34:37, 50:75] = True  # thinner than what opening keeps
    lake = ~land
    out = labels.patches([lake, leak, lava], land, rgb)
    assert set(np.unique(out)) == {0, 1}  # the lake is none, the second click joins the first
    assert out[33, 33] == 1 and not out[34:37, 56:].any() and (out[22:48, 22:48] == 1).all() and not out[~land].any()
    apart = np.zeros((80, 80), bool)
    apart[60:75, 5:25] = True
    assert labels.patches([lava, apart], land, rgb).max() == 2
    assert labels.patches([], land, rgb).max() == 0 and labels.patches([np.zeros((80, 80), bool)], land, rgb).max() == 0


def test_border_of_terrain_colour_is_given_back():
    rgb, land = _scene()
    wide = np.zeros((80, 80), np.int32)
    wide[20:50, 16:50] = 1  # four columns of terrain
    out = labels.pruned(wide, land, rgb)
    assert not out[24:46, 16:18].any() and (out[24:46, 22:48] == 1).all()
    assert (labels.pruned(wide[:0], land[:0], rgb[:0]) == wide[:0]).all()


def test_requests_are_asked_again_by_source(spark):
    def source(url, headers):
        if url == "raises":
            raise OSError
        return int(url[:3]), {"x-ve-tile-info": "no-tile"} if "n" in url else {}, headers["Referer"].encode()

    rows = [("404", "ArcGIS"), ("503", "US_USGS"), ("304", "ArcGIS"), ("500", "Bing"), ("200n", "Bing"), ("raises", None)]
    t = fetch.fetched(spark.createDataFrame(rows, "url string, source string"), source, retries=2, extra={"Bing": {"referrer": "http://b/"}})
    got = {r["url"]: (r["http"], r["attempts"], r["no_tile"], r["content"] and bytes(r["content"])) for r in t.collect()}
    usual = b"http://google.com/"
    assert got == {"404": (404, 7, False, usual), "503": (503, 3, False, usual), "304": (304, 1, False, usual), "500": (500, 1, False, b"http://b/"), "200n": (200, 1, True, b"http://b/"), "raises": (-1, 1, False, None)}
    s = t.select("url", fetch.status("http", "no_tile", F.lit(True)).alias("s")).collect()
    assert dict(s) == {"404": "unavailable", "503": "failed", "304": "saved", "500": "failed", "200n": "unavailable", "raises": "failed"}


def test_http_source_on_this_machine(spark):
    import gzip

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            there = self.path == "/tile" and "gzip" in self.headers["Accept-Encoding"]
            body = gzip.compress(b"\x89PNG\r\n\x1a\n" + b"0" * 8) if there else b"no"
            self.send_response(200 if there else 404)
            if there:
                self.send_header("Content-Encoding", "gzip")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    t = fetch.fetched(spark.createDataFrame([(f"{base}/tile",), (f"{base}/none",)], "url string"), fetch.http_source)
    got = sorted((r["http"], r["kind"]) for r in t.select("http", fetch.sniff("content").alias("kind")).collect())
    server.shutdown()
    assert got == [(200, "png"), (404, None)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=256, max_size=256))
def test_code_lengths_make_a_prefix_code(counts):
    from tilewright.operators.jpegs import code_lengths

    depth = code_lengths(np.array(counts))
    assert max(depth.values()) <= 16 and sum(2.0**-d for d in depth.values()) == 1 and depth[256] == max(depth.values())


def test_jpeg_is_read_by_others(spark, tmp_path):
    from tilewright.operators import jpegs
    from tilewright.sources import tables

    rng = np.random.default_rng(7)
    y, x = np.mgrid[:61, :83]
    scenes = {
        "ramp": np.stack([x * 3, y * 4, x + y], -1),
        "flat": np.full((8, 8, 3), 77),
        "dot": np.full((1, 1, 3), 200),
        "noise": rng.integers(0, 256, (40, 24, 3)),
        "fine": np.stack([127 + 90 * np.sin(x), 127 + 90 * np.cos(y / 2), 127 + 60 * np.sin(x * y / 40)], -1),
    }
    for name, a in scenes.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpegs.jpeg(a.astype(np.uint8), 90 if name != "noise" else 100))
    got = {r[0].rsplit("/", 1)[-1][:-4]: r for r in tables.read_images(spark, str(tmp_path)).collect()}
    for name, a in scenes.items():
        back = np.frombuffer(bytes(got[name]["rgb"]), np.uint8).reshape(got[name]["height"], got[name]["width"], 3)
        assert back.shape == a.shape
        assert 10 * np.log10(255**2 / max(np.mean((back - a.astype(np.uint8).astype(float)) ** 2), 1e-9)) > 34, name
    rough = jpegs.jpeg(scenes["fine"].astype(np.uint8), 30)
    assert len(rough) < len(jpegs.jpeg(scenes["fine"].astype(np.uint8), 90))
