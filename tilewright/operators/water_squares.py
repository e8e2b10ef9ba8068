"""Water over many squares: windows and bodies that do not stop at a square's border.

Squares are rows (tx, ty, images of n x n as bytes), row 0 in the north, ty growing to the north. What a
square needs of its neighbours comes by an exchange of rims: each sends its edges and corners to the
eight around it, so that a window of any kernel is whole, and what is moved is a rim a square. Bodies
of water get labels square by square; where two squares meet, their rims are laid side by side, and
the pairs of labels that touch are the edges of a graph whose components are merged by the least label,
with jumps, in as many rounds as the longest chain needs doubled. So no square's image is ever joined to
another's, and a body may lie in any number of them.

A label is the place of a body's first pixel, counted over all squares row by row from the north west, so
that labels are in the order they would have in one joined raster.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import colour, grid
from tilewright.operators import blocks, labels
from tilewright.session import stored

#: Km of a window of local tone, texels that part bodies, least blue over red of water, share of a body's target.
WINDOW_KM, OPEN, LEAST_BLUE, TARGET_SHARE, LEAST_KM2 = 1.8, 2, 15.0, 0.15, 2.0
#: Steps a value is counted by, when a body's target is looked for.
STEPS = 256
KM_PER_DEG = 111.32
ID_BITS = 32


def exchanged(squares: DataFrame, images: dict[str, str], n: int, h: int) -> DataFrame:
    """Squares with their images widened by h pixels of the neighbours on each side, zero where there is none.

    images: numpy types by column; a pixel may have several values. h is at most n.
    """
    columns = list(images)

    def give(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                held = [np.frombuffer(getattr(r, c), images[c]).reshape(n, n, -1) for c in columns]
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        rows = slice(0, h) if dy > 0 else slice(n - h, n) if dy < 0 else slice(None)
                        cols = slice(n - h, n) if dx > 0 else slice(0, h) if dx < 0 else slice(None)
                        out.append((r.tx + dx, r.ty + dy, dx, dy, *[a[rows, cols].tobytes() for a in held]))
            yield type(pdf)(out, columns=["tx", "ty", "dx", "dy", *columns])

    def take(pdf):
        if not ((pdf["dx"] == 0) & (pdf["dy"] == 0)).any():
            return pdf.iloc[:0][["tx", "ty", *columns]]
        out = {}
        for c in columns:
            size = len(pdf[c][(pdf["dx"] == 0) & (pdf["dy"] == 0)].iloc[0]) // np.dtype(images[c]).itemsize // (n * n)
            a = np.zeros((n + 2 * h, n + 2 * h, size), images[c])
            for dx, dy, data in zip(pdf["dx"], pdf["dy"], pdf[c], strict=True):
                # what came from the south (dy = 1) lies below
                y = slice(n + h, n + 2 * h) if dy > 0 else slice(0, h) if dy < 0 else slice(h, n + h)
                x = slice(0, h) if dx > 0 else slice(n + h, n + 2 * h) if dx < 0 else slice(h, n + h)
                a[y, x] = np.frombuffer(data, images[c]).reshape(y.stop - y.start, x.stop - x.start, size)
            out[c] = [a.tobytes()]
        return pdf.iloc[:1][["tx", "ty"]].assign(**out)

    schema = ", ".join(f"{c} binary" for c in columns)
    pieces = squares.select("tx", "ty", *columns).mapInPandas(give, f"tx long, ty long, dx int, dy int, {schema}")
    return pieces.groupBy("tx", "ty").applyInPandas(take, f"tx long, ty long, {schema}")


def _places(tx: int, ty: int, n: int, level: int) -> np.ndarray:
    """The place of each pixel of a square in the order of all squares."""
    rows = (2**level - 1 - ty) * n + np.arange(n, dtype=np.int64)
    return rows[:, None] << ID_BITS | (tx * n + np.arange(n, dtype=np.int64))


def merged(edges: DataFrame) -> DataFrame:
    """(a, b) to (v, root): the least vertex of each one's component. Rounds go on until none changes."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "rim-edges")
    root = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "v"), "rim-roots")
    while True:
        far = both.join(root.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        now = root.join(far, "v").select("v", "root", F.least("root", "near").alias("next"))
        jump = root.select(F.col("v").alias("next"), F.col("root").alias("beyond"))
        now = now.join(jump, "next", "left").select("v", "root", F.least("next", F.coalesce("beyond", "next")).alias("next"))
        now = stored(now, "rim-roots")
        changed = now.where("next < root").limit(1).count()
        root = now.select("v", F.col("next").alias("root"))
        if not changed:
            return root


def components(squares: DataFrame, mask: str, n: int, level: int) -> DataFrame:
    """Squares (tx, ty, mask) to (tx, ty, label): 4-connected components over all squares, as int64 images, 0 outside the mask."""

    def local(batches):
        for pdf in batches:
            out = []
            for tx, ty, data in zip(pdf["tx"], pdf["ty"], pdf[mask], strict=True):
                part = labels.components(np.frombuffer(data, np.uint8).reshape(n, n) > 0)
                first = np.full(part.max(initial=0) + 1, np.iinfo(np.int64).max)
                np.minimum.at(first, part.ravel(), _places(tx, ty, n, level).ravel() + 1)
                first[0] = 0
                out.append(first[part].astype("<i8").tobytes())
            yield pdf[["tx", "ty"]].assign(label=out)

    own = stored(squares.select("tx", "ty", mask).mapInPandas(local, "tx long, ty long, label binary"), "components")

    def rims(batches):
        for pdf in batches:
            out = []
            for tx, ty, data in zip(pdf["tx"], pdf["ty"], pdf["label"], strict=True):
                a = np.frombuffer(data, "<i8").reshape(n, n)
                # a border is named by the square east, or north, of it
                for x, y, along, side, rim in ((tx + 1, ty, 0, 0, a[:, -1]), (tx, ty, 0, 1, a[:, 0]), (tx, ty + 1, 1, 0, a[0]), (tx, ty, 1, 1, a[-1])):
                    if rim.any():
                        out.append((x, y, along, side, rim.tobytes()))
            yield type(pdf)(out, columns=["x", "y", "along", "side", "rim"])

    def touching(pdf):
        if len(pdf) < 2:
            return type(pdf)({"a": [], "b": []})
        a, b = (np.frombuffer(r, "<i8") for r in pdf["rim"])
        both = (a > 0) & (b > 0)
        pairs = np.unique(np.stack([a[both], b[both]], 1), axis=0)
        return type(pdf)({"a": pairs[:, 0], "b": pairs[:, 1]})

    edges = own.mapInPandas(rims, "x long, y long, along int, side int, rim binary").groupBy("x", "y", "along").applyInPandas(touching, "a long, b long")
    roots = merged(edges).where("root < v")
    # the square that a label was made in is in its place
    row, column = F.shiftright(F.col("v") - 1, ID_BITS), (F.col("v") - 1).bitwiseAND((1 << ID_BITS) - 1)
    roots = roots.select(F.floor(column / n).alias("tx"), (F.lit(2**level - 1) - F.floor(row / n)).alias("ty"), "v", "root")

    def renamed(_, pdf, names):
        if not len(pdf):
            return pdf[["tx", "ty", "label"]]
        a = np.frombuffer(pdf["label"].iloc[0], "<i8")
        old, at = np.unique(a, return_inverse=True)
        new = dict(zip(names["v"], names["root"], strict=True))
        return pdf[["tx", "ty"]].assign(label=[np.array([new.get(x, x) for x in old.tolist()], "<i8")[at].tobytes()])

    return own.groupBy("tx", "ty").cogroup(roots.groupBy("tx", "ty")).applyInPandas(renamed, "tx long, ty long, label binary")


def bodies(squares: DataFrame, mask: str, n: int, level: int, open_by: int = OPEN) -> DataFrame:
    """Bodies of water over squares (tx, ty, mask): (tx, ty, label).

    Channels narrower than twice open_by part them; what that took grows back along the mask, the lowest
    label first, in 4 * open_by + 4 steps; what no body reaches is labelled apart.
    """
    steps = 4 * open_by + 4 if open_by else 0
    images = {mask: "u1"}
    whole = stored(squares.select("tx", "ty", mask), "water-masks")

    def cores(batches):
        for pdf in batches:
            out = []
            for data in pdf[mask]:
                # what is beyond the outermost squares does not take from a body, as in one raster
                a = np.frombuffer(data, "u1").reshape(n + 2 * open_by, n + 2 * open_by, 2)
                core = labels.shrunk((a[..., 0] > 0) | (a[..., 1] == 0), open_by)[open_by : n + open_by, open_by : n + open_by]
                out.append((core & (a[open_by : n + open_by, open_by : n + open_by, 0] > 0)).astype(np.uint8).tobytes())
            yield pdf[["tx", "ty"]].assign(core=out)

    if open_by:
        there = whole.mapInPandas(lambda batches: (pdf.assign(**{mask: [np.stack([np.frombuffer(d, "u1"), np.ones(n * n, np.uint8)], 1).tobytes() for d in pdf[mask]]}) for pdf in batches), whole.schema)
        core = exchanged(there, images, n, open_by).mapInPandas(cores, "tx long, ty long, core binary")
    else:
        core = whole.withColumnRenamed(mask, "core")
    label = components(core, "core", n, level)
    if not open_by:
        return label
    parts = whole.join(label.withColumnRenamed("label", "core"), ["tx", "ty"])
    wide = exchanged(parts, {mask: "u1", "core": "<i8"}, n, steps)
    none = np.iinfo(np.int64).max

    def grown(batches):
        for pdf in batches:
            out, rest = [], []
            for data, core in zip(pdf[mask], pdf["core"], strict=True):
                m = np.frombuffer(data, "u1").reshape(n + 2 * steps, n + 2 * steps) > 0
                a = np.frombuffer(core, "<i8").reshape(m.shape).copy()
                for _ in range(steps):
                    p = np.pad(np.where(a > 0, a, none), 1, constant_values=none)
                    near = np.minimum.reduce([p[2:, 1:-1], p[:-2, 1:-1], p[1:-1, 2:], p[1:-1, :-2]])
                    take = m & (a == 0) & (near < none)
                    if not take.any():
                        break
                    a[take] = near[take]
                inner = slice(steps, n + steps)
                out.append(a[inner, inner].tobytes())
                rest.append((m & (a == 0))[inner, inner].astype(np.uint8).tobytes())
            yield pdf[["tx", "ty"]].assign(label=out, rest=rest)

    label = stored(wide.mapInPandas(grown, "tx long, ty long, label binary, rest binary"), "water-grown")
    apart = components(label, "rest", n, level).withColumnRenamed("label", "apart")

    def together(batches):
        for pdf in batches:
            yield pdf[["tx", "ty"]].assign(label=[(np.frombuffer(a, "<i8") + np.frombuffer(b, "<i8")).tobytes() for a, b in zip(pdf["label"], pdf["apart"], strict=True)])

    return label.join(apart, ["tx", "ty"]).mapInPandas(together, "tx long, ty long, label binary")


def assembled(textures: DataFrame, n: int, level: int = 9) -> DataFrame:
    """Built textures (tx, ty, texture) read back: squares (tx, ty, own, have) of n x n, uniform in degrees.

    The top image is decoded, turned the right way up, looked up row by row (its rows are uniform in the
    world grid, not in latitude) and taken back through the tone curve; exact black is no data.
    """
    inverse = np.array(colour.inverse_curve(colour.curve()), np.float32)

    def run(batches):
        from tilewright.sources.containers import parse_texture

        for pdf in batches:
            out = []
            for ty, data in zip(pdf["ty"], pdf["texture"], strict=True):
                t = parse_texture(bytes(data))
                w = t["width"]
                image = blocks.decode_bc1(t["payload"][: max(1, -(-w // 4)) ** 2 * 8], w, w)[::-1]
                lat = lambda y: 180 / grid.K * np.arctan(grid.K * (2 * y / 2**level - 1))
                north, south = lat(ty + 1), lat(ty)
                lats = north + (south - north) * (np.arange(n) + 0.5) / n
                at = (np.tan(lats * grid.K / 180) / grid.K + 1) / 2 * 2**level
                rows = np.clip(((ty + 1 - at) * w).astype(int), 0, w - 1)
                cols = np.clip(((np.arange(n) + 0.5) / n * w).astype(int), 0, w - 1)
                cut = image[np.ix_(rows, cols)]
                out.append((inverse[cut].astype("<f4").tobytes(), cut.any(2).astype(np.uint8).tobytes()))
            own, have = zip(*out, strict=True) if out else ((), ())
            yield pdf[["tx", "ty"]].assign(own=own, have=have)

    return textures.select("tx", "ty", "texture").mapInPandas(run, "tx long, ty long, own binary, have binary")


def referenced(squares: DataFrame, tiles: DataFrame, n: int, zoom: int, level: int = 9, side: int = 256) -> DataFrame:
    """Squares (tx, ty) with a reference picture sampled from low-zoom tiles: (tx, ty, ref, got), n x n, uniform in degrees.

    tiles: x, y, rgb (side x side) of one zoom. A square meets the tiles that its texels fall in by their
    keys; each sends only the texels that are asked of it. A texel whose tile is missing is not got.
    """
    lat = lambda y: 180 / grid.K * np.arctan(grid.K * (2 * y / 2**level - 1))

    def texels(tx: int, ty: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a square's columns and rows in pixels of the zoom."""
        north, south, size = lat(ty + 1), lat(ty), 2**zoom * side
        lons = ((tx + (np.arange(n) + 0.5) / n) / 2**level * 2 - 1) * 180
        lats = north + (south - north) * (np.arange(n) + 0.5) / n
        return (lons + 180) / 360 * size, (0.5 - np.log(np.tan(np.pi / 4 + np.radians(lats) / 2)) / (2 * np.pi)) * size

    def keys(batches):
        for pdf in batches:
            out = []
            for tx, ty in zip(pdf["tx"], pdf["ty"], strict=True):
                px, py = texels(tx, ty)
                out += [(tx, ty, int(x), int(y)) for x in np.unique(px // side) for y in np.unique(py // side)]
            yield type(pdf)(out, columns=["tx", "ty", "x", "y"])

    def pieces(batches):
        for pdf in batches:
            out = []
            for tx, ty, x, y, rgb in pdf[["tx", "ty", "x", "y", "rgb"]].itertuples(index=False):
                px, py = texels(tx, ty)
                cs, rs = np.flatnonzero(px // side == x), np.flatnonzero(py // side == y)
                a = np.frombuffer(rgb, np.uint8).reshape(side, side, 3)
                out.append((tx, ty, int(rs[0]), int(cs[0]), len(rs), len(cs), a[np.ix_((py[rs] - y * side).astype(int), (px[cs] - x * side).astype(int))].tobytes()))
            yield type(pdf)(out, columns=["tx", "ty", "row", "col", "rows", "cols", "part"])

    def joined(pdf):
        ref, got = np.zeros((n, n, 3), np.uint8), np.zeros((n, n), np.uint8)
        for r in pdf.itertuples():
            if r.part is not None:
                where = slice(r.row, r.row + r.rows), slice(r.col, r.col + r.cols)
                ref[where], got[where] = np.frombuffer(r.part, np.uint8).reshape(r.rows, r.cols, 3), 1
        return pdf.iloc[:1][["tx", "ty"]].assign(ref=[ref.tobytes()], got=[got.tobytes()])

    asked = squares.select("tx", "ty").mapInPandas(keys, "tx long, ty long, x long, y long")
    schema = "tx long, ty long, row int, col int, rows int, cols int, part binary"
    found = asked.join(tiles.select("x", "y", "rgb"), ["x", "y"]).mapInPandas(pieces, schema)
    missing = squares.selectExpr("tx", "ty", "0 AS row", "0 AS col", "0 AS rows", "0 AS cols", "CAST(NULL AS BINARY) AS part")
    return found.unionByName(missing).groupBy("tx", "ty").applyInPandas(joined, "tx long, ty long, ref binary, got binary")


def water_mask(ref: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Dark, not green, and no redder than blue, where there is imagery."""
    r, g, b = (ref[..., k].astype(int) for k in range(3))
    return (np.maximum(np.maximum(r, g), b) < 120) & (b >= g - 10) & (b >= r) & (have > 0)


def _box(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over k x k about each pixel but those within k // 2 of the edge."""
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1, *a.shape[2:]))
    s[1:, 1:] = a.cumsum(0, dtype=float).cumsum(1)
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]


def window(n: int, level: int, ty: int) -> int:
    """The odd number of texels that a window of local tone spans in a square, 3 at least."""
    lat = lambda y: 180 / grid.K * np.arctan(grid.K * (2 * y / 2**level - 1))
    k = max(3, int(WINDOW_KM / ((lat(ty + 1) - lat(ty)) * KM_PER_DEG / n)))
    return k if k % 2 else k + 1


def survey(squares: DataFrame, n: int, level: int, k: int, open_by: int = OPEN) -> tuple[DataFrame, DataFrame]:
    """Squares (tx, ty, own f4 x 3, wet u1) to their bodies' labels (tx, ty, label) and a row per body.

    Of a body: body, texels, km2, squares (how many it lies in), r, g, b (the tone that TARGET_SHARE of its
    texels' local means are below, in steps of 1 / STEPS) and water (whether that is blue enough). k: texels of
    a window, one for all squares.
    """
    squares = stored(squares.select("tx", "ty", "own", "wet"), "survey-squares")
    label = stored(bodies(squares, "wet", n, level, open_by), "survey-labels")
    h = k // 2
    tone = exchanged(squares, {"own": "<f4", "wet": "u1"}, n, h).join(label, ["tx", "ty"])

    def counted(batches):
        import pandas as pd

        for pdf in batches:
            parts = []
            for r in pdf.itertuples():
                wet = np.frombuffer(r.wet, "u1").reshape(n + 2 * h, n + 2 * h) > 0
                own = np.frombuffer(r.own, "<f4").reshape(n + 2 * h, n + 2 * h, 3)
                m = _box(wet[..., None].astype(np.float32), k)
                local = _box(own * wet[..., None], k) / np.maximum(m, 1e-6)
                body = np.frombuffer(r.label, "<i8").reshape(n, n)
                lat = lambda y: 180 / grid.K * np.arctan(grid.K * (2 * y / 2**level - 1))
                north, south = lat(r.ty + 1), lat(r.ty)
                lats = north + (south - north) * (np.arange(n) + 0.5) / n
                km2 = (north - south) * KM_PER_DEG / n * (360 / 2**level) / n * KM_PER_DEG * np.cos(np.radians(lats))
                y, x = np.nonzero(body)
                for c in range(3):
                    step = np.floor(local[y, x, c] * STEPS).astype(np.int64)
                    key, at = np.unique(np.stack([body[y, x], step], 1), axis=0, return_inverse=True)
                    parts.append(type(pdf)({"body": key[:, 0], "channel": c, "step": key[:, 1], "texels": np.bincount(at.ravel(), minlength=len(key)), "km2": np.bincount(at.ravel(), km2[y], len(key)), "tx": r.tx, "ty": r.ty}))
            if parts:
                yield pd.concat(parts)

    bins = tone.mapInPandas(counted, "body long, channel int, step long, texels long, km2 double, tx long, ty long")
    bins = stored(bins, "survey-bins")
    sizes = bins.where("channel = 0").groupBy("body").agg(F.sum("texels").alias("texels"), F.sum("km2").alias("km2"), F.count_distinct("tx", "ty").alias("squares"))
    steps = bins.groupBy("body", "channel", "step").agg(F.sum("texels").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("body", "channel").orderBy("step"))
    total = F.sum("n").over(Window.partitionBy("body", "channel"))
    steps = steps.withColumn("_share", upto / total).where(F.col("_share") > TARGET_SHARE)
    tones = steps.groupBy("body", "channel").agg((F.min("step") / STEPS).alias("tone"))
    tones = tones.groupBy("body").agg(*[F.max(F.when(F.col("channel") == c, F.col("tone"))).alias(name) for c, name in enumerate("rgb")])
    out = sizes.join(tones, "body").withColumn("water", F.col("b") - F.col("r") >= LEAST_BLUE)
    return label, out
