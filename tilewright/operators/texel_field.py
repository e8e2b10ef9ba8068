"""Signed distance to lines as stored fields: texels in blocks, with least and most of each tile and block.

A field lies over a box, in texels of a given size and with one texel of slack all round; a box that would
have more than MOST_TEXELS gets larger ones. It is kept in blocks of BLOCK x BLOCK texels, one row each.
A block also has the first column and row of its neighbours, so that any interpolation needs one block
only, and the range of each of its tiles of TILE x TILE texels, and of itself: an index of two levels for
the range under a box.

Build. Segments meet blocks by cells of their widened boxes. In a block the nearest segments are found
from coarse to fine: for a tile, then for a part of it, only those segments stay that can be nearest to
some texel, told by the distance to the middle and the half diagonal; the rest are measured. Where more
than SIFTED segments are near, a tree (operators.nearest) finds them instead. The side is
the parity of crossings east of a texel. Those east of the block are counted once a row of the block,
by bands of latitude; those in it by running sums along its rows. So no texel meets a segment that is far.

A coast has its land to the east (negative is land); rings are islands, each with a parity of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators import lines, rangejoin
from tilewright.operators.nearest import Tree

TEXEL_KM, MOST_TEXELS = 0.03, 1 << 24
BLOCK, TILE, PART = 256, 32, 8
GRID = ["west", "south", "lon_step", "lat_step", "width", "height"]
COAST = -1
#: Distances on the local plane do not add up exactly; what is left out is farther by this share, and this many km.
SLACK, SLACK_KM = 0.01, 0.02
#: Segments near a block up to which they are sifted; more go into a tree. Points that are looked up in a block at a time.
SIFTED, POINTS = 1_000, 250_000


def grids(boxes: DataFrame, texel_km: float = TEXEL_KM, most: int = MOST_TEXELS) -> DataFrame:
    """boxes (w, e, s, n) with the origin, steps and size of their fields."""
    w, e, s, n = F.least("w", "e"), F.greatest("w", "e"), F.least("s", "n"), F.greatest("s", "n")
    east = lines.KM_EAST * F.cos(F.radians((s + n) / 2))
    size = lambda span, km, texel: F.ceil(span * km / texel) + 3
    count = lambda t: size(e - w, east, t) * size(n - s, F.lit(lines.KM_NORTH), t)
    coarser = lambda t, _: F.when(count(t) > most, t * F.sqrt(count(t) / most) * 1.01).otherwise(t)
    out = boxes.withColumn("texel_km", F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(texel_km), coarser))
    out = out.withColumns({"lon_step": F.col("texel_km") / east, "lat_step": F.col("texel_km") / lines.KM_NORTH})
    width, height = F.ceil((e - w) / F.col("lon_step")) + 3, F.ceil((n - s) / F.col("lat_step")) + 3
    return out.withColumns({"west": w - F.col("lon_step"), "south": s - F.col("lat_step"), "width": width, "height": height})


def _blocks(fields: DataFrame, key: list[str]) -> DataFrame:
    """A row per block: its number (bi, bj), columns nx and rows ny, its first texel's place and its box."""
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col(c) - 1) / BLOCK), F.lit(1)) - 1))
    t = fields.select(*key, *GRID, numbers("width").alias("bi")).select("*", numbers("height").alias("bj"))
    side = lambda b, n: F.least(F.lit(BLOCK + 1), F.col(n) - F.col(b) * BLOCK)
    t = t.withColumns({"nx": side("bi", "width").cast("int"), "ny": side("bj", "height").cast("int")})
    t = t.withColumns({"lon0": F.col("west") + F.col("bi") * BLOCK * F.col("lon_step"), "lat0": F.col("south") + F.col("bj") * BLOCK * F.col("lat_step")})
    return t.withColumns({"lon1": F.col("lon0") + (F.col("nx") - 1) * F.col("lon_step"), "lat1": F.col("lat0") + (F.col("ny") - 1) * F.col("lat_step")})


def _distance(lon, lat, seg) -> np.ndarray:
    """As lines.segment_distance; seg: a_lon, a_lat, b_lon, b_lat."""
    a_lon, a_lat, b_lon, b_lat = seg
    east = lambda y: lines.KM_EAST * np.cos(np.radians(y))
    px, py = (lon - a_lon) * east((lat + a_lat) / 2), (lat - a_lat) * lines.KM_NORTH
    dx, dy = (b_lon - a_lon) * east((b_lat + a_lat) / 2), (b_lat - a_lat) * lines.KM_NORTH
    n = dx * dx + dy * dy
    t = np.where(n == 0, 0.0, np.clip((px * dx + py * dy) / np.where(n == 0, 1.0, n), 0.0, 1.0))
    return np.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)


def _squares(nx: int, ny: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """First columns and rows of the squares of a block, row by row."""
    x, y = np.meshgrid(np.arange(0, nx, side), np.arange(0, ny, side))
    return x.ravel(), y.ravel()


def _nearest(lons: np.ndarray, lats: np.ndarray, segs: np.ndarray, clamp_km: float) -> np.ndarray:
    """The distance of each texel (lats x lons) to the nearest segment (columns of segs), at most the clamp."""
    nx, ny = len(lons), len(lats)
    out = np.full((ny, nx), clamp_km)
    if not segs.shape[1]:
        return out
    if segs.shape[1] > SIFTED:
        # sifting holds every tile against every segment, and keeps all that lie at almost one distance; texels tile by tile
        x, y = (a.ravel() for a in np.meshgrid(np.arange(nx), np.arange(ny)))
        order = np.lexsort((x, y, x // TILE, y // TILE))
        out.ravel()[order] = Tree(segs).nearest(lons[x[order]], lats[y[order]], clamp_km)[0]
        return out

    def kept(square: np.ndarray, seg: np.ndarray, x0: np.ndarray, y0: np.ndarray, side: int) -> np.ndarray:
        """Of pairs (square, segment), in order of the squares, those where the segment may be nearest to a texel."""
        x1, y1 = np.minimum(x0 + side, nx) - 1, np.minimum(y0 + side, ny) - 1
        lon, lat = (lons[x0] + lons[x1]) / 2, (lats[y0] + lats[y1]) / 2
        half = np.hypot((lons[x1] - lons[x0]) * lines.KM_EAST * np.cos(np.radians(lat)), (lats[y1] - lats[y0]) * lines.KM_NORTH) / 2
        km = _distance(lon[square], lat[square], segs[:, seg])
        first = np.flatnonzero(np.r_[True, square[1:] != square[:-1]])
        least = np.repeat(np.minimum.reduceat(km, first), np.diff(np.r_[first, len(km)]))
        return km * (1 - SLACK) - 2 * half[square] - SLACK_KM <= np.minimum(least, clamp_km + half[square])

    x0, y0 = _squares(nx, ny, TILE)
    tile, seg = (a.ravel() for a in np.meshgrid(np.arange(len(x0)), np.arange(segs.shape[1]), indexing="ij"))
    k = kept(tile, seg, x0, y0, TILE)
    tile, seg = tile[k], seg[k]
    # the parts of each tile that lie in the block, each with the tile's segments
    px, py = _squares(nx, ny, PART)
    of_tile = (py // TILE) * -(-nx // TILE) + px // TILE
    counts = np.bincount(tile, minlength=len(x0))
    begins = np.cumsum(counts) - counts
    size = counts[of_tile]
    part = np.repeat(np.arange(len(px)), size)
    seg = seg[np.repeat(begins[of_tile] - (np.cumsum(size) - size), size) + np.arange(len(part))] if len(part) else seg[:0]
    if not len(part):
        return out
    k = kept(part, seg, px, py, PART)
    part, seg = part[k], seg[k]
    # texels of a part, those beyond the block's end told twice
    dx, dy = (a.ravel() for a in np.meshgrid(np.arange(PART), np.arange(PART)))
    for a in range(0, len(part), 20_000):  # bounded memory
        b = min(len(part), a + 20_000)
        i, j = np.minimum(px[part[a:b], None] + dx, nx - 1), np.minimum(py[part[a:b], None] + dy, ny - 1)
        s = segs[:, seg[a:b], None]
        km = _distance(lons[i], lats[j], s)
        first = np.flatnonzero(np.r_[True, part[a + 1 : b] != part[a : b - 1]])
        least = np.minimum.reduceat(km, first, axis=0)
        np.minimum.at(out, (j[first], i[first]), least)
    return out


def _land(lons: np.ndarray, lats: np.ndarray, segs: np.ndarray, line: np.ndarray, odd_rows: dict[int, np.ndarray], has_coast: bool) -> np.ndarray:
    """Which texels are land. odd_rows: for a line, the rows with an odd number of its crossings east of the block."""
    a_lon, a_lat, b_lon, b_lat = segs
    found = []
    for a in range(0, max(len(a_lat), 1), 10_000):  # bounded memory
        z = slice(a, a + 10_000)
        k, j = np.nonzero((a_lat[z, None] <= lats) != (b_lat[z, None] <= lats))
        found.append((k + a, j))
    k, j = (np.concatenate(x) for x in zip(*found, strict=True))
    at = a_lon[k] + (lats[j] - a_lat[k]) / (b_lat[k] - a_lat[k]) * (b_lon[k] - a_lon[k])
    upto = np.searchsorted(lons, at, side="left")  # texels west of the crossing
    here = (at <= lons[-1]) & (upto > 0)
    k, j, upto = k[here], j[here], upto[here]
    land = np.zeros((len(lats), len(lons)), bool)
    for name in sorted({*line[k].tolist(), *odd_rows, *([COAST] if has_coast else [])}):
        mine = line[k] == name
        count = np.zeros((len(lats), len(lons)), np.int64)
        np.add.at(count, (j[mine], upto[mine] - 1), 1)
        odd = np.cumsum(count[:, ::-1], axis=1)[:, ::-1] % 2 == 1
        if name in odd_rows:
            odd[odd_rows[name]] ^= True
        land |= ~odd if name == COAST else odd
    return land


def _ranges(field: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most of each tile, row by row; of the first BLOCK columns and rows."""
    field = field[:BLOCK, :BLOCK]
    rows, cols = np.arange(0, field.shape[0], TILE), np.arange(0, field.shape[1], TILE)
    f = lambda pick: pick.reduceat(pick.reduceat(field, rows, axis=0), cols, axis=1).ravel()
    return f(np.minimum), f(np.maximum)


FIELD = "bi long, bj long, nx int, ny int, west double, south double, lon_step double, lat_step double, width long, height long, least float, most float, tile_least binary, tile_most binary, field binary"


def build(boxes: DataFrame, key: list[str], coast: DataFrame | None, rings: DataFrame | None, margin_km: float = lines.MARGIN_KM, texel_km: float = TEXEL_KM, most: int = MOST_TEXELS) -> DataFrame:
    """The field of each box (key, w, e, s, n), a row per block: key and the columns of FIELD.

    coast: a_lon, a_lat, b_lon, b_lat, carried on beyond the boxes (lines.extended); rings: the same and
    `line`, closed. Distances are clamped at twice the margin and a kilometre. Write what it returns; it is
    read more than once. `field` has ny x nx float32, row 0 in the south.
    """
    clamp = 2 * margin_km + 1
    columns = ["a_lon", "a_lat", "b_lon", "b_lat"]
    parts = [p.select(F.lit(COAST).cast("long").alias("line"), *columns) if name == "coast" else p.select(F.col("line").cast("long"), *columns) for name, p in (("coast", coast), ("rings", rings)) if p is not None]
    segs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    blocks = _blocks(grids(boxes, texel_km, most), key)
    at = [*key, "bi", "bj"]

    north = F.lit(clamp / lines.KM_NORTH)
    east = F.lit(clamp) / (lines.KM_EAST * F.cos(F.radians(F.least(F.greatest(F.abs("lat0"), F.abs("lat1")) + north, F.lit(89.0)))))
    wide = blocks.select(*at, (F.col("lon0") - east).alias("w"), (F.col("lon1") + east).alias("e"), (F.col("lat0") - north).alias("s"), (F.col("lat1") + north).alias("n"))
    seg_box = segs.select("line", *columns, F.least("a_lon", "b_lon").alias("w"), F.greatest("a_lon", "b_lon").alias("e"), F.least("a_lat", "b_lat").alias("s"), F.greatest("a_lat", "b_lat").alias("n"))
    near = rangejoin.box_join(wide, seg_box, 0.25).select(*[f"a.{c}" for c in at], "b.line", *[f"b.{c}" for c in columns])

    rows = blocks.select(*at, F.col("lon1").alias("lon"), F.posexplode(F.transform(F.sequence(F.lit(0), F.col("ny") - 1), lambda j: F.col("lat0") + j * F.col("lat_step"))).alias("j", "lat"))
    crossed = lines._crossed(rows, [*at, "j"], segs).groupBy(*at, "line", "j").count().where("count % 2 = 1")
    east_of = crossed.groupBy(*at, "line").agg(F.collect_list("j").alias("rows"))  # at most a block's rows

    # one frame of three kinds of rows, so that a single shuffle brings a block together
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    none = [empty(c, "double") for c in columns]
    rest = ["nx", "ny", *GRID, "lon0", "lat0"]
    kinds = dict(blocks.dtypes)
    no_block = [empty(c, kinds[c]) for c in rest]
    rows_of = lambda t, *c: t.select(*at, *c)
    together = rows_of(blocks, F.lit(0).alias("kind"), empty("line", "long"), *none, empty("rows", "array<int>"), *rest)
    together = together.unionByName(rows_of(near, F.lit(1).alias("kind"), "line", *columns, empty("rows", "array<int>"), *no_block))
    together = together.unionByName(rows_of(east_of, F.lit(2).alias("kind"), "line", *none, F.col("rows").cast("array<int>"), *no_block))
    has_coast, n_key = coast is not None, len(key)

    def run(group, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        of = lambda kind: table.filter(pc.equal(table.column("kind"), kind))
        b = of(0).to_pylist()[0]
        here, beside = of(1), of(2)
        segs = np.array([here.column(c).to_numpy() for c in columns]).reshape(4, -1)
        odd = {r["line"]: np.array(r["rows"]) for r in beside.select(["line", "rows"]).to_pylist()}
        lons, lats = b["lon0"] + np.arange(b["nx"]) * b["lon_step"], b["lat0"] + np.arange(b["ny"]) * b["lat_step"]
        km = _nearest(lons, lats, segs, clamp)
        land = _land(lons, lats, segs, here.column("line").to_numpy(), odd, has_coast)
        field = np.where(land, -km, km).astype("<f4")
        low, high = _ranges(field)
        # what lies beyond BLOCK is the neighbour's, unless there is none
        own = field[: None if (b["bj"] + 1) * BLOCK >= b["height"] - 1 else BLOCK, : None if (b["bi"] + 1) * BLOCK >= b["width"] - 1 else BLOCK]
        values = {k: [v.as_py()] for k, v in zip(key, group[:n_key], strict=True)} | {c: [b[c]] for c in ("bi", "bj", "nx", "ny", *GRID)}
        values |= {c: pa.array([b[c]], pa.int32()) for c in ("nx", "ny")}
        values |= {"least": pa.array([float(own.min())], pa.float32()), "most": pa.array([float(own.max())], pa.float32()), "tile_least": [low.tobytes()], "tile_most": [high.tobytes()], "field": [field.tobytes()]}
        return pa.table(values)

    types = dict(boxes.dtypes)
    # by number: these rows are few bytes and much work, so that partitions must not be put together by their size
    dealt = together.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *at)
    return dealt.groupBy(*at).applyInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in key], FIELD]))


def _place(c: str, origin: str, step: str) -> Column:
    return (F.col(c) - F.col(origin)) / F.col(step)


def at_points(points: DataFrame, field: DataFrame, key: list[str], value: str = "km") -> DataFrame:
    """points (key, lon, lat, any columns) with the field's value there, bilinear; beyond its edge the nearest."""
    grid = field.where("bi = 0 and bj = 0").select(*key, *GRID)
    held = [c for c in points.columns if c not in key]
    inside = lambda x, n: F.least(F.greatest(x, F.lit(0.0)), (F.col(n) - 1).cast("double"))
    p = points.join(grid, key) if key else points.crossJoin(F.broadcast(grid))  # without a key there is one field
    p = p.withColumns({"_x": inside(_place("lon", "west", "lon_step"), "width"), "_y": inside(_place("lat", "south", "lat_step"), "height")})
    p = p.withColumns({"_i": F.least(F.floor("_x"), F.col("width") - 2), "_j": F.least(F.floor("_y"), F.col("height") - 2)})
    p = p.select(*key, *held, "_x", "_y", "_i", "_j", F.floor(F.col("_i") / BLOCK).alias("bi"), F.floor(F.col("_j") / BLOCK).alias("bj"))
    types, at = dict(p.dtypes), [*key, "bi", "bj"]

    def run(_, rows, blocks):
        import pyarrow as pa

        out = rows.select([*key, *held])
        if not rows.num_rows:
            return out.append_column(value, pa.array([], pa.float64()))
        b = blocks.select(["bi", "bj", "nx", "ny", "field"]).to_pylist()[0]
        f = np.frombuffer(b["field"], "<f4").reshape(b["ny"], b["nx"]).astype(float)
        x, y, i, j = (rows.column(c).to_numpy() for c in ("_x", "_y", "_i", "_j"))
        u, v = x - i, y - j
        i, j = i - b["bi"] * BLOCK, j - b["bj"] * BLOCK
        lower = f[j, i] + (f[j, i + 1] - f[j, i]) * u
        upper = f[j + 1, i] + (f[j + 1, i + 1] - f[j + 1, i]) * u
        return out.append_column(value, pa.array(lower + (upper - lower) * v))

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in [*key, *held]], f"`{value}` double"])
    p, large = rangejoin.in_parts(p, at, held, POINTS)
    blocks = rangejoin.for_parts(field.select(*at, "nx", "ny", "field"), at, large)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda t: t.repartition(n, *at, "_part").groupBy(*at, "_part")
    return dealt(p).cogroup(dealt(blocks)).applyInArrow(run, schema)


def _spanned(boxes: DataFrame, field: DataFrame, key: list[str], names: list[str]) -> tuple[DataFrame, Column]:
    """Boxes with the texels (_i0 to _i1, _j0 to _j1) that a lookup in them may touch, a row for each block that owns one; whether they cover it."""
    grid = field.where("bi = 0 and bj = 0").select(*key, *GRID)
    b = boxes.join(grid, key) if key else boxes.crossJoin(F.broadcast(grid))  # without a key there is one field
    cut = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.col(n) - 1)
    low = lambda c, origin, step, n: cut(F.floor(_place(c, origin, step)), n)
    high = lambda c, origin, step, n: cut(F.floor(_place(c, origin, step)) + 1, n)
    b = b.withColumns({
        "_i0": low("w", "west", "lon_step", "width"), "_i1": high("e", "west", "lon_step", "width"),
        "_j0": low("s", "south", "lat_step", "height"), "_j1": high("n", "south", "lat_step", "height"),
    })
    last = lambda n: F.greatest(F.ceil((F.col(n) - 1) / BLOCK), F.lit(1)) - 1
    span = lambda a, z, n: F.explode(F.sequence(F.least(F.floor(F.col(a) / BLOCK), last(n)), F.least(F.floor(F.col(z) / BLOCK), last(n))))
    b = b.select(*key, *names, "_i0", "_i1", "_j0", "_j1", "width", "height", span("_i0", "_i1", "width").alias("bi"))
    b = b.select("*", span("_j0", "_j1", "height").alias("bj"))
    # a block owns BLOCK columns and rows, the last one also the field's last
    ends = lambda c, n: F.when(F.col(c) == last(n), F.col(n) - 1).otherwise((F.col(c) + 1) * BLOCK - 1)
    whole = (F.col("_i0") <= F.col("bi") * BLOCK) & (F.col("_i1") >= ends("bi", "width")) & (F.col("_j0") <= F.col("bj") * BLOCK) & (F.col("_j1") >= ends("bj", "height"))
    return b, whole


def blocks_under(boxes: DataFrame, field: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """The blocks that lookups in boxes (key, names, w, e, s, n) need: names, and of each block its grid, first texel (i0, j0) and bytes."""
    at = [*key, "bi", "bj"]
    b = _spanned(boxes, field, key, names)[0].select(*key, *names, "bi", "bj")
    return b.join(field.select(*at, "nx", "ny", *GRID, "field"), at).withColumns({"i0": F.col("bi") * BLOCK, "j0": F.col("bj") * BLOCK}).drop(*at)


def under_boxes(boxes: DataFrame, field: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Least and most that a lookup within a box (key, names, w, e, s, n) can give: names, least, most.

    Blocks that a box covers give their own range and are not opened; the others are, and of them the
    texels of tiles that it covers are not looked at.
    """
    b, whole = _spanned(boxes, field, key, names)
    b = b.withColumn("_whole", whole).drop("width", "height")
    at = [*key, "bi", "bj"]
    covered = b.where("_whole").join(field.select(*at, "least", "most"), at).select(*names, "least", "most")

    def run(_, rows, blocks):
        import pyarrow as pa

        out = rows.select(names)
        if not rows.num_rows:
            return out.append_column("least", pa.array([], pa.float32())).append_column("most", pa.array([], pa.float32()))
        t = blocks.select(["bi", "bj", "nx", "ny", "tile_least", "tile_most", "field"]).to_pylist()[0]
        f = np.frombuffer(t["field"], "<f4").reshape(t["ny"], t["nx"])
        across = len(range(0, min(t["nx"], BLOCK), TILE))
        low, high = (np.frombuffer(t[c], "<f4").reshape(-1, across) for c in ("tile_least", "tile_most"))
        least, most = [], []
        for i0, i1, j0, j1 in zip(*[rows.column(c).to_pylist() for c in ("_i0", "_i1", "_j0", "_j1")], strict=True):
            a, z = max(i0 - t["bi"] * BLOCK, 0), min(i1 - t["bi"] * BLOCK, t["nx"] - 1)
            c, y = max(j0 - t["bj"] * BLOCK, 0), min(j1 - t["bj"] * BLOCK, t["ny"] - 1)
            # whole tiles in the middle by their ranges, the frame around them by texels
            ta, tz, tc, ty = -(-a // TILE), min((z + 1) // TILE, across), -(-c // TILE), min((y + 1) // TILE, len(low))
            strips = [f[c : y + 1, a : z + 1]]
            found = []
            if ta < tz and tc < ty:
                found = [(low[tc:ty, ta:tz].min(), high[tc:ty, ta:tz].max())]
                strips = [f[c : tc * TILE, a : z + 1], f[ty * TILE : y + 1, a : z + 1], f[tc * TILE : ty * TILE, a : ta * TILE], f[tc * TILE : ty * TILE, tz * TILE : z + 1]]
            found += [(s.min(), s.max()) for s in strips if s.size]
            least.append(float(min(x for x, _ in found)))
            most.append(float(max(x for _, x in found)))
        return out.append_column("least", pa.array(least, pa.float32())).append_column("most", pa.array(most, pa.float32()))

    types = dict(boxes.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in names], "least float, most float"])
    part = b.where("not _whole").select(*at, *[c for c in names if c not in at], "_i0", "_i1", "_j0", "_j1")
    opened = part.groupBy(*at).cogroup(field.select(*at, "nx", "ny", "tile_least", "tile_most", "field").groupBy(*at)).applyInArrow(run, schema)
    return covered.unionByName(opened).groupBy(*names).agg(F.min("least").alias("least"), F.max("most").alias("most"))
