"""Queries of the kernels that work on whole images and on bytes: rows only, their own tests hold them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilewright.operators.raster import adjusted
from tilewright.plans.geometry import CELL_POINTS, CELLS, cell_points
from tilewright.plans.registry import query
from tilewright.plans.views import get
from tilewright.session import table


def _image(spark, d):
    """The test raster as one row of bytes (64 x 64)."""
    px = F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b", "have")))
    return get(spark, d, "raster").agg(px.alias("px"))


def _rgb(px) -> np.ndarray:
    return np.array([[p["r"], p["g"], p["b"]] for p in px], np.uint8).reshape(64, 64, 3)


def _pixels(a: np.ndarray):
    import pandas as pd

    h, w = a.shape[:2]
    y, x = np.mgrid[:h, :w]
    flat = a.reshape(h * w, -1).astype(np.int64)
    names = ["r", "g", "b"] if flat.shape[1] == 3 else ["v"]
    return pd.DataFrame({"y": y.ravel(), "x": x.ravel(), **{n: flat[:, k] for k, n in enumerate(names)}})


def _mapped(spark, d, f, schema: str):
    def run(batches):
        for pdf in batches:
            for px in pdf["px"]:
                yield f(px)

    return _image(spark, d).mapInPandas(run, schema)


RGB = "y long, x long, r long, g long, b long"
CLIP = "least(greatest({0}, 0.0::DOUBLE), 255.0::DOUBLE)".format
EACH = lambda f: ", ".join(f"{f(c)} AS {c}" for c in "rgb")


@query("img_brightness", "y b, x b, r b, g b, b b", f"SELECT y, x, {EACH(lambda c: f'least({c} + 20, 255)')} FROM raster")
def img_brightness(spark, d):
    return adjusted(get(spark, d, "raster"), brightness=20)


@query("img_contrast", "y b, x b, r b, g b, b b", f"SELECT y, x, {EACH(lambda c: f'floor({CLIP(f"({c} - 30)*255.0::DOUBLE/195")})')} FROM raster")
def img_contrast(spark, d):
    return adjusted(get(spark, d, "raster"), contrast=30)


@query("img_contrast_less", "y b, x b, r b, g b, b b", f"SELECT y, x, {EACH(lambda c: f'floor({CLIP(f"{c}*195.0::DOUBLE/255 + 30")})')} FROM raster")
def img_contrast_less(spark, d):
    return adjusted(get(spark, d, "raster"), contrast=-30)


@query("img_saturation", "y b, x b, r b, g b, b b", f"SELECT y, x, {EACH(lambda c: f'floor({CLIP(f"grey + ({c} - grey)*1.3::DOUBLE")})')} FROM (SELECT *, 0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b AS grey FROM raster)")
def img_saturation(spark, d):
    return adjusted(get(spark, d, "raster"), saturation=50)


@query("img_sharpen", "y b, x b, r b, g b, b b")
def img_sharpen(spark, d):
    from tilewright.operators import blocks

    return _mapped(spark, d, lambda px: _pixels(blocks.sharpen(_rgb(px), 60)), RGB)


@query("img_levels", "y b, x b, r b", "SELECT y, x, CAST(floor(least(greatest((r - 20)*255.0::DOUBLE/(235 - 20), 0), 255) + 0.5) AS BIGINT) AS r FROM raster")
def img_levels(spark, d):
    stretched = F.least(F.greatest((F.col("r") - 20) * 255.0 / (235 - 20), F.lit(0.0)), F.lit(255.0))
    return get(spark, d, "raster").select("y", "x", F.floor(stretched + 0.5).alias("r"))


@query("img_enlarge", "y b, x b, r b, g b, b b")
def img_enlarge(spark, d):
    from tilewright.operators import blocks

    return _mapped(spark, d, lambda px: _pixels(blocks.enlarge(_rgb(px), 4)), RGB)


@query("img_jpeg", "tile b, kind v, bytes b")
def img_jpeg(spark, d):
    """Tiles of the test raster as JPEG, told by their first bytes."""
    from tilewright.operators import blocks, jpegs
    from tilewright.operators.fetch import sniff

    t = get(spark, d, "raster").selectExpr("12L AS level", "x div 16 AS tx", "y div 16 AS ty", "y % 16 AS y", "x % 16 AS x", "r", "g", "b", "have")

    def run(batches):
        for pdf in batches:
            yield pdf[["tx", "ty"]].assign(content=[jpegs.jpeg(np.frombuffer(a, np.uint8).reshape(16, 16, 3)) for a in pdf["rgb"]])

    t = blocks.from_pixels(t, 16).mapInPandas(run, "tx long, ty long, content binary")
    return t.select((F.col("ty") * 4 + F.col("tx")).alias("tile"), sniff("content").alias("kind"), F.octet_length("content").alias("bytes"))


def _patches(px) -> tuple:
    """The test raster's colours, its land, and what clicks into its quarters take."""
    from tilewright.operators import labels

    a = _rgb(px)
    have, land = np.ones((64, 64), bool), a[..., 2] <= 210
    clicks = [(8, 8, 40.0), (48, 16, 20.0), (36, 36, 60.0), (44, 44, 60.0), (10, 10, 40.0)]
    return a, land, [labels.wand(a, have, x, y, tolerance) for x, y, tolerance in clicks]


@query("img_wand", "y b, x b, v b")
def img_wand(spark, d):
    return _mapped(spark, d, lambda px: _pixels(_patches(px)[2][0].astype(np.uint8)), "y long, x long, v long").where("v > 0")


@query("img_labels", "label b, pixels b")
def img_labels(spark, d):
    from tilewright.operators import labels

    def f(px):
        a, land, masks = _patches(px)
        return _pixels(labels.patches(masks, land, a)[..., None])

    return _mapped(spark, d, f, "y long, x long, v long").where("v > 0").groupBy(F.col("v").alias("label")).agg(F.count(F.lit(1)).alias("pixels"))


@query("img_prune", "y b, x b, v b")
def img_prune(spark, d):
    from tilewright.operators import labels

    return _mapped(spark, d, lambda px: _pixels(labels.pruned((_rgb(px)[..., 1] < 125).astype(np.int32), np.ones((64, 64), bool), _rgb(px))[..., None]), "y long, x long, v long").where("v > 0")


@query("img_water_bodies", "body b, pixels b")
def img_water_bodies(spark, d):
    from tilewright.operators import labels

    def f(px):
        a = _rgb(px).astype(int)
        return _pixels(labels.water_bodies((a[..., 2] >= a[..., 0]) & (a[..., 2] >= a[..., 1] - 10), 2)[..., None])

    return _mapped(spark, d, f, "y long, x long, v long").where("v > 0").groupBy(F.col("v").alias("body")).agg(F.count(F.lit(1)).alias("pixels"))


@query("img_water_survey", "body b, km2 d, r d, g d, b d")
def img_water_survey(spark, d):
    """Mask, bodies by their runs, targets of bodies."""
    from tilewright.functions.colour import is_water
    from tilewright.operators import quality, rasters_more

    t = get(spark, d, "raster").withColumn("water", is_water("r", "g", "b", "have"))
    runs = rasters_more.components(t, "water")
    texels = runs.select("label", "y", F.explode(F.sequence("x0", "x1")).alias("x")).join(t, ["y", "x"])
    return quality.body_targets(texels.select(F.col("label").alias("body"), "r", "g", "b", F.lit(0.01).alias("km2")))


@query("img_water_field", "y b, x b, scale d, offset d")
def img_water_field(spark, d):
    """A square's correction: local means over the mask, feathered weights, targets; identity texels are left out."""
    from tilewright.functions.colour import is_water
    from tilewright.operators import raster, water

    t = get(spark, d, "raster").withColumn("m", is_water("r", "g", "b", "have").cast("int")).withColumn("v", F.col("r") * F.col("m"))
    t = raster.box_mean(raster.box_mean(t, "v", 5, 64, "vm"), "m", 5, 64, "mm")
    t = raster.box_mean(t, "mm", 5, 64, "soft")
    local = F.when(F.col("mm") > 1e-6, F.col("vm") / F.col("mm")).otherwise(0.0)
    t = t.select("y", "x", local.alias("local"), F.lit(20.0).alias("target"), "soft", F.col("g").cast("double").alias("ref"), F.col("g").cast("double").alias("ref_local"))
    return water.correction(t).where("scale <> 1 OR offset <> 0")


@query("img_level", "p b, q b, step d")
def img_level(spark, d):
    """Medians of border steps by Spark, the few unknowns by least squares on the driver."""
    from tilewright.operators import quality

    pairs = quality.patch_offsets(get(spark, d, "raster").selectExpr("y", "x", "(y div 16)*4 + x div 16 AS label", "r", "g", "b"))
    found = quality.solve_offsets([r.asDict() for r in pairs.collect()], 0)  # one row per pair of sixteen patches
    return spark.createDataFrame([(0, k, v[0]) for k, v in found.items()], "p long, q long, step double")


@query("img_preview", "bytes b, crc b")
def img_preview(spark, d):
    from tilewright.functions.colour import curve
    from tilewright.operators import blocks

    def f(px):
        import zlib

        import pandas as pd

        a = _rgb(px)
        out = blocks.png(blocks.halve(np.concatenate([a, np.array(curve(), np.uint8)[a]], 1)))
        return pd.DataFrame({"bytes": [len(out)], "crc": [zlib.crc32(out)]})

    return _mapped(spark, d, f, "bytes long, crc long")


@query("src_tft", "place v, depth b, kind v, name v", """SELECT n_name || p AS place, d AS depth, k AS kind, n AS name FROM nation CROSS JOIN (VALUES
 ('/0', 0, 'b5fe24c7b73cebb7', 'c3e386cb206d5fec'), ('/0.0', 1, 'b5fe24c7b73cebb7', 'ce25086b845bd426'),
 ('/0.0.0', 2, 'bc628ed22a7082f3', 'SizeUncompressed'), ('/0.0.1', 2, 'bc628ed22a7082f3', 'SizeCompressed'), ('/0.0.2', 2, '9e8caf8498703ec2', 'ChecksumUncompressed'),
 ('/0.0.3', 2, '9e8caf8498703ec2', 'ChecksumCompressed'), ('/0.0.4', 2, '9e76560202020202', 'Compressed')) t(p, d, k, n)""")
def src_tft(spark, d):
    """Landmark trees, one per nation, built, walked again, and told by the names of their fields where these are known."""
    from tilewright.session import table
    from tilewright.sources import containers

    def run(batches):
        for pdf in batches:
            yield pdf.rename(columns={"n_name": "path"}).assign(content=[containers.tree_file(n.encode() * 40) for n in pdf["n_name"]])

    known = F.create_map(*[F.lit(x) for n in containers.TREE_FIELDS for x in (containers.name_hash(n).hex(), n)])
    t = containers.nodes(table(spark, d, "nation").select("n_name").mapInPandas(run, "path string, content binary"))
    return t.select(F.concat_ws("/", "path", "place").alias("place"), "depth", "kind", F.coalesce(known[F.col("name")], "name").alias("name"))


@query("src_awfx", "s_suppkey b, size b, w d, mean d")
def src_awfx(spark, d):
    """Correction fields, built and read again."""
    from tilewright.sources import containers

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                data = containers.field_file(r.w, r.e, r.n, r.s, np.full((8, 8), 0.5), np.full((8, 8, 3), float(r.s_suppkey % 50)))
                f = containers.parse_field(data)
                rows.append((r.s_suppkey, f["size"], f["w"], float(f["offset"].mean())))
            yield type(pdf)(rows, columns=["s_suppkey", "size", "w", "mean"])

    return get(spark, d, "geo_box").mapInPandas(run, "s_suppkey long, size long, w double, mean double")


@query("src_awft", "s_suppkey b, n d, mean d")
def src_awft(spark, d):
    """Target fields, built and read again."""
    from tilewright.sources import containers

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                f = containers.parse_targets(containers.target_file(r.w, r.e, r.n, r.s, np.full((3, 5, 3), float(r.s_suppkey % 50))))
                rows.append((r.s_suppkey, f["n"], float(f["tone"].mean())))
            yield type(pdf)(rows, columns=["s_suppkey", "n", "mean"])

    return get(spark, d, "geo_box").mapInPandas(run, "s_suppkey long, n double, mean double")


@query("geo_box_distance", "event_id b, km d", f"SELECT event_id, min(sqrt(pow(greatest(x - px, 0, px - x - 1)*11.132::DOUBLE, 2) + pow(greatest(y - py, 0, py - y - 1)*11.057::DOUBLE, 2))) AS km FROM {CELL_POINTS} CROSS JOIN {CELLS} GROUP BY event_id HAVING km < 30")
def geo_box_distance(spark, d):
    """How far the nearest empty cell is, for points with one within 30 km."""
    from tilewright.operators.edges import box_distance

    points, cells = cell_points(spark, d)
    return box_distance(points, ["event_id"], cells, 11.132, 11.057, 30.0)


@query("img_stitch", "tile_x b, tile_y b, y b, x b, r b", "SELECT x // 16 AS tile_x, y // 16 AS tile_y, y, x, r FROM raster WHERE NOT (x // 16 = 1 AND y // 16 = 2)")
def img_stitch(spark, d):
    """Virtual: a pixel of the stitched image joins its tile by key; nothing is pasted. One tile is missing."""
    t = get(spark, d, "raster").selectExpr("x div 16 AS tile_x", "y div 16 AS tile_y", "y % 16 AS row", "x % 16 AS col", "r")
    tiles = t.where("NOT (tile_x = 1 AND tile_y = 2)")
    grid = spark.range(64 * 64).selectExpr("id div 64 AS y", "id % 64 AS x", "(id % 64) div 16 AS tile_x", "(id div 64) div 16 AS tile_y", "(id div 64) % 16 AS row", "id % 16 AS col")
    return grid.join(tiles, ["tile_x", "tile_y", "row", "col"])


@query("src_image_tile_xml", "tile_x b, tile_y b, again l", "SELECT DISTINCT tile_x, tile_y, true AS again FROM tile_image")
def src_image_tile_xml(spark, d):
    """A record per tile as XML text, parsed again."""
    t = get(spark, d, "tile_image").select("tile_x", "tile_y").distinct()
    xml = F.to_xml(F.struct(F.lit("src").alias("Source"), F.col("tile_x").alias("TileX"), F.col("tile_y").alias("TileY")))
    back = F.from_xml(xml, "Source STRING, TileX BIGINT, TileY BIGINT")
    return t.select("tile_x", "tile_y", ((back["TileX"] == F.col("tile_x")) & (back["TileY"] == F.col("tile_y"))).alias("again"))
