"""Queries of the raster and image operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import quality, raster, rasters_more
from tilewright.plans.aggregations import LAB
from tilewright.plans.registry import query
from tilewright.plans.scalars import CURVE, MY
from tilewright.plans.views import get
from tilewright.session import table
from tilewright.plans.windows import MORPH


@query("img_sample_tile", "cy b, cx b, r b, g b, b b", f"""SELECT cy, cx, list_extract({CURVE}, CAST(r + 1 AS BIGINT)) AS r, list_extract({CURVE}, CAST(g + 1 AS BIGINT)) AS g, list_extract({CURVE}, CAST(b + 1 AS BIGINT)) AS b FROM (SELECT i // 48 AS cy, i % 48 AS cx FROM range(2304) t(i)) JOIN raster ON x = CAST(floor(cx*1.25::DOUBLE) AS BIGINT) AND y = CAST(floor(cy*1.3::DOUBLE + 0.5) AS BIGINT) WHERE have AND cx + cy > 10 AND NOT (r = 0 AND g = 0 AND b = 0)""")
def img_sample_tile(spark, d):
    from tilewright.functions import colour

    c = spark.range(2304).select(F.expr("id div 48").alias("cy"), (F.col("id") % 48).alias("cx")).where("cx + cy > 10")  # the cut prunes before the lookup
    t = rasters_more.sampled(c, get(spark, d, "raster"), F.col("cx") * 1.25, F.col("cy") * 1.3 + 0.5, 64, 64).withColumn("priority", F.lit(0))
    t = rasters_more.first_source(t, ["cy", "cx"], black_is_missing=True)
    return t.select("cy", "cx", *[colour.apply_curve(k, colour.curve()).alias(k) for k in "rgb"])


@query("img_row_range", "ty b, r0 b, r1 b", f"SELECT ty, CAST(floor(({MY('-32 - ty*0.1::DOUBLE')} - {MY('-32.0::DOUBLE')})*1000/({MY('-33.0::DOUBLE')} - {MY('-32.0::DOUBLE')})) AS BIGINT) AS r0, CAST(floor(({MY('-32 - (ty + 1)*0.1::DOUBLE + 0.00001::DOUBLE')} - {MY('-32.0::DOUBLE')})*1000/({MY('-33.0::DOUBLE')} - {MY('-32.0::DOUBLE')})) AS BIGINT) AS r1 FROM (SELECT s_suppkey % 500 AS ty FROM supplier)")
def img_row_range(spark, d):
    from tilewright.functions.mercator import source_row

    row = lambda lat: F.floor(source_row(lat, F.lit(-32.0), F.lit(-0.001), F.lit(1000)))
    t = table(spark, d, "supplier").select((F.col("s_suppkey") % 500).alias("ty"))
    return t.select("ty", row(-32 - F.col("ty") * 0.1).alias("r0"), row(-32 - (F.col("ty") + 1) * 0.1 + 0.00001).alias("r1"))


@query("img_flip_rows", "y b, x b, r b", "SELECT 63 - y AS y, x, r FROM raster")
def img_flip_rows(spark, d):
    return rasters_more.flip_rows(get(spark, d, "raster"), 64)


@query("img_fill_alpha", "y b, x b, r b, g b, b b", "SELECT y, x, CASE WHEN have THEN r ELSE 10 END AS r, CASE WHEN have THEN g ELSE 20 END AS g, CASE WHEN have THEN b ELSE 30 END AS b FROM raster")
def img_fill_alpha(spark, d):
    return get(spark, d, "raster").select("y", "x", *[F.when(F.col("have"), F.col(c)).otherwise(v).alias(c) for c, v in zip("rgb", (10, 20, 30), strict=True)])


@query("img_fill_layers", "y b, x b, r b, up b", """SELECT y, x, r, up FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY up) AS k FROM (SELECT y, x, r, 0 AS up, NOT have AS hole FROM raster UNION ALL SELECT y, x, g, 1, (x*3 + y) % 4 = 0 FROM raster UNION ALL SELECT y, x, b, 2, (x + y) % 5 = 0 FROM raster) WHERE NOT hole) WHERE k = 1 UNION ALL
 SELECT y, x, NULL, NULL FROM raster WHERE NOT have AND (x*3 + y) % 4 = 0 AND (x + y) % 5 = 0""")
def img_fill_layers(spark, d):
    t = get(spark, d, "raster")
    layer = lambda c, up, hole: t.select("y", "x", F.col(c).alias("r"), "g", "b", F.lit(up).alias("up"), F.expr(hole).alias("hole"))
    layers = layer("r", 0, "NOT have").unionByName(layer("g", 1, "(x*3 + y) % 4 = 0")).unionByName(layer("b", 2, "(x + y) % 5 = 0"))
    return rasters_more.fill_layers(layers, ["y", "x"])


@query("img_no_imagery", "y b, x b, hole l", "SELECT t.y, t.x, bool_or(s.r <= 4 AND s.g <= 4 AND s.b <= 4) AS hole FROM raster t JOIN raster s ON abs(s.y - t.y) <= 2 AND abs(s.x - t.x) <= 2 GROUP BY t.y, t.x")
def img_no_imagery(spark, d):
    return rasters_more.no_imagery(get(spark, d, "raster"), 2)


FIX = "CAST(trunc(least(greatest({0}::FLOAT*(0.5::FLOAT + (x % 8)::FLOAT*0.125::FLOAT) + (y % 16)::FLOAT - 8::FLOAT + 0.5::FLOAT, 0::FLOAT), 255::FLOAT)) AS BIGINT)".format


@query("img_water_apply", "y b, x b, r b, g b, b b", f"SELECT y, x, {FIX('r')} AS r, {FIX('g')} AS g, {FIX('b')} AS b FROM raster")
def img_water_apply(spark, d):
    f = lambda c: F.expr(c).cast("float")
    t = get(spark, d, "raster")
    return rasters_more.water_apply(t, f("0.5") + f("x % 8") * f("0.125"), f("y % 16") - f("8"))


@query("img_water_mask", "y b, x b, water l", "SELECT y, x, greatest(r, g, b) < 120 AND b >= g - 10 AND b >= r AND have AS water FROM raster")
def img_water_mask(spark, d):
    from tilewright.functions.colour import is_water

    return get(spark, d, "raster").select("y", "x", is_water("r", "g", "b", "have").alias("water"))


@query("img_water_correct", "y b, x b, scale d, offset_r d", """SELECT y, x, CASE WHEN abs(s - 1) < 0.0001::DOUBLE THEN 1 ELSE s END AS scale, CASE WHEN abs(o) < 0.25 THEN 0 ELSE o END AS offset_r FROM (SELECT y, x, 1 - heavy AS s, (ref_ + 60 - ref_local)*heavy - haze*soft*(1 - heavy) AS o FROM (
 SELECT *, CASE WHEN hv < 0.004::DOUBLE THEN 0 ELSE hv END AS heavy, CASE WHEN sf < 0.004::DOUBLE THEN 0 ELSE sf END AS soft FROM (SELECT y, x, greatest(r - 60.0::DOUBLE, 0) AS haze, least(greatest((greatest(r - 60.0::DOUBLE, 0) - 60)/40, 0), 1)*(x/63.0::DOUBLE) AS hv, x/63.0::DOUBLE AS sf, g::DOUBLE AS ref_, b::DOUBLE AS ref_local FROM raster)))""")
def img_water_correct(spark, d):
    from tilewright.operators.water import correction

    t = get(spark, d, "raster").select("y", "x", F.col("r").cast("double").alias("local"), F.lit(60.0).alias("target"), (F.col("x") / 63.0).alias("soft"), F.col("g").cast("double").alias("ref"), F.col("b").cast("double").alias("ref_local"))
    return correction(t).withColumnRenamed("offset", "offset_r")


@query("img_mosaic_reduce", "my b, mx b, r d, g d, b d, share d", "SELECT y // 16 AS my, x // 16 AS mx, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(have::INT) AS share FROM raster GROUP BY 1, 2")
def img_mosaic_reduce(spark, d):
    return rasters_more.mosaic_reduce(get(spark, d, "raster"))


@query("img_components", "label b, pixels b, y0 b, x0 b", """SELECT row_number() OVER (ORDER BY root) AS label, count(*) AS pixels, root // 64 AS y0, root % 64 AS x0 FROM (SELECT node, min(reach) AS root FROM reach_ GROUP BY node) GROUP BY root""",
       """RECURSIVE m AS (SELECT y*64 + x AS node, y, x FROM raster WHERE (x*7 + y*3) % 10 < 4), e AS (SELECT a.node AS u, b.node AS v FROM m a JOIN m b ON abs(a.y - b.y) + abs(a.x - b.x) = 1), reach_ AS (SELECT node, node AS reach FROM m UNION SELECT e.v, reach_.reach FROM reach_ JOIN e ON e.u = reach_.node)""")
def img_components(spark, d):
    t = get(spark, d, "raster").withColumn("on", F.expr("(x*7 + y*3) % 10 < 4"))
    runs = rasters_more.components(t, "on")
    c = runs.groupBy("label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"), F.min(F.struct("y", "x0")).alias("first"))
    from pyspark.sql import Window

    return c.select(F.row_number().over(Window.orderBy("first")).alias("label"), "pixels", F.col("first.y").alias("y0"), F.col("first.x0").alias("x0"))


@query("img_patch_apply", "y b, x b, r b", "SELECT y, x, CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 0 ELSE least(greatest(r + (y // 16)*3 - (x // 16)*5, 0), 255) END AS r FROM raster")
def img_patch_apply(spark, d):
    from tilewright.operators.patches import apply_offsets

    labels = spark.range(16).selectExpr("id div 4 AS my", "id % 4 AS mx", "id AS label")
    offsets = spark.range(16).selectExpr("id AS label", "(id div 4)*3 - (id % 4)*5 AS dr", "0 AS dg", "0 AS db")
    return apply_offsets(get(spark, d, "raster"), labels, offsets, 16)


@query("img_ocean_fill", "y b, x b, r b, priority b", "SELECT y, x, CASE WHEN have THEN r ELSE 9 END AS r, CASE WHEN have THEN 0 ELSE 1 END AS priority FROM raster")
def img_ocean_fill(spark, d):
    t = get(spark, d, "raster")
    ocean = t.select("y", "x", F.lit(9).cast("long").alias("r"), "g", "b", F.lit(True).alias("have"), F.lit(1).alias("priority"))
    return rasters_more.first_source(t.withColumn("priority", F.lit(0)).unionByName(ocean), ["y", "x"])


@query("img_coast_probe", "bin b, sea b, black b", "SELECT x // 8 AS bin, count(*) FILTER (WHERE b > r) AS sea, count(*) FILTER (WHERE r <= 4 AND g <= 4 AND b <= 4) AS black FROM raster WHERE have GROUP BY 1")
def img_coast_probe(spark, d):
    from tilewright.functions.colour import is_black

    return get(spark, d, "raster").where("have").groupBy(F.expr("x div 8").alias("bin")).agg(F.count_if(F.col("b") > F.col("r")).alias("sea"), F.count_if(is_black("r", "g", "b")).alias("black"))


@query("img_sea_texture", "bin b, g d, n b", "SELECT x // 16 AS bin, avg(dg) AS g, count(*) AS n FROM (SELECT x, abs(g - lag(g) OVER (PARTITION BY y ORDER BY x)) AS dg FROM raster) WHERE dg IS NOT NULL GROUP BY 1 HAVING count(*) > 100")
def img_sea_texture(spark, d):
    return quality.gradient_profile(get(spark, d, "raster"), 16, 100)


@query("img_patch_overlay", "y b, x b, r b, outline l", f"SELECT t.y, t.x, (t.r + 255) // 2 AS r, NOT bool_and(coalesce(n.label = t.label, false)) AS outline FROM {LAB} t CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(dy, dx) LEFT JOIN {LAB} n ON n.y = t.y + dy AND n.x = t.x + dx WHERE t.label = 5 GROUP BY t.y, t.x, t.r")
def img_patch_overlay(spark, d):
    from tilewright.operators.patches import overlay

    return overlay(get(spark, d, "raster").selectExpr("y", "x", "(y div 16)*4 + x div 16 AS label", "r"), 5)


@query("img_hash_probes", "tile b, sha v", "SELECT (y // 16)*4 + x // 16 AS tile, sha256(string_agg(printf('%d,%d,%d;', r, g, b), '' ORDER BY y, x)) AS sha FROM raster GROUP BY 1")
def img_hash_probes(spark, d):
    return rasters_more.pixel_hash(get(spark, d, "raster").selectExpr("*", "(y div 16)*4 + x div 16 AS tile"), ["tile"])


@query("img_blend_test", "y b, x b, mask b", "SELECT y, x, CASE WHEN x < 21 THEN 0 WHEN x < 42 THEN 128 ELSE 255 END AS mask FROM raster")
def img_blend_test(spark, d):
    return get(spark, d, "raster").select("y", "x", F.when(F.col("x") < 21, 0).when(F.col("x") < 42, 128).otherwise(255).alias("mask"))


@query("img_opened", "y b, x b, have l", "SELECT * FROM " + MORPH(f="bool_or", src="er", r=2), f"er AS (SELECT * FROM {MORPH(f='bool_and', src='raster', r=2)})")
def img_opened(spark, d):
    return raster.dilate(raster.dilate(get(spark, d, "raster"), "have", 2, erode=True), "have", 2)


@query("img_block_pyramid", "level b, tx b, ty b, sum b")
def img_block_pyramid(spark, d):
    from tilewright.operators import blocks

    t = get(spark, d, "raster").selectExpr("12L AS level", "x div 16 AS tx", "3 - y div 16 AS ty", "y % 16 AS y", "x % 16 AS x", "r", "g", "b", "have")
    p = blocks.pyramid(blocks.from_pixels(t, 16), 16, 2)
    return p.select("level", "tx", "ty", F.crc32("rgb").alias("sum"))


@query("img_textures", "level b, tx b, ty b, bytes b, masked l")
def img_textures(spark, d):
    from tilewright.operators import blocks

    t = get(spark, d, "raster").selectExpr("12L AS level", "x div 16 AS tx", "3 - y div 16 AS ty", "y % 16 AS y", "x % 16 AS x", "r", "g", "b", "have")
    return blocks.textures(blocks.from_pixels(t, 16), 16).select("level", "tx", "ty", F.octet_length("texture").alias("bytes"), F.col("mask").isNotNull().alias("masked"))
