"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import fetch, lines, quality, raster, rasters_more
from tilewright.plans.joins import DIST
from tilewright.plans.registry import query
from tilewright.plans.views import get
from tilewright.session import table

HALF = "SELECT y // 2 AS y, x // 2 AS x, (CAST(sum(r) AS BIGINT) + 2) // 4 AS r, (CAST(sum(g) AS BIGINT) + 2) // 4 AS g, (CAST(sum(b) AS BIGINT) + 2) // 4 AS b, sum(have::INT) >= 2 AS have FROM {0} GROUP BY y // 2, x // 2".format


@query("agg_halve_rgb", "y b, x b, r b, g b, b b", f"SELECT y, x, r, g, b FROM ({HALF('raster')})")
def agg_halve_rgb(spark, d):
    return raster.halve(get(spark, d, "raster"))


@query("agg_halve_cov", "y b, x b, have l", f"SELECT y, x, have FROM ({HALF('raster')})")
def agg_halve_cov(spark, d):
    return raster.halve(get(spark, d, "raster"))


@query("agg_pyramid", "up b, y b, x b, r b, g b, b b, have l", "SELECT 0 AS up, y, x, r, g, b, have FROM raster UNION ALL SELECT 1, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3", f"h1 AS ({HALF('raster')}), h2 AS ({HALF('h1')}), h3 AS ({HALF('h2')})")
def agg_pyramid(spark, d):
    return raster.pyramid(get(spark, d, "raster"), 3)


@query("agg_maxpool_mask", "my b, mx b, mask b", "SELECT y // 4 AS my, x // 4 AS mx, CASE WHEN bool_or(have) THEN 255 ELSE 0 END AS mask FROM (SELECT 63 - y AS y, x, have FROM raster) GROUP BY 1, 2")
def agg_maxpool_mask(spark, d):
    return rasters_more.max_pool(rasters_more.flip_rows(get(spark, d, "raster"), 64))


@query("agg_tile_coverage", "ty b, tx b, kind v", "SELECT ty, tx, CASE WHEN NOT bool_or(have) THEN 'none' WHEN bool_and(have) THEN 'tile' ELSE 'tile+mask' END AS kind FROM (SELECT y // 3 AS ty, x // 3 AS tx, have FROM raster) GROUP BY ty, tx")
def agg_tile_coverage(spark, d):
    return rasters_more.coverage(get(spark, d, "raster").selectExpr("y div 3 AS ty", "x div 3 AS tx", "have"), ["ty", "tx"])


@query("agg_mip_chain", "p_partkey b, size b, levels b, bytes b", "SELECT p_partkey, n AS size, count(*) AS levels, sum(greatest(1, CAST(ceil((n >> k)/4.0::DOUBLE) AS BIGINT))*greatest(1, CAST(ceil((n >> k)/4.0::DOUBLE) AS BIGINT))*8) AS bytes FROM (SELECT p_partkey, CAST(1 + (p_partkey*p_size) % 2048 AS BIGINT) AS n FROM part) CROSS JOIN range(12) r(k) WHERE (n >> k) > 0 GROUP BY p_partkey, n")
def agg_mip_chain(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey", "1 + (p_partkey*p_size) % 2048 AS size")
    sizes = quality.mip_bytes("size")
    return t.select("p_partkey", "size", F.size(sizes).alias("levels"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"))


P565 = "CAST(({0}r // 8)*2048 + ({0}g // 4)*32 + {0}b // 8 AS BIGINT)".format
E5 = "((({0} >> {1}) & 31)*8 + ((({0} >> {1}) & 31) >> 2))".format
E6 = "((({0} >> 5) & 63)*4 + ((({0} >> 5) & 63) >> 4))".format
BLOCKS = f"""blk AS (SELECT by_, bx, greatest(p, q) AS c0, least(p, q) AS c1 FROM (SELECT by_, bx, {P565('h')} AS p, {P565('l')} AS q FROM (SELECT y // 4 AS by_, x // 4 AS bx, max(r) AS hr, max(g) AS hg, max(b) AS hb, min(r) AS lr, min(g) AS lg, min(b) AS lb FROM raster GROUP BY 1, 2))),
ends AS (SELECT *, {E5('c0', 11)} AS r0, {E6('c0')} AS g0, {E5('c0', 0)} AS b0, {E5('c1', 11)} AS r1, {E6('c1')} AS g1, {E5('c1', 0)} AS b1 FROM blk),
pal AS (SELECT by_, bx, c0, c1, 0 AS k, r0 AS r, g0 AS g, b0 AS b FROM ends UNION ALL SELECT by_, bx, c0, c1, 1, r1, g1, b1 FROM ends
 UNION ALL SELECT by_, bx, c0, c1, 2, (2*r0 + r1) // 3, (2*g0 + g1) // 3, (2*b0 + b1) // 3 FROM ends UNION ALL SELECT by_, bx, c0, c1, 3, (r0 + 2*r1) // 3, (g0 + 2*g1) // 3, (b0 + 2*b1) // 3 FROM ends),
idx AS (SELECT by_, bx, c0, c1, y, x, arg_min(k, dist*4 + k) AS k FROM (SELECT p.by_, p.bx, c0, c1, k, y, x, (t.r - p.r)*(t.r - p.r) + (t.g - p.g)*(t.g - p.g) + (t.b - p.b)*(t.b - p.b) AS dist FROM raster t JOIN pal p ON t.y // 4 = p.by_ AND t.x // 4 = p.bx) GROUP BY ALL),
coded AS (SELECT by_, bx, c0, c1, CAST(sum(CAST(k AS BIGINT) << CAST(2*((y % 4)*4 + x % 4) AS BIGINT)) AS BIGINT) AS bits FROM idx GROUP BY by_, bx, c0, c1)"""


@query("agg_bc1_block", "by_ b, bx b, c0 b, c1 b, bits b", "SELECT * FROM coded", BLOCKS)
def agg_bc1_block(spark, d):
    return raster.bc1_blocks(get(spark, d, "raster")).withColumnRenamed("by", "by_")


@query("bc1_decode", "y b, x b, r b, g b, b b", "SELECT y, x, r, g, b FROM idx JOIN pal USING (by_, bx, k)", BLOCKS)
def bc1_decode(spark, d):
    return raster.bc1_pixels(raster.bc1_blocks(get(spark, d, "raster")))


ERR = "mse_ AS (SELECT avg((abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b))/3.0::DOUBLE) AS mae, avg(((a.r - b.r)*(a.r - b.r) + (a.g - b.g)*(a.g - b.g) + (a.b - b.b)*(a.b - b.b))/3.0::DOUBLE) AS mse FROM raster a JOIN (SELECT y, x, r, g, b FROM idx JOIN pal USING (by_, bx, k)) b USING (y, x))"


@query("agg_psnr", "mse d, psnr d", "SELECT mse, 10*log10(65025/mse) AS psnr FROM mse_", f"{BLOCKS}, {ERR}")
def agg_psnr(spark, d):
    t = get(spark, d, "raster")
    return quality.mean_error(t, raster.bc1_pixels(raster.bc1_blocks(t)), ["y", "x"])


@query("agg_mae", "mae d", "SELECT mae FROM mse_", f"{BLOCKS}, {ERR}")
def agg_mae(spark, d):
    return agg_psnr(spark, d)


LOCAL = "(SELECT tile_x, tile_y, tile_x + 1 AS local_x, tile_y + 1 AS local_y FROM tile_image WHERE http = 200)"


@query("agg_stitch_bounds", "set_x b, set_y b, x0 b, x1 b, y0 b, y1 b, cols b, rows b, rows_used b", f"SELECT (local_x - 1) // 20 AS set_x, (local_y - 1) // 20 AS set_y, min(tile_x) AS x0, max(tile_x) AS x1, min(tile_y) AS y0, max(tile_y) AS y1, max((local_x - 1) % 20 + 1) AS cols, max((local_y - 1) % 20 + 1) AS rows, count(DISTINCT local_y) AS rows_used FROM {LOCAL} GROUP BY 1, 2")
def agg_stitch_bounds(spark, d):
    t = get(spark, d, "tile_image").where("http = 200").selectExpr("tile_x", "tile_y", "tile_x + 1 AS local_x", "tile_y + 1 AS local_y")
    return quality.stitch_bounds(t, 20)


@query("agg_tile_extent", "source v, zoom b, x0 b, x1 b, y0 b, y1 b", "SELECT 'src' || (o_orderkey % 3) AS source, 16 AS zoom, min(tile_x) AS x0, max(tile_x) AS x1, min(tile_y) AS y0, max(tile_y) AS y1 FROM tile_image GROUP BY 1")
def agg_tile_extent(spark, d):
    names = get(spark, d, "tile_image").select(F.format_string("src%d_16_%d_%d.jpg", F.col("o_orderkey") % 3, "tile_x", "tile_y").alias("name"))
    part = lambda k: F.split(F.regexp_replace("name", r"\.[^.]*$", ""), "_")[k]
    t = names.select(part(0).alias("source"), *[part(k).cast("long").alias(c) for k, c in enumerate(("zoom", "x", "y"), 1)])
    return t.groupBy("source", "zoom").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("agg_stitch_partition", "o_orderkey b, cap b, across b, down b", "SELECT o_orderkey, cap, (tx + least(v, cap) - 1) // least(v, cap) AS across, (ty + least(v, cap) - 1) // least(v, cap) AS down FROM (SELECT o_orderkey, 1 + o_orderkey % 600 AS v, 100 + o_custkey % 300 AS tx, 100 + o_orderkey % 200 AS ty, CAST(floor(sqrt(0.8::DOUBLE*2147483647/(256*256*4))) AS BIGINT) AS cap FROM orders)")
def agg_stitch_partition(spark, d):
    cap = F.lit(quality.stitch_cap(256, 256)).cast("long")
    t = table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 600).alias("most"), (100 + F.col("o_custkey") % 300).alias("tx"), (100 + F.col("o_orderkey") % 200).alias("ty"))
    part = lambda n: F.ceil(F.col(n) / F.least(F.col("most"), cap))
    return t.select("o_orderkey", cap.alias("cap"), part("tx").alias("across"), part("ty").alias("down"))


STATUS = "CASE WHEN no_tile OR http IN (404, 410) THEN 'unavailable' WHEN http NOT BETWEEN 200 AND 299 THEN 'failed' WHEN NOT is_image THEN 'not_image' ELSE 'saved' END"


@query("agg_download_status", "status v, n b, percent d", f"SELECT status, count(*) AS n, 100.0::DOUBLE*count(*)/(SELECT count(*) FROM tile_image) AS percent FROM (SELECT {STATUS} AS status FROM tile_image) GROUP BY status")
def agg_download_status(spark, d):
    t = get(spark, d, "tile_image").select(fetch.status("http", "no_tile", "is_image").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = t.agg(F.sum("n").alias("total"))
    return t.crossJoin(total).withColumn("percent", 100.0 * F.col("n") / F.col("total"))


@query("agg_fill_level", "up b", "SELECT coalesce(min(up) FILTER (WHERE filled >= 0.98::DOUBLE), arg_max(up, filled*1000 - up)) AS up FROM (SELECT up, avg((share < 0.01)::INT) AS filled FROM (SELECT 1 + o_orderkey % 5 AS up, CASE WHEN o_orderkey % 100 < 10*(5 - o_orderkey % 5) THEN 0.5::DOUBLE ELSE 0 END AS share FROM orders) GROUP BY up)")
def agg_fill_level(spark, d):
    t = table(spark, d, "orders").selectExpr("1 + o_orderkey % 5 AS up", "CASE WHEN o_orderkey % 100 < 10*(5 - o_orderkey % 5) THEN 0.5D ELSE 0D END AS share")
    return quality.best_level(t, F.col("share"))


@query("agg_black_share", "ty b, tx b, share d", "SELECT y // 16 AS ty, x // 16 AS tx, avg((r <= 4 AND g <= 4 AND b <= 4)::INT) AS share FROM raster GROUP BY 1, 2")
def agg_black_share(spark, d):
    from tilewright.functions.colour import is_black

    return get(spark, d, "raster").groupBy(F.expr("y div 16").alias("ty"), F.expr("x div 16").alias("tx")).agg(F.avg(is_black("r", "g", "b").cast("int")).alias("share"))


TEX = "(SELECT (y // 16)*4 + x // 16 AS body, (r*0.3::DOUBLE) AS r, (g*0.5::DOUBLE) AS g, (b*1.0::DOUBLE) AS b, 0.005::DOUBLE*(1 + (x // 16)) AS km2 FROM raster WHERE have)"


def _texels(spark, d):
    return get(spark, d, "raster").where("have").selectExpr("(y div 16)*4 + x div 16 AS body", "r*0.3D AS r", "g*0.5D AS g", "b*1.0D AS b", "0.005D*(1 + (x div 16)) AS km2")


@query("agg_body_targets", "body b, km2 d, r d, g d, b d", f"""SELECT t.body, km2, CASE WHEN NOT ok THEN 1000 WHEN km2 < 1.5 THEN ar ELSE r END AS r, CASE WHEN NOT ok THEN 1000 WHEN km2 < 1.5 THEN ag ELSE g END AS g, CASE WHEN NOT ok THEN 1000 WHEN km2 < 1.5 THEN ab ELSE b END AS b
 FROM t CROSS JOIN (SELECT quantile_cont(r, 0.15) AS ar, quantile_cont(g, 0.15) AS ag, quantile_cont(b, 0.15) AS ab FROM {TEX} x WHERE x.body IN (SELECT body FROM t WHERE ok))""", f"t AS (SELECT *, b - r >= 15 AS ok FROM (SELECT body, quantile_cont(r, 0.15) AS r, quantile_cont(g, 0.15) AS g, quantile_cont(b, 0.15) AS b, sum(km2) AS km2 FROM {TEX} GROUP BY body))")
def agg_body_targets(spark, d):
    return quality.body_targets(_texels(spark, d))


@query("agg_body_report", "body b, km2 d, squares v", f"SELECT body, sum(km2) AS km2, array_to_string(list_sort(list_distinct(list('sq' || CAST(r AS BIGINT) % 4))), ',') AS squares FROM (SELECT body, km2, floor(r/10) AS r FROM {TEX}) GROUP BY body HAVING sum(km2) >= 2")
def agg_body_report(spark, d):
    t = _texels(spark, d).withColumn("square", F.concat(F.lit("sq"), F.floor(F.col("r") / 10) % 4))
    t = t.groupBy("body").agg(F.sum("km2").alias("km2"), F.array_join(F.sort_array(F.collect_set("square")), ",").alias("squares"))
    return t.where("km2 >= 2").orderBy(F.desc("km2"))


@query("agg_row_area", "y b, km2 d", "SELECT p_partkey AS y, 111.32::DOUBLE*0.001*111.32::DOUBLE*0.001*cos(radians(-33 - p_partkey*0.001::DOUBLE)) AS km2 FROM part")
def agg_row_area(spark, d):
    step = 111.32 * 0.001
    return table(spark, d, "part").select(F.col("p_partkey").alias("y"), (F.lit(step * step) * F.cos(F.radians(-33.0 - F.col("p_partkey") * 0.001))).alias("km2"))


@query("agg_hist_distance", "bin b, n b, marked b, share d", f"SELECT bin, n, marked, sum(marked) OVER (ORDER BY bin)::DOUBLE/sum(n) OVER (ORDER BY bin) AS share FROM (SELECT CAST(least(floor(km/2), 4) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS marked FROM {DIST} GROUP BY 1)")
def agg_hist_distance(spark, d):
    t = lines.distances(get(spark, d, "probe"), ["event_id"], get(spark, d, "coast_segment"), 2 * lines.MARGIN_KM + 1)
    return quality.histogram(t.withColumn("marked", F.col("event_id") % 3 == 0), "km", 2.0, 5, "marked")


AT = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 1.0]


@query("agg_percentiles", "band b, n b, p0 d, p1 d, p5 d, p25 d, p50 d, p75 d, p100 d", "SELECT band, n, " + ", ".join(f"p[{k + 1}] AS p{round(100 * a)}" for k, a in enumerate(AT)) + f" FROM (SELECT CAST(floor(lat/10) AS BIGINT) AS band, count(*) AS n, quantile_cont(lon, {AT}) AS p FROM geo_point GROUP BY 1 HAVING count(*) >= 50)")
def agg_percentiles(spark, d):
    t = get(spark, d, "geo_point").select("lon", F.floor(F.col("lat") / 10).alias("band"))
    return quality.percentiles(t, "lon", AT, ["band"], 50)


@query("agg_gradient_profile", "bin b, g d, n b", "SELECT x // 8 AS bin, avg(dg) AS g, count(*) AS n FROM (SELECT x, abs(g - lag(g) OVER (PARTITION BY y ORDER BY x)) AS dg FROM raster) WHERE dg IS NOT NULL GROUP BY 1 HAVING count(*) > 200")
def agg_gradient_profile(spark, d):
    return quality.gradient_profile(get(spark, d, "raster"), 8, 200)


LAB = "(SELECT y, x, (y // 16)*4 + x // 16 AS label, r, g, b FROM raster)"


@query("agg_patch_offset", "p b, q b, n b, r d, g d, b d, weight d", f"""SELECT p, q, count(*) AS n, median(r) AS r, median(g) AS g, median(b) AS b, sqrt(count(*)) AS weight FROM (
 SELECT least(a.label, c.label) AS p, greatest(a.label, c.label) AS q, CASE WHEN a.label < c.label THEN 1 ELSE -1 END*(c.r - a.r) AS r, CASE WHEN a.label < c.label THEN 1 ELSE -1 END*(c.g - a.g) AS g, CASE WHEN a.label < c.label THEN 1 ELSE -1 END*(c.b - a.b) AS b
 FROM {LAB} a JOIN {LAB} c ON a.label <> c.label AND ((c.x = a.x + 1 AND c.y = a.y) OR (c.y = a.y + 1 AND c.x = a.x))) GROUP BY p, q HAVING count(*) >= 5""")
def agg_patch_offset(spark, d):
    return quality.patch_offsets(get(spark, d, "raster").selectExpr("y", "x", "(y div 16)*4 + x div 16 AS label", "r", "g", "b"))


@query("agg_progress", "user_id b, event_id b, percent d", "SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS percent FROM events")
def agg_progress(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "events").select("user_id", "event_id", F.max("value").over(Window.partitionBy("user_id").orderBy("event_id")).alias("percent"))


@query("agg_distinct_parents", "folder v, names b, parents b", "SELECT folder, count(DISTINCT name) AS names, count(DISTINCT left(name, 11)) AS parents FROM catalog_file GROUP BY folder")
def agg_distinct_parents(spark, d):
    return get(spark, d, "catalog_file").groupBy("folder").agg(F.count_distinct("name").alias("names"), F.count_distinct(F.substring("name", 1, 11)).alias("parents"))


@query("agg_take_listing", "folder v, name v", "SELECT folder, name FROM (SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY name, p_partkey) AS k FROM catalog_file) WHERE k <= 10")
def agg_take_listing(spark, d):
    from pyspark.sql import Window

    t = get(spark, d, "catalog_file").withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy("name", "p_partkey")))
    return t.where("k <= 10")
