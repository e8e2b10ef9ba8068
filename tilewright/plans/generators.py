"""Queries of the generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import grid
from tilewright.operators import tiles
from tilewright.plans.registry import query
from tilewright.plans.scalars import MX, gx, gy, lat_of, lon_of, m_y, north, west
from tilewright.plans.views import get
from tilewright.session import table

RANGES = f"(SELECT s_suppkey, l AS level, CAST(floor({gx('w', 'l')}) AS BIGINT) AS x0, greatest(CAST(ceil({gx('e', 'l')}) AS BIGINT), CAST(floor({gx('w', 'l')}) AS BIGINT) + 1) AS x1, CAST(floor({gy('s', 'l')}) AS BIGINT) AS y0, greatest(CAST(ceil({gy('n', 'l')}) AS BIGINT), CAST(floor({gy('s', 'l')}) AS BIGINT) + 1) AS y1 FROM geo_box CROSS JOIN (VALUES (7), (8), (9)) v(l))"


@query("enum_image_tiles", "s_suppkey b, tile_x b, tile_y b, local_x b, local_y b", f"""SELECT s_suppkey, tile_x, tile_y, tile_x - x0 + 1 AS local_x, tile_y - y0 + 1 AS local_y FROM (
 SELECT s_suppkey, x0, y0, unnest(range(x0, x1 + 1)) AS tile_x, y1, yy AS tile_y FROM (
  SELECT s_suppkey, x0, y0, x1, y1, unnest(range(y0, y1 + 1)) AS yy FROM (SELECT s_suppkey, x0, y0,
   (SELECT min(x) FROM range(0, 1200) r(x) WHERE x > x0 AND {west('x', 10)} >= e) AS x1, (SELECT min(y) FROM range(0, 1200) r(y) WHERE y > y0 AND {north('y', 10)} <= s) AS y1
   FROM (SELECT *, {MX('w', 10)} AS x0, {m_y('n', 10)} AS y0 FROM geo_box))))""")
def enum_image_tiles(spark, d):
    return tiles.image_tiles(get(spark, d, "geo_box"), 10)


@query("enum_grid_tiles", "s_suppkey b, tx b, ty b", f"SELECT s_suppkey, unnest(range(x0, x1)) AS tx, ty FROM (SELECT *, unnest(range(y0, y1)) AS ty FROM {RANGES} WHERE level = 9)")
def enum_grid_tiles(spark, d):
    return tiles.grid_tiles(get(spark, d, "geo_box"), 9)


WORK = f"""a AS (SELECT * FROM {RANGES} WHERE level = 7), b AS (SELECT r.s_suppkey, r.level, least(r.x0, 2*a.x0) AS x0, greatest(r.x1, 2*a.x1) AS x1, least(r.y0, 2*a.y0) AS y0, greatest(r.y1, 2*a.y1) AS y1 FROM {RANGES} r JOIN a USING (s_suppkey) WHERE r.level = 8),
c AS (SELECT r.s_suppkey, r.level, least(r.x0, 2*b.x0) AS x0, greatest(r.x1, 2*b.x1) AS x1, least(r.y0, 2*b.y0) AS y0, greatest(r.y1, 2*b.y1) AS y1 FROM {RANGES} r JOIN b USING (s_suppkey) WHERE r.level = 9)"""


def _work(spark, d):
    t = get(spark, d, "geo_box").withColumn("level", F.explode(F.array(F.lit(7), F.lit(8), F.lit(9))))
    t = t.select("s_suppkey", F.struct("level", *[c.alias(k) for k, c in grid.tile_range("w", "e", "s", "n", "level").items()]).alias("r"))
    return t.groupBy("s_suppkey").agg(tiles.widen(F.collect_list("r")).alias("rs"))


@query("work_range", "s_suppkey b, level b, x0 b, x1 b, y0 b, y1 b", "SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c", WORK)
def work_range(spark, d):
    return _work(spark, d).select("s_suppkey", F.explode("rs").alias("r")).select("s_suppkey", "r.*")


@query("field_box", "s_suppkey b, w d, e d, s d, n d", f"SELECT s_suppkey, {lon_of('x0', 9)} AS w, {lon_of('x1', 9)} AS e, {lat_of('y0', 9)} AS s, {lat_of('y1', 9)} AS n FROM c", WORK)
def field_box(spark, d):
    t = _work(spark, d).select("s_suppkey", F.element_at("rs", -1).alias("r"))
    return t.select("s_suppkey", grid.lon_of_grid_x("r.x0", 9).alias("w"), grid.lon_of_grid_x("r.x1", 9).alias("e"), grid.lat_of_grid_y("r.y0", 9).alias("s"), grid.lat_of_grid_y("r.y1", 9).alias("n"))


@query("pixel_centres", "s_suppkey b, i b, lon d, lat d", f"SELECT s_suppkey, i, {lon_of('tx::DOUBLE', 9)} + (i + 0.5::DOUBLE)*({lon_of('(tx + 1)::DOUBLE', 9)} - {lon_of('tx::DOUBLE', 9)})/64 AS lon, {lat_of('ty + 1 - (i + 0.5::DOUBLE)/64', 9)} AS lat FROM (SELECT s_suppkey, 100 + s_suppkey % 200 AS tx, 200 + s_suppkey % 100 AS ty FROM supplier) CROSS JOIN range(64) t(i)")
def pixel_centres(spark, d):
    t = table(spark, d, "supplier").selectExpr("s_suppkey", "100 + s_suppkey % 200 AS tx", "200 + s_suppkey % 100 AS ty")
    lons, lats = tiles.pixel_centres(F.col("tx"), F.col("ty"), 9, 64)
    return t.select("s_suppkey", F.posexplode(F.arrays_zip(lons.alias("lon"), lats.alias("lat"))).alias("i", "p")).select("s_suppkey", "i", "p.lon", "p.lat")


CELLS = f"(SELECT DISTINCT CAST(floor({gx('lon', 9)}) AS BIGINT) AS x, CAST(floor({gy('lat', 9)}) AS BIGINT) AS y FROM geo_point)"


@query("empty_neighbours", "x b, y b", f"SELECT DISTINCT c.x + a AS x, c.y + b AS y FROM {CELLS} c CROSS JOIN range(-1, 2) i(a) CROSS JOIN range(-1, 2) j(b) WHERE NOT EXISTS (SELECT 1 FROM {CELLS} o WHERE o.x = c.x + a AND o.y = c.y + b)")
def empty_neighbours(spark, d):
    return tiles.empty_neighbours(get(spark, d, "geo_point").select(grid.tile_x("lon", 9).alias("x"), grid.tile_y("lat", 9).alias("y")))


@query("test_pattern", "y b, x b, r b, g b, b b, have l", "SELECT * FROM raster")
def test_pattern(spark, d):
    return get(spark, d, "raster")


@query("stripes_paint", "y b, x b, r b, mask b", "SELECT y, x, CASE WHEN stripe IS NULL THEN r ELSE stripe*40 END AS r, CASE WHEN stripe % 2 = 0 THEN 255 ELSE 0 END AS mask FROM (SELECT raster.*, v.stripe FROM raster LEFT JOIN (VALUES (0, 4, 12), (1, 20, 25), (2, 40, 60)) v(stripe, a, b) ON x >= v.a AND x < v.b)")
def stripes_paint(spark, d):
    from tilewright.operators.rasters_more import paint_stripes

    return paint_stripes(get(spark, d, "raster"), [(0, 4, 12), (1, 20, 25), (2, 40, 60)])
