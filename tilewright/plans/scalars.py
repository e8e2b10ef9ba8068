"""Queries of the grid, projection and colour functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import colour, grid, mercator
from tilewright.plans.registry import query
from tilewright.plans.views import get
from tilewright.session import table

# DuckDB text of the same mathematics, written apart from the Spark side.
K = "2.3311223704144::DOUBLE"


def gx(lon, lv):
    return f"(pow(2.0::DOUBLE, {lv}) * (0.5::DOUBLE + 0.5::DOUBLE*({lon})/180))"


def gy(lat, lv):
    return f"(pow(2.0::DOUBLE, {lv}) * (0.5::DOUBLE + 0.5::DOUBLE*tan({K}*({lat})/180)/{K}))"


def lon_of(x, lv):
    return f"((2*({x})::DOUBLE/pow(2.0::DOUBLE, {lv}) - 1)*180)"


def lat_of(y, lv):
    return f"(atan((2*({y})::DOUBLE/pow(2.0::DOUBLE, {lv}) - 1)*{K})*180/{K})"


def step(lv):
    return f"CAST(pow(2, 16 - ({lv})) AS BIGINT)"


MY = "ln(tan(pi()/4 + radians({0})/2))".format
SIN = "least(greatest(sin(radians({0})), -0.9999), 0.9999)".format
MX = "CAST(floor(pow(2.0::DOUBLE, {1}) * (({0}) + 180)/360) AS BIGINT)".format


def m_y(lat, z):
    return f"CAST(floor(pow(2.0::DOUBLE, {z}) * (0.5 - ln((1 + {SIN(lat)})/(1 - {SIN(lat)}))/(4*pi()))) AS BIGINT)"


def west(x, z):
    return f"(({x})::DOUBLE/pow(2.0::DOUBLE, {z})*360 - 180)"


def north(y, z):
    return f"(90 - 360*atan(exp(-(0.5::DOUBLE - ({y})::DOUBLE/pow(2.0::DOUBLE, {z}))*2*pi()))/pi())"


def quadkey(x, y, z):
    return f"array_to_string(list_transform(range(1, {z} + 1), lambda i : CAST((CAST({x} AS BIGINT) >> CAST({z} - i AS BIGINT)) % 2 + 2*((CAST({y} AS BIGINT) >> CAST({z} - i AS BIGINT)) % 2) AS VARCHAR)), '')"


@query("grid_xy", "event_id b, gx d, gy d", f"SELECT event_id, {gx('lon', 9)} AS gx, {gy('lat', 9)} AS gy FROM geo_point")
def grid_xy(spark, d):
    return get(spark, d, "geo_point").select("event_id", grid.grid_x("lon", 9).alias("gx"), grid.grid_y("lat", 9).alias("gy"))


@query("lon_lat_of_grid", "c_custkey b, lon d, lat d", f"SELECT c_custkey, {lon_of('c_custkey*37 % 512', 9)} AS lon, {lat_of('c_custkey*53 % 512', 9)} AS lat FROM grid_square")
def lon_lat_of_grid(spark, d):
    t = get(spark, d, "grid_square")
    return t.select("c_custkey", grid.lon_of_grid_x(F.col("c_custkey") * 37 % 512, 9).alias("lon"), grid.lat_of_grid_y(F.col("c_custkey") * 53 % 512, 9).alias("lat"))


SQ = f"(SELECT c_custkey, level, CAST(floor({gx('lon', 'level')}) AS BIGINT) AS tx, CAST(floor({gy('lat', 'level')}) AS BIGINT) AS ty FROM grid_square)"


@query("grid_square_at", "c_custkey b, level b, name v, w d, e d, s d, n d", f"SELECT c_custkey, level, printf('%04x_%04x', tx*{step('level')}, ty*{step('level')}) AS name, {lon_of('tx', 'level')} AS w, {lon_of('tx + 1', 'level')} AS e, {lat_of('ty', 'level')} AS s, {lat_of('ty + 1', 'level')} AS n FROM {SQ}")
def grid_square_at(spark, d):
    t = get(spark, d, "grid_square").select("c_custkey", "level", grid.tile_x("lon", "level").alias("tx"), grid.tile_y("lat", "level").alias("ty"))
    return t.select("c_custkey", "level", grid.square_name("tx", "ty", "level").alias("name"), *[c.alias(k) for k, c in grid.square_edges("tx", "ty", "level").items()])


HEX = "CAST('0x' || {0} AS BIGINT)".format


@query("grid_square_by_name", "p_partkey b, level b, w d, n d", f"""SELECT p_partkey, level, {lon_of("hx/" + step('level'), 'level')} AS w, {lat_of("hy/" + step('level') + " + 1", 'level')} AS n FROM (
  SELECT p_partkey, CAST(regexp_extract(name, '^map_([0-9]+)_', 1) AS BIGINT) AS level, {HEX("regexp_extract(name, '_([0-9a-f]{4})_', 1)")}::DOUBLE AS hx, {HEX("regexp_extract(name, '_[0-9a-f]{4}_([0-9a-f]{4})', 1)")}::DOUBLE AS hy
  FROM catalog_file WHERE regexp_matches(name, '^map_[0-9][0-9]_[0-9a-f]{{4}}_[0-9a-f]{{4}}(_mask)?[.]ttc$'))""")
def grid_square_by_name(spark, d):
    t = get(spark, d, "catalog_file").withColumn("t", grid.parse_tile_name("name")).where("t is not null")
    e = grid.square_edges("t.tx", "t.ty", "t.level")
    return t.select("p_partkey", "t.level", e["w"].alias("w"), e["n"].alias("n"))


@query("square_center", "s_suppkey b, lat d, lon d", """SELECT s_suppkey, degrees(atan2(sin(a) + sin(b), sqrt((cos(a) + bx)*(cos(a) + bx) + by_*by_))) AS lat, degrees(radians(w) + atan2(by_, cos(a) + bx)) AS lon
 FROM (SELECT *, cos(b)*cos(radians(e - w)) AS bx, cos(b)*sin(radians(e - w)) AS by_ FROM (SELECT *, radians(n) AS a, radians(s) AS b FROM geo_box))""")
def square_center(spark, d):
    lat, lon = grid.square_center("n", "w", "s", "e")
    return get(spark, d, "geo_box").select("s_suppkey", lat.alias("lat"), lon.alias("lon"))


@query("square_edges_from_name", "name v, w d, e d, s d, n d", f"""SELECT DISTINCT name, {lon_of('x', 9)} AS w, {lon_of('x + 1', 9)} AS e, {lat_of('y', 9)} AS s, {lat_of('y + 1', 9)} AS n FROM (
 SELECT left(name, 16) AS name, {HEX("substr(name, 8, 4)")} // 128 AS x, {HEX("substr(name, 13, 4)")} // 128 AS y FROM catalog_file WHERE name LIKE 'map_09_%' AND length(name) >= 20)""")
def square_edges_from_name(spark, d):
    t = get(spark, d, "catalog_file").select(F.substring("name", 1, 16).alias("name")).distinct().withColumn("t", grid.parse_tile_name("name", grid.SQUARE_PATTERN))
    t = t.where("t.level = 9")
    return t.select("name", *[c.alias(k) for k, c in grid.square_edges("t.tx", "t.ty", "t.level").items()])


@query("tile_name", "c_custkey b, name v", f"SELECT c_custkey, printf('map_%02d_%04x_%04x', level, tx*{step('level')}, ty*{step('level')}) || CASE WHEN c_custkey % 2 = 0 THEN '_mask' ELSE '' END || '.ttc' AS name FROM {SQ}")
def tile_name(spark, d):
    t = get(spark, d, "grid_square")
    return t.select("c_custkey", grid.tile_name(grid.tile_x("lon", "level"), grid.tile_y("lat", "level"), "level", F.col("c_custkey") % 2 == 0).alias("name"))


@query("parse_tile_name", "p_partkey b, ok l, level b, tx b, ty b, mask l", f"""SELECT p_partkey, ok, CASE WHEN ok THEN level END AS level, CASE WHEN ok THEN {HEX("regexp_extract(name, '_([0-9a-f]{4})_', 1)")} // {step('level')} END AS tx, CASE WHEN ok THEN {HEX("regexp_extract(name, '_[0-9a-f]{4}_([0-9a-f]{4})', 1)")} // {step('level')} END AS ty, CASE WHEN ok THEN name LIKE '%_mask.ttc' END AS mask
 FROM (SELECT *, regexp_matches(name, '^map_[0-9][0-9]_[0-9a-f]{{4}}_[0-9a-f]{{4}}(_mask)?[.]ttc$') AS ok, CASE WHEN name LIKE 'map%' THEN CAST(substr(name, 5, 2) AS BIGINT) END AS level FROM catalog_file)""")
def parse_tile_name(spark, d):
    t = get(spark, d, "catalog_file").withColumn("t", grid.parse_tile_name("name"))
    return t.select("p_partkey", F.col("t").isNotNull().alias("ok"), "t.level", "t.tx", "t.ty", "t.mask")


@query("tile_range", "s_suppkey b, x0 b, x1 b, y0 b, y1 b", f"""SELECT s_suppkey, x0, greatest(x1, x0 + 1) AS x1, y0, greatest(y1, y0 + 1) AS y1 FROM (SELECT s_suppkey, CAST(floor({gx('w', 9)}) AS BIGINT) AS x0, CAST(ceil({gx('e', 9)}) AS BIGINT) AS x1, CAST(floor({gy('s', 9)}) AS BIGINT) AS y0, CAST(ceil({gy('n', 9)}) AS BIGINT) AS y1 FROM geo_box)""")
def tile_range(spark, d):
    return get(spark, d, "geo_box").select("s_suppkey", *[c.alias(k) for k, c in grid.tile_range("w", "e", "s", "n", 9).items()])


@query("landmark_cell", "place_id b, x b, y b, tile v", f"SELECT place_id, x, y, printf('lm_07_%d_%d', x, y) AS tile FROM (SELECT place_id, CAST(floor({gx('lon', 7)}) AS BIGINT) AS x, CAST(floor({gy('lat', 7)}) AS BIGINT) AS y FROM place)")
def landmark_cell(spark, d):
    x, y = grid.landmark_cell("lon", "lat")
    return get(spark, d, "place").select("place_id", x.alias("x"), y.alias("y"), F.format_string("lm_07_%d_%d", x, y).alias("tile"))


@query("merc_tile_xy", "event_id b, x b, y b", f"SELECT event_id, {MX('lon', 15)} AS x, {m_y('lat', 15)} AS y FROM geo_point")
def merc_tile_xy(spark, d):
    x, y = mercator.tile_xy("lon", "lat", 15)
    return get(spark, d, "geo_point").select("event_id", x.alias("x"), y.alias("y"))


PX = "CAST(trunc(least(greatest({0}*256*pow(2.0::DOUBLE, 15) + 0.5, 0), 256*pow(2.0::DOUBLE, 15) - 1)) AS BIGINT)".format


@query("merc_pixel_xy", "event_id b, px b, py b", f"SELECT event_id, {PX('((lon + 180)/360)')} AS px, {PX('(0.5 - ln((1 + sin(radians(lat)))/(1 - sin(radians(lat))))/(4*pi()))')} AS py FROM (SELECT event_id, lon, least(greatest(lat, -85.05112878::DOUBLE), 85.05112878::DOUBLE) AS lat FROM geo_point)")
def merc_pixel_xy(spark, d):
    x, y = mercator.pixel_xy("lon", "lat", 15)
    return get(spark, d, "geo_point").select("event_id", x.alias("px"), y.alias("py"))


@query("merc_inverse", "event_id b, lon d, lat d", "SELECT event_id, 360*x AS lon, 90 - 360*atan(exp(-y*2*pi()))/pi() AS lat FROM (SELECT event_id, least(event_id*7919 % 2000000, 256*pow(2.0::DOUBLE, 12) - 1)/(256*pow(2.0::DOUBLE, 12)) - 0.5 AS x, 0.5 - least(event_id*104729 % 2000000, 256*pow(2.0::DOUBLE, 12) - 1)/(256*pow(2.0::DOUBLE, 12)) AS y FROM events)")
def merc_inverse(spark, d):
    from tilewright.session import table

    lon, lat = mercator.inverse(F.col("event_id") * 7919 % 2000000, F.col("event_id") * 104729 % 2000000, 12)
    return table(spark, d, "events").select("event_id", lon.alias("lon"), lat.alias("lat"))


@query("quadkey", "event_id b, key v, parent v, x b, y b", f"SELECT event_id, {quadkey('x', 'y', 12)} AS key, left({quadkey('x', 'y', 12)}, 10) AS parent, x, y FROM (SELECT event_id, {MX('lon', 12)} AS x, {m_y('lat', 12)} AS y FROM geo_point)")
def quadkey_(spark, d):
    x, y = mercator.tile_xy("lon", "lat", 12)
    t = get(spark, d, "geo_point").select("event_id", mercator.quadkey(x, y, 12).alias("key"))
    x, y = mercator.quadkey_xy("key")  # the inverse: must give the tile again
    return t.select("event_id", "key", mercator.parent_key("key", 2).alias("parent"), x.alias("x"), y.alias("y"))


GR = "(cos(radians(least(greatest(lat, -85.05112878::DOUBLE), 85.05112878::DOUBLE)))*2*pi()*6378137/(256*pow(2.0::DOUBLE, 17)))"


@query("ground_resolution", "event_id b, m d, scale d", f"SELECT event_id, {GR} AS m, {GR}*96/0.0254::DOUBLE AS scale FROM geo_point")
def ground_resolution(spark, d):
    return get(spark, d, "geo_point").select("event_id", mercator.ground_resolution("lat", 17).alias("m"), mercator.map_scale("lat", 17).alias("scale"))


@query("zoom_resolution_label", "p_partkey b, zoom b, metres d", "SELECT p_partkey, zoom, round(2*pi()*6378137/(256*pow(2.0::DOUBLE, zoom)), 2) AS metres FROM (SELECT p_partkey, CAST(12 + p_size % 9 AS BIGINT) AS zoom FROM part)")
def zoom_resolution_label(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey", "12L + p_size % 9 AS zoom")
    return t.withColumn("metres", F.round(mercator.ground_resolution(F.lit(0.0), "zoom"), 2))


@query("mercator_y", "event_id b, y d", f"SELECT event_id, {MY('lat')} AS y FROM geo_point")
def mercator_y(spark, d):
    return get(spark, d, "geo_point").select("event_id", mercator.mercator_y("lat").alias("y"))


@query("source_col_row", "event_id b, c d, linear d, merc d", f"SELECT event_id, (lon + 71.85::DOUBLE)/0.0001::DOUBLE AS c, (lat + 32.4::DOUBLE)/(-0.0001::DOUBLE) AS linear, ({MY('lat')} - {MY('-32.4::DOUBLE')})*6000/({MY('(-32.4::DOUBLE + 6000*(-0.0001::DOUBLE))')} - {MY('-32.4::DOUBLE')}) AS merc FROM probe")
def source_col_row(spark, d):
    y, st = F.lit(-32.4), F.lit(-0.0001)
    return get(spark, d, "probe").select("event_id", mercator.source_col("lon", F.lit(-71.85), F.lit(0.0001)).alias("c"), mercator.source_row("lat", y, st).alias("linear"), mercator.source_row("lat", y, st, F.lit(6000)).alias("merc"))


@query("bbox_overlap", "a b, b b", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM geo_box x JOIN geo_box y ON x.s_suppkey < y.s_suppkey AND x.w < y.e AND y.w < x.e AND x.s < y.n AND y.s < x.n")
def bbox_overlap(spark, d):
    from tilewright.operators.rangejoin import box_join

    t = get(spark, d, "geo_box")
    return box_join(t, t, cell=2.0).where("a.s_suppkey < b.s_suppkey").select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("geo_offset", "s_suppkey b, w d, e d, s d, n d", "SELECT s_suppkey, lon - 5/(111.32::DOUBLE*cos(radians(lat))) AS w, lon + 5/(111.32::DOUBLE*cos(radians(lat))) AS e, lat - 5/110.9::DOUBLE AS s, lat + 5/110.9::DOUBLE AS n FROM (SELECT s_suppkey, (w + e)/2 AS lon, (s + n)/2 AS lat FROM geo_box)")
def geo_offset(spark, d):
    t = get(spark, d, "geo_box").select("s_suppkey", ((F.col("w") + F.col("e")) / 2).alias("lon"), ((F.col("s") + F.col("n")) / 2).alias("lat"))
    kx, ky = grid.km_per_degree("lat")
    return t.select("s_suppkey", (F.col("lon") - 5 / kx).alias("w"), (F.col("lon") + 5 / kx).alias("e"), (F.col("lat") - 5 / ky).alias("s"), (F.col("lat") + 5 / ky).alias("n"))


@query("choose_levels", "o_orderkey b, levels v", "SELECT o_orderkey, array_to_string(list_filter(range(CAST(s AS BIGINT), 16), lambda l : l <= least(z - 3, 14) AND (l = s OR l >= least(z - 5, 14))), ',') AS levels FROM (SELECT o_orderkey, CAST(9 + o_orderkey % 4 AS BIGINT) AS s, CAST(12 + o_custkey % 9 AS BIGINT) AS z FROM orders)")
def choose_levels(spark, d):
    from tilewright.operators.jobs import choose_levels as chosen

    t = table(spark, d, "orders").selectExpr("o_orderkey", "9L + o_orderkey % 4 AS size", "12L + o_custkey % 9 AS zoom")
    return t.select("o_orderkey", F.array_join(chosen("size", "zoom"), ",").alias("levels"))


@query("run_preconditions", "c_custkey b, problem v", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND 9 + c_custkey % 12 > 16 THEN 'zoom too deep' WHEN c_custkey % 4 IN (1, 2) AND c_custkey % 3 = 0 THEN 'key missing' ELSE 'ok' END AS problem FROM customer")
def run_preconditions(spark, d):
    from tilewright.operators.jobs import precondition
    from tilewright.session import table

    source = F.element_at(F.array(F.lit("usgs"), F.lit("mapbox"), F.lit("here"), F.lit("bing")), (F.col("c_custkey") % 4 + 1).cast("int"))
    key = F.when(F.col("c_custkey") % 3 != 0, F.lit("k"))
    return table(spark, d, "customer").select("c_custkey", precondition(source, 9 + F.col("c_custkey") % 12, key).alias("problem"))


@query("url_template", "event_id b, xyz v, tms v, quad v, wms v", f"""SELECT event_id, printf('http://t/%d/%d/%d.png', CAST(12 AS BIGINT), x, y) AS xyz, printf('http://t/%d/%d/%d.png', CAST(12 AS BIGINT), x, 4096 - y - 1) AS tms, 'http://t/' || {quadkey('x', 'y', 12)} AS quad, 'http://t?bbox=' || x || ',' || y || '&w=256&h=256' AS wms FROM (SELECT event_id, {MX('lon', 12)} AS x, {m_y('lat', 12)} AS y FROM geo_point)""")
def url_template(spark, d):
    x, y = mercator.tile_xy("lon", "lat", 12)
    t = get(spark, d, "geo_point").select("event_id", x.alias("x"), y.alias("y"))
    made = lambda s, template, **k: mercator.url(template, "x", "y", F.lit(12), s, **k)
    box = F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string"))
    return t.select("event_id", made("xyz", "http://t/{z}/{x}/{y}.png").alias("xyz"), made("tms", "http://t/{z}/{x}/{y}.png").alias("tms"), made("quadkey", "http://t/{quadkey}").alias("quad"), made("wms", "http://t?bbox={bbox}&w={width}&h={height}", bbox=box).alias("wms"))


@query("reproject_3006", "event_id b, northing d, easting d")
def reproject_3006(spark, d):
    t = get(spark, d, "geo_point").selectExpr("event_id", "10 + (lon + 180)/30 AS lon", "55 + (lat + 80)/12 AS lat")
    n, e = mercator.sweref99tm("lat", "lon")
    return t.select("event_id", n.alias("northing"), e.alias("easting"))


CURVE = "[" + ",".join(map(str, colour.curve())) + "]"


@query("tone_curve", "y b, x b, r b, g b, b b", f"SELECT y, x, list_extract({CURVE}, CAST(r + 1 AS BIGINT)) AS r, list_extract({CURVE}, CAST(g + 1 AS BIGINT)) AS g, list_extract({CURVE}, CAST(b + 1 AS BIGINT)) AS b FROM raster")
def tone_curve(spark, d):
    c = colour.curve()
    return get(spark, d, "raster").select("y", "x", *[colour.apply_curve(k, c).alias(k) for k in "rgb"])


RISING = f"(SELECT i - 1 AS i, list_max(list_slice({CURVE}, 1, i)) AS v FROM range(1, 257) r(i))"


@query("tone_curve_inverse", "y b, x b, r d, g d, b d", "SELECT raster.y, raster.x, ir.x AS r, ig.x AS g, ib.x AS b FROM raster JOIN inv ir ON ir.v = raster.r JOIN inv ig ON ig.v = raster.g JOIN inv ib ON ib.v = raster.b",
       f"""rising AS {RISING}, inv AS (SELECT t.v, CASE WHEN k = 255 THEN 255 ELSE k + (t.v - lo.v)::DOUBLE/(hi.v - lo.v) END AS x FROM (SELECT v, (SELECT max(i) FROM rising WHERE rising.v <= t.v) AS k FROM range(256) t(v)) t JOIN rising lo ON lo.i = k LEFT JOIN rising hi ON hi.i = k + 1)""")
def tone_curve_inverse(spark, d):
    inverse = F.lit(colour.inverse_curve(colour.curve()))
    return get(spark, d, "raster").select("y", "x", *[F.element_at(inverse, (F.col(c) + 1).cast("int")).alias(c) for c in "rgb"])


@query("rgb565", "y b, x b, packed b, r b, g b, b b", "SELECT y, x, v AS packed, ((v >> 11) & 31)*8 + (((v >> 11) & 31) >> 2) AS r, ((v >> 5) & 63)*4 + (((v >> 5) & 63) >> 4) AS g, (v & 31)*8 + ((v & 31) >> 2) AS b FROM (SELECT y, x, CAST((r // 8)*2048 + (g // 4)*32 + b // 8 AS BIGINT) AS v FROM raster)")
def rgb565(spark, d):
    t = get(spark, d, "raster").select("y", "x", colour.pack565("r", "g", "b").alias("packed"))
    r, g, b = colour.unpack565("packed")
    return t.select("y", "x", "packed", r.alias("r"), g.alias("g"), b.alias("b"))


@query("km_per_deg", "event_id b, kx d, ky d", "SELECT event_id, 111.32::DOUBLE*cos(radians(lat)) AS kx, 110.9::DOUBLE AS ky FROM geo_point")
def km_per_deg(spark, d):
    kx, ky = grid.km_per_degree("lat")
    return get(spark, d, "geo_point").select("event_id", kx.alias("kx"), ky.alias("ky"))
