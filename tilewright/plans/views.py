"""Domain-shaped views of the given tables: the Spark side, and DuckDB text that gives equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import table

SPARK: dict = {}
DUCK: dict[str, str] = {}


def view(name: str, duck: str):
    def put(f):
        SPARK[name] = f
        DUCK[name] = duck
        return f

    return put


def get(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return SPARK[name](spark, sf_dir)


@view("geo_point", "SELECT event_id, (user_id*7919 % 36000)/100.0::DOUBLE - 180 AS lon, (event_id*104729 % 16000)/100.0::DOUBLE - 80 AS lat FROM events")
def geo_point(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "(user_id*7919 % 36000)/100D - 180 AS lon", "(event_id*104729 % 16000)/100D - 80 AS lat")


@view("probe", "SELECT event_id, -71.85::DOUBLE + (user_id*7919 % 7000)*0.0001::DOUBLE AS lon, -33.3::DOUBLE + (event_id*104729 % 16000)*0.0001::DOUBLE AS lat FROM events")
def probe(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "-71.85D + (user_id*7919 % 7000)*0.0001D AS lon", "-33.3D + (event_id*104729 % 16000)*0.0001D AS lat")


@view("geo_box", """SELECT s_suppkey, w, w + 1 + s_suppkey % 5 AS e, s, s + 1 + s_suppkey % 3 AS n FROM (SELECT s_suppkey, (s_suppkey*3571 % 3400)/100.0::DOUBLE - 17 AS w, (s_suppkey*7109 % 1400)/100.0::DOUBLE - 7 AS s FROM supplier)""")
def geo_box(spark, d):
    t = table(spark, d, "supplier").selectExpr("s_suppkey", "(s_suppkey*3571 % 3400)/100D - 17 AS w", "(s_suppkey*7109 % 1400)/100D - 7 AS s")
    return t.selectExpr("s_suppkey", "w", "w + 1 + s_suppkey % 5 AS e", "s", "s + 1 + s_suppkey % 3 AS n")


@view("grid_square", "SELECT c_custkey, (c_custkey*7919 % 36000)/100.0::DOUBLE - 180 AS lon, (c_custkey*104729 % 16000)/100.0::DOUBLE - 80 AS lat, CAST(9 + c_custkey % 6 AS BIGINT) AS level FROM customer")
def grid_square(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", "(c_custkey*7919 % 36000)/100D - 180 AS lon", "(c_custkey*104729 % 16000)/100D - 80 AS lat", "CAST(9 + c_custkey % 6 AS BIGINT) AS level")


@view("catalog_file", """SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'readme_' || p_partkey || '.txt' WHEN p_partkey % 19 = 0 THEN printf('map_%02d_%04x.ttc', level, tx) ELSE printf('map_%02d_%04x_%04x', level, tx * st, ty * st) || CASE WHEN p_partkey % 5 = 0 THEN '_mask' ELSE '' END || '.ttc' END AS name, 'square' || (p_partkey % 11) AS folder, CAST(p_size AS BIGINT) AS bytes
FROM (SELECT *, CAST(9 + p_partkey % 6 AS BIGINT) AS level, CAST((p_partkey*7) % 512 AS BIGINT) AS tx, CAST((p_partkey*13) % 512 AS BIGINT) AS ty, CAST(pow(2, 16 - (9 + p_partkey % 6)) AS BIGINT) AS st FROM part)""")
def catalog_file(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey", "p_size", "CAST(9 + p_partkey % 6 AS BIGINT) AS level", "(p_partkey*7) % 512 AS tx", "(p_partkey*13) % 512 AS ty", "CAST(pow(2D, 16 - (9 + p_partkey % 6)) AS BIGINT) AS st")
    return t.selectExpr(
        "p_partkey",
        """CASE WHEN p_partkey % 17 = 0 THEN concat('readme_', p_partkey, '.txt') WHEN p_partkey % 19 = 0 THEN format_string('map_%02d_%04x.ttc', level, tx)
           ELSE concat(format_string('map_%02d_%04x_%04x', level, tx * st, ty * st), CASE WHEN p_partkey % 5 = 0 THEN '_mask' ELSE '' END, '.ttc') END AS name""",
        "concat('square', p_partkey % 11) AS folder", "CAST(p_size AS BIGINT) AS bytes",
    )


@view("coast_point", "SELECT c_custkey AS seq, -33::DOUBLE + c_custkey*0.006::DOUBLE AS lat, -71.5::DOUBLE + ((c_custkey*37) % 23 - 11)*0.004::DOUBLE AS lon FROM customer")
def coast_point(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey AS seq", "-33D + c_custkey*0.006D AS lat", "-71.5D + ((c_custkey*37) % 23 - 11)*0.004D AS lon")


@view("coast_segment", "SELECT * FROM (SELECT seq, lon AS a_lon, lat AS a_lat, lead(lon) OVER (ORDER BY seq) AS b_lon, lead(lat) OVER (ORDER BY seq) AS b_lat FROM coast_point) WHERE b_lon IS NOT NULL")
def coast_segment(spark, d):
    from tilewright.operators.lines import segments

    return segments(coast_point(spark, d).withColumn("line", F.lit(0)), closed=False).drop("line")


#: The latitudes to which the coast is carried on: beyond those of the probes.
FIELD_SOUTH, FIELD_NORTH = -33.5, -31.5


@view("coast_line", f"SELECT a_lon, a_lat, b_lon, b_lat FROM coast_segment UNION ALL SELECT lon, {FIELD_SOUTH}::DOUBLE, lon, lat FROM coast_point WHERE seq = 0 UNION ALL SELECT lon, {FIELD_NORTH}::DOUBLE, lon, lat FROM coast_point WHERE seq = (SELECT max(seq) FROM coast_point) AND lat < {FIELD_NORTH}")
def coast_line(spark, d):
    from tilewright.operators.lines import extended

    return extended(coast_segment(spark, d), FIELD_SOUTH, FIELD_NORTH)


#: A diamond, of as many points as there are suppliers.
RING_AT = "{0}.05{1}*(abs(({2} + {3}) % 24 - 12) - 6)/6"


@view("ring_point", f"SELECT seq, -32.7::DOUBLE + {RING_AT.format('0', '::DOUBLE', 't', 0)} AS lat, -71.75::DOUBLE + {RING_AT.format('0', '::DOUBLE', 't', 6)} AS lon FROM (SELECT s_suppkey AS seq, s_suppkey*24.0::DOUBLE/(SELECT count(*) FROM supplier) AS t FROM supplier)")
def ring_point(spark, d):
    t = table(spark, d, "supplier")
    t = t.crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("n")))).selectExpr("s_suppkey AS seq", "s_suppkey*24D/n AS t")  # one row
    return t.selectExpr("seq", f"-32.7D + {RING_AT.format('0', 'D', 't', 0)} AS lat", f"-71.75D + {RING_AT.format('0', 'D', 't', 6)} AS lon")


@view("ring_segment", "SELECT seq, lon AS a_lon, lat AS a_lat, coalesce(lead(lon) OVER (ORDER BY seq), first_value(lon) OVER (ORDER BY seq)) AS b_lon, coalesce(lead(lat) OVER (ORDER BY seq), first_value(lat) OVER (ORDER BY seq)) AS b_lat FROM ring_point")
def ring_segment(spark, d):
    from tilewright.operators.lines import segments

    return segments(ring_point(spark, d).withColumn("line", F.lit(0)), closed=True).drop("line")


@view("stroke_point", "SELECT CAST(event_id // 20 AS BIGINT) AS stroke, CAST(event_id % 20 AS BIGINT) AS seq, -33::DOUBLE + (event_id*31 % 1000)*0.001::DOUBLE AS lat, -71.5::DOUBLE + (user_id*17 % 1000)*0.001::DOUBLE AS lon FROM events")
def stroke_point(spark, d):
    return table(spark, d, "events").selectExpr("event_id div 20 AS stroke", "event_id % 20 AS seq", "-33D + (event_id*31 % 1000)*0.001D AS lat", "-71.5D + (user_id*17 % 1000)*0.001D AS lon")


RASTER = 64


@view("raster", f"""SELECT y, x, CASE q WHEN 0 THEN x*4 WHEN 1 THEN 37 WHEN 2 THEN h % 256 ELSE c*255 END AS r, CASE q WHEN 0 THEN y*4 WHEN 1 THEN 121 WHEN 2 THEN (h // 256) % 256 ELSE 255 - c*255 END AS g,
CASE q WHEN 0 THEN (x + y)*2 WHEN 1 THEN 200 WHEN 2 THEN (h // 65536) % 256 ELSE c*128 END AS b, (x*7 + y*13 + n) % 11 > 2 AS have
FROM (SELECT y, x, (CASE WHEN x >= {RASTER // 2} THEN 1 ELSE 0 END) + (CASE WHEN y >= {RASTER // 2} THEN 2 ELSE 0 END) AS q, coalesce(h, 0) AS h, coalesce(n, 0) AS n, (x // 8 + y // 8) % 2 AS c FROM (SELECT i, i // {RASTER} AS y, i % {RASTER} AS x FROM range({RASTER * RASTER}) t(i))
LEFT JOIN (SELECT (l_orderkey*7 + l_linenumber*4093) % {RASTER * RASTER} AS i, CAST(sum((l_partkey*73856093 + l_suppkey*19349663) % 16777216) % 16777216 AS BIGINT) AS h, count(*) AS n FROM lineitem GROUP BY 1) USING (i))""")
def raster(spark, d):
    """Order lines summed by pixel: their noise in one quadrant, their number in the holes."""
    from tilewright.operators.raster import test_pattern

    lines = table(spark, d, "lineitem").groupBy(F.expr(f"(l_orderkey*7 + l_linenumber*4093) % {RASTER * RASTER}").alias("i"))
    lines = lines.agg((F.sum(F.expr("(l_partkey*73856093 + l_suppkey*19349663) % 16777216")) % 16777216).alias("h"), F.count(F.lit(1)).alias("n"))
    return test_pattern(spark, RASTER, lines)


@view("place", "SELECT c_custkey AS place_id, 'place' || (c_custkey % 40) AS name, (c_custkey*7919 % 3600)/100.0::DOUBLE - 90 AS lon, (c_custkey*104729 % 1600)/100.0::DOUBLE - 40 AS lat, CAST(abs(floor(c_acctbal)) AS BIGINT) AS population, c_nationkey % 3 AS kind FROM customer")
def place(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey AS place_id", "concat('place', c_custkey % 40) AS name", "(c_custkey*7919 % 3600)/100D - 90 AS lon", "(c_custkey*104729 % 1600)/100D - 40 AS lat", "CAST(abs(floor(c_acctbal)) AS BIGINT) AS population", "c_nationkey % 3 AS kind")


@view("tile_image", "SELECT o_orderkey, CAST(o_custkey % 64 AS BIGINT) AS tile_x, CAST(o_orderkey % 48 AS BIGINT) AS tile_y, CAST(16 AS BIGINT) AS zoom, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 404 ELSE 500 END AS http, CAST(floor(o_totalprice) AS BIGINT) % 5 AS bytes, o_orderkey % 3 > 0 AS has_meta, o_orderkey % 7 = 0 AS no_tile, o_orderkey % 5 > 0 AS is_image FROM orders")
def tile_image(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_custkey % 64 AS tile_x", "o_orderkey % 48 AS tile_y", "16L AS zoom", "CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 404 ELSE 500 END AS http",
        "CAST(floor(o_totalprice) AS BIGINT) % 5 AS bytes", "o_orderkey % 3 > 0 AS has_meta", "o_orderkey % 7 = 0 AS no_tile", "o_orderkey % 5 > 0 AS is_image",
    )


NL = " || chr(10) || "


@view(
    "job_text",
    "SELECT n_nationkey, '<[file][][]<[tm_config][aerial_images][]<[string8][folder_source_files][./src' || n_nationkey || '/]>'" + NL + "'<[bool][write_ttc_files][true]><[bool][do_heightmaps][false]>'" + NL + "'<[list][region_list][]'" + NL
    + "'<[region][element][0]<[int][level][9]><[vector2_float64][lonlat_min][' || (-71.5 + n_nationkey) || ' -33.0]><[vector2_float64][lonlat_max][' || (-70.25 + n_nationkey) || ' -34.5]><[bool][write_images_with_mask][true]>>'" + NL
    + "CASE WHEN n_nationkey % 2 = 0 THEN '<[region][element][1]<[int][level][12]><[vector2_float64][lonlat_min][' || (-71.0 + n_nationkey) || ' -33.25]><[vector2_float64][lonlat_max][' || (-70.5 + n_nationkey) || ' -33.75]>>' || chr(10) ELSE '' END || '>>>' AS text FROM nation",
)
def job_text(spark, d):
    return table(spark, d, "nation").selectExpr(
        "n_nationkey",
        r"""concat('<[file][][]<[tm_config][aerial_images][]<[string8][folder_source_files][./src', n_nationkey, '/]>', '\n', '<[bool][write_ttc_files][true]><[bool][do_heightmaps][false]>', '\n', '<[list][region_list][]', '\n',
        '<[region][element][0]<[int][level][9]><[vector2_float64][lonlat_min][', -71.5 + n_nationkey, ' -33.0]><[vector2_float64][lonlat_max][', -70.25 + n_nationkey, ' -34.5]><[bool][write_images_with_mask][true]>>', '\n',
        CASE WHEN n_nationkey % 2 = 0 THEN concat('<[region][element][1]<[int][level][12]><[vector2_float64][lonlat_min][', -71.0 + n_nationkey, ' -33.25]><[vector2_float64][lonlat_max][', -70.5 + n_nationkey, ' -33.75]>>', '\n') ELSE '' END, '>>>') AS text""",
    )
