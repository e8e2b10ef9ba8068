"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import grid, mercator
from tilewright.operators import fields, lines, rangejoin, rasters_more
from tilewright.plans.registry import query
from tilewright.plans.scalars import MX, gx, gy, lat_of, lon_of, m_y, quadkey
from tilewright.plans.views import get
from tilewright.session import table



@query("join_tile_source", "tile b, src b", f"""SELECT t.id AS tile, b.s_suppkey AS src FROM (SELECT x*100 + y AS id, {lon_of('x', 6)} AS w, {lon_of('x + 1', 6)} AS e, {lat_of('y', 6)} AS s, {lat_of('y + 1', 6)} AS n FROM range(26, 38) a(x) CROSS JOIN range(26, 38) b(y)) t JOIN geo_box b ON t.w < b.e AND b.w < t.e AND t.s < b.n AND b.s < t.n""")
def join_tile_source(spark, d):
    t = spark.range(26, 38).select(F.col("id").alias("x")).crossJoin(spark.range(26, 38).select(F.col("id").alias("y")))
    t = t.select((F.col("x") * 100 + F.col("y")).alias("id"), *[c.alias(k) for k, c in grid.square_edges("x", "y", 6).items()])
    return rangejoin.box_join(t, get(spark, d, "geo_box"), 2.0).select(F.col("a.id").alias("tile"), F.col("b.s_suppkey").alias("src"))


@query("join_point_box", "event_id b, s_suppkey b", "SELECT event_id, s_suppkey FROM geo_point p JOIN geo_box b ON p.lon >= b.w AND p.lon < b.e AND p.lat >= b.s AND p.lat < b.n")
def join_point_box(spark, d):
    return rangejoin.point_in_box(get(spark, d, "geo_point"), get(spark, d, "geo_box"), 1.0).select("event_id", "s_suppkey")


# two sources over a grid of 48 x 48 centres: one shifted, with holes, the other whole
CENTRES = "(SELECT i // 48 AS cy, i % 48 AS cx FROM range(2304) t(i))"
SOURCES = "(SELECT 0 AS priority, y, x, r, g, b, have FROM raster UNION ALL SELECT 1, y, x, b, g, r, true FROM raster)"


@query("join_pixel_source", "cy b, cx b, r b, g b, b b, priority b", f"""SELECT cy, cx, r, g, b, priority FROM (SELECT *, row_number() OVER (PARTITION BY cy, cx ORDER BY priority) AS k FROM {CENTRES} c JOIN {SOURCES} s ON s.x = CAST(floor(cx*1.25 - 3*(1 - s.priority)) AS BIGINT) AND s.y = CAST(floor(cy*1.25 + 1) AS BIGINT) WHERE have) WHERE k = 1""")
def join_pixel_source(spark, d):
    c = spark.range(2304).select(F.expr("id div 48").alias("cy"), (F.col("id") % 48).alias("cx"))
    src = get(spark, d, "raster")
    other = src.select("y", "x", F.col("b").alias("r"), "g", F.col("r").alias("b"), F.lit(True).alias("have"))
    found = [rasters_more.sampled(c, s, F.col("cx") * 1.25 - 3 * (1 - k), F.col("cy") * 1.25 + 1, 64, 64).withColumn("priority", F.lit(k)) for k, s in enumerate((src, other))]
    return rasters_more.first_source(found[0].unionByName(found[1]), ["cy", "cx"])


FIELD = "(SELECT x AS i, y AS j, r::DOUBLE AS v FROM raster)"
PLACES = "(SELECT event_id, (event_id*37 % 700)/10.0::DOUBLE - 2 AS fi, (event_id*53 % 690)/10.0::DOUBLE - 1.5 AS fj FROM events)"


def _places(spark, d):
    from tilewright.session import table

    return table(spark, d, "events").selectExpr("event_id", "(event_id*37 % 700)/10D - 2 AS fi", "(event_id*53 % 690)/10D - 1.5D AS fj")


def _field(spark, d):
    return get(spark, d, "raster").select(F.col("x").alias("i"), F.col("y").alias("j"), F.col("r").cast("double").alias("v"))


@query("join_bilinear_field", "event_id b, v d", f"""SELECT event_id, (a.v*(1 - u)*(1 - w) + b.v*u*(1 - w) + c.v*(1 - u)*w + e.v*u*w) AS v FROM (SELECT *, ci - i0 AS u, cj - j0 AS w FROM (SELECT *, least(floor(ci), 62) AS i0, least(floor(cj), 62) AS j0 FROM (SELECT event_id, least(greatest(fi, 0), 63) AS ci, least(greatest(fj, 0), 63) AS cj FROM {PLACES}))) p
 JOIN {FIELD} a ON a.i = i0 AND a.j = j0 JOIN {FIELD} b ON b.i = i0 + 1 AND b.j = j0 JOIN {FIELD} c ON c.i = i0 AND c.j = j0 + 1 JOIN {FIELD} e ON e.i = i0 + 1 AND e.j = j0 + 1""")
def join_bilinear_field(spark, d):
    return fields.bilinear(_places(spark, d), _field(spark, d), ["event_id"], "v", 64, 64)


@query("join_nearest_field", "event_id b, v d", f"SELECT event_id, v FROM (SELECT event_id, CAST(least(greatest(round_even(fi, 0), 0), 63) AS BIGINT) AS i, CAST(least(greatest(round_even(fj, 0), 0), 63) AS BIGINT) AS j FROM {PLACES}) JOIN {FIELD} USING (i, j)")
def join_nearest_field(spark, d):
    return fields.nearest(_places(spark, d), _field(spark, d), ["event_id"], 64, 64)


@query("join_field_range", "event_id b, least d, most d", f"""SELECT event_id, min(v) AS least, max(v) AS most FROM (SELECT *, fi + 3 AS fi2, fj + 2 AS fj2 FROM {PLACES}) p JOIN {FIELD} f
 ON f.i BETWEEN least(greatest(floor(fi), 0), 63) AND least(greatest(floor(fi2) + 1, 0), 63) AND f.j BETWEEN least(greatest(floor(fj), 0), 63) AND least(greatest(floor(fj2) + 1, 0), 63) GROUP BY event_id""")
def join_field_range(spark, d):
    b = _places(spark, d).select("event_id", F.col("fi").alias("i0"), (F.col("fi") + 3).alias("i1"), F.col("fj").alias("j0"), (F.col("fj") + 2).alias("j1"))
    return fields.range_under(b, _field(spark, d), ["event_id"], "v", 64, 64)


@query("join_tile_stitch", "x b, y b, px b, py b, present l", "SELECT x, y, x*256 AS px, y*256 AS py, EXISTS (SELECT 1 FROM tile_image t WHERE t.tile_x = x AND t.tile_y = y AND t.http = 200) AS present FROM range(70) a(x) CROSS JOIN range(50) b(y)")
def join_tile_stitch(spark, d):
    g = spark.range(70).select(F.col("id").alias("x")).crossJoin(spark.range(50).select(F.col("id").alias("y")))
    return fields.stitch(g, get(spark, d, "tile_image").where("http = 200"), 256)


@query("join_parent_child", "c_custkey b, px b, py b, qx b, north l", f"SELECT c_custkey, tx // 2 AS px, ty // 2 AS py, tx % 2 AS qx, ty % 2 = 1 AS north FROM (SELECT c_custkey, CAST(floor({gx('lon', 'level')}) AS BIGINT) AS tx, CAST(floor({gy('lat', 'level')}) AS BIGINT) AS ty FROM grid_square)")
def join_parent_child(spark, d):
    return fields.parents(get(spark, d, "grid_square").select("c_custkey", grid.tile_x("lon", "level").alias("tx"), grid.tile_y("lat", "level").alias("ty")))


@query("join_line_square", "square b, line b, part v", """SELECT c_custkey AS square, coalesce(line, -1) AS line, CASE WHEN line IS NULL THEN 'none' WHEN NOT has_coast THEN 'islands' WHEN s >= lo AND n <= hi AND near THEN 'coast and islands' WHEN s >= lo AND n <= hi THEN 'coast' ELSE 'outside' END AS part
FROM sq LEFT JOIN l ON country = file AND ((has_coast AND s <= hi AND n >= lo) OR (NOT has_coast AND rn + 0.06::DOUBLE >= s AND rs - 0.06::DOUBLE <= n AND re + 0.1::DOUBLE >= w AND rw - 0.1::DOUBLE <= e)) LEFT JOIN LATERAL (SELECT rn + 0.06::DOUBLE >= s AND rs - 0.06::DOUBLE <= n AND re + 0.1::DOUBLE >= w AND rw - 0.1::DOUBLE <= e AS near) ON true""",
       """sq AS (SELECT c_custkey, c_nationkey % 5 AS country, lon AS w, lon + 0.7::DOUBLE AS e, lat AS s, lat + 0.6::DOUBLE AS n FROM grid_square JOIN customer USING (c_custkey)),
 l AS (SELECT s_suppkey AS line, s_nationkey % 5 AS file, s_suppkey % 3 > 0 AS has_coast, s AS lo, s + 20 AS hi, w AS rw, w + 3 AS re, s AS rs, s + 2 AS rn FROM (SELECT s_suppkey, s_nationkey, (s_suppkey*3571 % 34000)/100.0::DOUBLE - 170 AS w, (s_suppkey*7109 % 14000)/100.0::DOUBLE - 70 AS s FROM supplier))""")
def join_line_square(spark, d):
    """Squares and the line files of their country: the coast's stretch and the islands' box decide what of a file a square gets."""
    country = table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey % 5 AS file")
    squares = get(spark, d, "grid_square").join(country, "c_custkey").selectExpr("c_custkey AS square", "file", "lon AS w", "lon + 0.7D AS e", "lat AS s", "lat + 0.6D AS n")
    t = table(spark, d, "supplier").selectExpr("s_suppkey AS line", "s_nationkey % 5 AS file", "s_suppkey % 3 > 0 AS has_coast", "(s_suppkey*3571 % 34000)/100D - 170 AS w", "(s_suppkey*7109 % 14000)/100D - 70 AS s")
    files = t.selectExpr("line", "file", "has_coast", "s AS lo", "s + 20 AS hi", "w - 0.1D AS rw", "w + 3 + 0.1D AS re", "s - 0.06D AS rs", "s + 2 + 0.06D AS rn")
    return lines.for_squares(squares, files, ["file"]).select("square", F.coalesce("line", F.lit(-1)).alias("line"), "part")


KX = "(111.32::DOUBLE*cos(radians(({0} + {1})/2)))".format
DIST = f"""(SELECT p.event_id, min(sqrt((px - t*dx)*(px - t*dx) + (py - t*dy)*(py - t*dy))) AS km FROM (SELECT *, CASE WHEN dx*dx + dy*dy = 0 THEN 0 ELSE least(greatest((px*dx + py*dy)/(dx*dx + dy*dy), 0), 1) END AS t FROM (
  SELECT event_id, (lon - a_lon)*{KX('lat', 'a_lat')} AS px, (lat - a_lat)*110.9::DOUBLE AS py, (b_lon - a_lon)*{KX('b_lat', 'a_lat')} AS dx, (b_lat - a_lat)*110.9::DOUBLE AS dy FROM probe CROSS JOIN coast_segment)) p GROUP BY event_id)"""


@query("join_dist_segments", "event_id b, km d", f"SELECT event_id, least(km, 12.112::DOUBLE) AS km FROM {DIST}")
def join_dist_segments(spark, d):
    return lines.distances(get(spark, d, "probe"), ["event_id"], get(spark, d, "coast_segment"), 2 * lines.MARGIN_KM + 1)


@query("seg_distance_km", "event_id b, seq b, km d", f"""SELECT event_id, seq, sqrt((px - t*dx)*(px - t*dx) + (py - t*dy)*(py - t*dy)) AS km FROM (SELECT *, least(greatest((px*dx + py*dy)/(dx*dx + dy*dy), 0), 1) AS t FROM (
  SELECT event_id, seq, (lon - a_lon)*{KX('lat', 'a_lat')} AS px, (lat - a_lat)*110.9::DOUBLE AS py, (b_lon - a_lon)*{KX('b_lat', 'a_lat')} AS dx, (b_lat - a_lat)*110.9::DOUBLE AS dy FROM probe JOIN coast_segment ON event_id % 149 = seq))""")
def seg_distance_km(spark, d):
    p, s = get(spark, d, "probe"), get(spark, d, "coast_segment")
    return p.join(s, F.col("event_id") % 149 == F.col("seq")).select("event_id", "seq", lines.segment_distance("lon", "lat", "a_lon", "a_lat", "b_lon", "b_lat").alias("km"))


@query("join_fill_wanted", "event_id b", f"SELECT event_id FROM {DIST} WHERE km <= 5.556::DOUBLE")
def join_fill_wanted(spark, d):
    p = get(spark, d, "probe")
    near = lines.distances(p, ["event_id"], get(spark, d, "coast_segment"), 2 * lines.MARGIN_KM + 1).where(F.col("km") <= lines.MARGIN_KM)
    return p.join(near, "event_id", "left_semi").select("event_id")


@query("join_missing", "o_orderkey b, action v", "SELECT o_orderkey, CASE WHEN bytes > 0 AND has_meta THEN 'skip' WHEN bytes > 0 THEN 'metadata' ELSE 'fetch' END AS action FROM tile_image")
def join_missing(spark, d):
    from tilewright.operators.fetch import plan

    t = get(spark, d, "tile_image")
    images = t.where("bytes > 0").select("o_orderkey", "bytes")
    meta = t.where("has_meta").select("o_orderkey")
    return plan(t.select("o_orderkey"), images, meta, ["o_orderkey"])


@query("join_fill_parent", "event_id b, parent v, ox b, oy b", f"SELECT event_id, left({quadkey('x', 'y', 12)}, 9) AS parent, x % 8 AS ox, y % 8 AS oy FROM (SELECT event_id, {MX('lon', 12)} AS x, {m_y('lat', 12)} AS y FROM geo_point)")
def join_fill_parent(spark, d):
    x, y = mercator.tile_xy("lon", "lat", 12)
    t = get(spark, d, "geo_point").select("event_id", x.alias("x"), y.alias("y"))
    t = t.withColumn("parent", mercator.parent_key(mercator.quadkey("x", "y", 12), 3))
    fetched = t.select("parent").distinct()  # each parent is fetched once
    return t.join(fetched, "parent").select("event_id", "parent", F.col("x").bitwiseAND(7).alias("ox"), F.col("y").bitwiseAND(7).alias("oy"))


@query("join_near_squares", "a b, b b", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM geo_box x JOIN geo_box y ON x.s_suppkey <> y.s_suppkey AND x.w - 0.1::DOUBLE < y.e AND y.w < x.e + 0.1::DOUBLE AND x.s - 0.1::DOUBLE < y.n AND y.s < x.n + 0.1::DOUBLE")
def join_near_squares(spark, d):
    t = get(spark, d, "geo_box")
    halo = t.select("s_suppkey", *[(F.col(c) + k).alias(c) for c, k in (("w", -0.1), ("e", 0.1), ("s", -0.1), ("n", 0.1))])
    return rangejoin.crowded_box_join(halo, t, 0.5, [F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b")]).where("a <> b")


@query("join_places_tiles", "place_id b", f"SELECT place_id FROM (SELECT place_id, kind, CAST(floor({gx('lon', 7)}) AS BIGINT) AS x, CAST(floor({gy('lat', 7)}) AS BIGINT) AS y FROM place) WHERE kind <> 0 AND (x, y) IN (SELECT (CAST(floor({gx('lon', 7)}) AS BIGINT), CAST(floor({gy('lat', 7)}) AS BIGINT)) FROM place WHERE kind = 0)")
def join_places_tiles(spark, d):
    x, y = grid.landmark_cell("lon", "lat")
    t = get(spark, d, "place").withColumn("x", x).withColumn("y", y)
    return t.where("kind <> 0").join(t.where("kind = 0").select("x", "y").distinct(), ["x", "y"], "left_semi").select("place_id")


@query("join_stale_tiles", "name v", "SELECT DISTINCT name FROM catalog_file WHERE p_partkey % 3 = 0 AND bytes > 10 AND name NOT IN (SELECT name FROM catalog_file WHERE p_partkey % 2 = 0)")
def join_stale_tiles(spark, d):
    t = get(spark, d, "catalog_file")
    return t.where("p_partkey % 3 = 0 AND bytes > 10").join(t.where("p_partkey % 2 = 0").select("name"), "name", "left_anti").select("name").distinct()
