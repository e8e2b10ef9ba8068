"""Queries of the window-style operators, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.operators import lines, ordered, raster, strokes
from tilewright.plans.registry import query
from tilewright.plans.scalars import gx, quadkey
from tilewright.plans.views import get
from tilewright.session import stored, table


@query("win_rank_priority", "y b, x b, r b, priority b", "SELECT y, x, r, priority FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY priority) AS k FROM (SELECT 0 AS priority, y, x, r, have FROM raster UNION ALL SELECT 1, y, 63 - x, g, true FROM raster) WHERE have) WHERE k = 1")
def win_rank_priority(spark, d):
    t = get(spark, d, "raster")
    a = t.select(F.lit(0).alias("priority"), "y", "x", "r", "have")
    b = t.select(F.lit(1), "y", 63 - F.col("x"), "g", F.lit(True))
    w = Window.partitionBy("y", "x").orderBy("priority")
    return a.union(b).where("have").withColumn("k", F.row_number().over(w)).where("k = 1")


@query("win_runs", "y b, x0 b, x1 b", "SELECT y, min(x) AS x0, max(x) AS x1 FROM (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM raster WHERE have) GROUP BY y, g")
def win_runs(spark, d):
    return raster.runs(get(spark, d, "raster"), "have")


def duck_box(src: str, v: str, k: int, n: int) -> str:
    """k x k mean with edge padding, by clamped joins."""
    p = k // 2
    across = f"SELECT t.y, t.x, avg(s.v) AS v FROM {src} t CROSS JOIN range({-p}, {p + 1}) o(d) JOIN (SELECT y, x, ({v})::DOUBLE AS v FROM {src}) s ON s.y = t.y AND s.x = least(greatest(t.x + d, 0), {n - 1}) GROUP BY t.y, t.x"
    return f"(WITH a AS ({across}) SELECT t.y, t.x, avg(s.v) AS mean FROM a t CROSS JOIN range({-p}, {p + 1}) o(d) JOIN a s ON s.x = t.x AND s.y = least(greatest(t.y + d, 0), {n - 1}) GROUP BY t.y, t.x)"


@query("win_box_blur", "y b, x b, mean d", f"SELECT y, x, mean FROM {duck_box('raster', 'g', 5, 64)}")
def win_box_blur(spark, d):
    return raster.box_mean(get(spark, d, "raster"), "g", 5, 64)


@query("win_local_mean", "y b, x b, mean d", f"SELECT y, x, CASE WHEN m.mean > 1e-6 THEN v.mean/m.mean END AS mean FROM {duck_box('raster', 'g*have::INT', 7, 64)} v JOIN {duck_box('raster', 'have::INT', 7, 64)} m USING (y, x)")
def win_local_mean(spark, d):
    t = get(spark, d, "raster").withColumn("m", F.col("have").cast("int")).withColumn("v", F.col("g") * F.col("m"))
    t = raster.box_mean(raster.box_mean(t, "v", 7, 64, "vm"), "m", 7, 64, "mm")
    return t.select("y", "x", F.when(F.col("mm") > 1e-6, F.col("vm") / F.col("mm")).alias("mean"))


COAST = "(SELECT y, CASE WHEN x > 0 THEN x END AS x FROM (SELECT y, min(x) FILTER (WHERE m >= 0.75 AND n = 8) AS x FROM (SELECT y, x, avg(land::INT) OVER w AS m, count(*) OVER w AS n FROM (SELECT y, x, x > 20 + (y*7) % 13 AND (x + y) % 9 > 0 AS land FROM raster) WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) GROUP BY y))"


def _land(spark, d):
    return get(spark, d, "raster").withColumn("land", F.expr("x > 20 + (y*7) % 13 AND (x + y) % 9 > 0"))


@query("win_coast_column", "y b, x b", f"SELECT y, x FROM {COAST}")
def win_coast_column(spark, d):
    return ordered.coast_column(_land(spark, d), "land", 8)


BUILT = "NOT (y % 5 = 0 AND x = 11 + y % 7)"
BLACK = "x < 4 + y % 9 OR (x BETWEEN 12 AND 14)"


@query("win_coverage_edge", "y b, x b, resolved l", f"""SELECT c.y, CASE WHEN c.x IS NOT NULL THEN coalesce(r.x1 + 1, f.first, 0) END AS x, r.x1 IS NOT NULL AS resolved FROM {COAST} c LEFT JOIN f USING (y)
 LEFT JOIN (SELECT y, max(x1) AS x1 FROM (SELECT y, max(x) AS x1 FROM (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM p JOIN f USING (y) WHERE x >= first AND black) GROUP BY y, g HAVING count(*) >= 6) GROUP BY y) r USING (y)""",
       f"p AS (SELECT r.y, r.x, {BLACK.replace('x', 'r.x').replace('y', 'r.y')} AS black, {BUILT.replace('x', 'r.x').replace('y', 'r.y')} AS built FROM raster r JOIN {COAST} c ON c.y = r.y AND r.x < c.x), f AS (SELECT y, coalesce(max(x) FILTER (WHERE NOT built) + 1, 0) AS first FROM p GROUP BY y)")
def win_coverage_edge(spark, d):
    t = get(spark, d, "raster").withColumn("black", F.expr(BLACK)).withColumn("built", F.expr(BUILT))
    return ordered.coverage_edge(t, "black", "built", ordered.coast_column(_land(spark, d), "land", 8), 6)


@query("win_stretches", "line b, part b, n b, lo d, hi d, lon d", """SELECT line, part, count(*) AS n, min(lat) AS lo, max(lat) AS hi, (SELECT m FROM (SELECT lon AS m, count(*) AS c FROM s i WHERE i.line = s.line AND i.part = s.part GROUP BY lon ORDER BY c DESC, m LIMIT 1)) AS lon FROM s GROUP BY line, part HAVING count(*) >= 20""",
       "s AS (SELECT line, lat, lon, sum(b) OVER (PARTITION BY line ORDER BY lat) AS part FROM (SELECT line, lat, lon, CASE WHEN lat - lag(lat) OVER (PARTITION BY line ORDER BY lat) > 0.02::DOUBLE THEN 1 ELSE 0 END AS b FROM (SELECT user_id % 2 AS line, event_id*0.001::DOUBLE + (event_id // 70)*0.5::DOUBLE AS lat, CAST((event_id*event_id) % 5 AS DOUBLE) AS lon FROM events)))")
def win_stretches(spark, d):
    t = table(spark, d, "events").selectExpr("user_id % 2 AS line", "event_id*0.001D + (event_id div 70)*0.5D AS lat", "CAST((event_id*event_id) % 5 AS DOUBLE) AS lon")
    return ordered.stretches(t)


@query("win_segments", "ring b, seq b, a_lon d, a_lat d, b_lon d, b_lat d", "SELECT 0 AS ring, * FROM (SELECT seq, a_lon, a_lat, b_lon, b_lat FROM coast_segment) UNION ALL SELECT 1, seq, a_lon, a_lat, b_lon, b_lat FROM ring_segment")
def win_segments(spark, d):
    a, b = get(spark, d, "coast_segment"), get(spark, d, "ring_segment")
    return a.withColumn("ring", F.lit(0)).unionByName(b.withColumn("ring", F.lit(1)))


@query("win_longest_join", "line b, ring l, gap d")
def win_longest_join(spark, d):
    t = get(spark, d, "stroke_point").withColumn("line", F.col("stroke") % 5)
    order = stored(strokes.chain_order(t), "chain-order")  # both read it
    return ordered.longest_join(t, order=order).withColumn("ring", F.lit(False)).unionByName(ordered.longest_join(t, rings=True, order=order).withColumn("ring", F.lit(True)))


MORPH = "(SELECT t.y, t.x, {f}(s.have) AS have FROM {src} t JOIN {src} s ON abs(s.y - t.y) <= {r} AND abs(s.x - t.x) <= {r} GROUP BY t.y, t.x)".format


@query("win_dilate", "y b, x b, have l", f"SELECT * FROM {MORPH(f='bool_or', src='raster', r=2)}")
def win_dilate(spark, d):
    return raster.dilate(get(spark, d, "raster").withColumn("have", F.col("have")), "have", 2)


@query("win_erode", "y b, x b, have l", f"SELECT * FROM {MORPH(f='bool_and', src='raster', r=1)}")
def win_erode(spark, d):
    return raster.dilate(get(spark, d, "raster"), "have", 1, erode=True)


@query("win_open", "y b, x b, have l", "SELECT * FROM " + MORPH(f="bool_or", src="er", r=1), f"er AS (SELECT * FROM {MORPH(f='bool_and', src='raster', r=1)})")
def win_open(spark, d):
    return raster.dilate(raster.dilate(get(spark, d, "raster"), "have", 1, erode=True), "have", 1)


@query("win_grow", "y b, x b, hole l", "SELECT t.y, t.x, bool_or(s.r <= 4 AND s.g <= 4 AND s.b <= 4) AS hole FROM raster t JOIN raster s ON abs(s.y - t.y) <= 4 AND abs(s.x - t.x) <= 4 GROUP BY t.y, t.x")
def win_grow(spark, d):
    from tilewright.operators.rasters_more import no_imagery

    return no_imagery(get(spark, d, "raster"), 2 << 1)


@query("win_snap_border", "y b, x b, step d", """SELECT y, x, step FROM (SELECT y, x, step, row_number() OVER (PARTITION BY y ORDER BY step DESC, x) AS k FROM (SELECT y, x, abs(avg(g) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) - avg(g) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS step FROM raster) WHERE x BETWEEN 8 AND 56 AND x >= 4) WHERE k = 1 AND step >= 4""")
def win_snap_border(spark, d):
    return ordered.snap_border(get(spark, d, "raster"), 32)


@query("sort_regions", "place b, s_suppkey b, level b", "SELECT row_number() OVER (ORDER BY 9 + s_suppkey % 5, s_suppkey) AS place, s_suppkey, 9 + s_suppkey % 5 AS level FROM geo_box")
def sort_regions(spark, d):
    # regions of one job: a handful of rows
    return get(spark, d, "geo_box").withColumn("level", 9 + F.col("s_suppkey") % 5).withColumn("place", F.row_number().over(Window.orderBy("level", "s_suppkey")))


@query("sort_quadkey", "key v, children b, first b", f"SELECT left(key, 10) AS key, count(*) AS children, min(id) AS first FROM (SELECT o_orderkey AS id, {quadkey('tile_x', 'tile_y', 12)} AS key FROM tile_image) GROUP BY 1")
def sort_quadkey(spark, d):
    from tilewright.functions import mercator

    t = get(spark, d, "tile_image").select(F.col("o_orderkey").alias("id"), mercator.quadkey("tile_x", "tile_y", F.lit(12)).alias("k"))
    # ordinal order groups siblings: range partitions, sorted within, are what a fetcher walks
    t = t.repartitionByRange("k").sortWithinPartitions("k")
    return t.groupBy(F.substring("k", 1, 10).alias("key")).agg(F.count(F.lit(1)).alias("children"), F.min("id").alias("first"))


@query("sort_places", "x b, place_id b, nth b", f"SELECT x, place_id, row_number() OVER (PARTITION BY x ORDER BY population DESC, kind, place_id) AS nth FROM (SELECT *, CAST(floor({gx('lon', 7)}) AS BIGINT) AS x FROM place)")
def sort_places(spark, d):
    from tilewright.functions import grid

    w = Window.partitionBy("x").orderBy(F.desc("population"), "kind", "place_id")
    return get(spark, d, "place").withColumn("x", grid.tile_x("lon", 7)).withColumn("nth", F.row_number().over(w))


@query("topk_backup", "name v", "SELECT name FROM (SELECT DISTINCT 'backup_' || strftime(o_orderdate, '%Y%m%d') AS name FROM orders) ORDER BY name DESC LIMIT 20")
def topk_backup(spark, d):
    from tilewright.session import table

    t = table(spark, d, "orders").select(F.concat(F.lit("backup_"), F.date_format("o_orderdate", "yyyyMMdd")).alias("name")).distinct()
    return t.orderBy(F.desc("name")).limit(20)


@query("limit_tiles", "p_partkey b, name v", "SELECT p_partkey, name FROM catalog_file ORDER BY name, p_partkey LIMIT 50")
def limit_tiles(spark, d):
    return get(spark, d, "catalog_file").orderBy("name", "p_partkey").limit(50)


@query("first_match", "folder v, name v, last_mask b", "SELECT folder, min(name) AS name, max(p_partkey) FILTER (WHERE name LIKE '%_mask.ttc') AS last_mask FROM catalog_file GROUP BY folder")
def first_match(spark, d):
    return get(spark, d, "catalog_file").groupBy("folder").agg(F.min("name").alias("name"), F.max(F.when(F.col("name").endswith("_mask.ttc"), F.col("p_partkey"))).alias("last_mask"))


@query("sort_crossings", "event_id b, n b", "SELECT event_id, count(*) FILTER (WHERE (a_lat <= lat) <> (b_lat <= lat) AND a_lon + (lat - a_lat)/(b_lat - a_lat)*(b_lon - a_lon) > lon) AS n FROM probe CROSS JOIN ring_segment GROUP BY event_id")
def sort_crossings(spark, d):
    return lines.crossings(get(spark, d, "probe"), ["event_id"], get(spark, d, "ring_segment"))
