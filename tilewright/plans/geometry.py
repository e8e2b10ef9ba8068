"""Queries of the geometry operators, with the flagship: verdicts of squares against a coast."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions import grid
from tilewright.operators import lines, strokes
from tilewright.plans.joins import DIST, KX
from tilewright.plans.registry import query
from tilewright.plans.scalars import gx, gy, lat_of, lon_of
from tilewright.plans.sets import SIDES, _sides
from tilewright.plans.views import get
from tilewright.session import table

SEG = "(SELECT a_lon, a_lat, b_lon, b_lat FROM coast_line UNION ALL SELECT a_lon, a_lat, b_lon, b_lat FROM ring_segment)"
ALL_DIST = DIST.replace("coast_segment", f"{SEG} g")
SIGNED = f"(SELECT event_id, CASE WHEN coast OR ring THEN -least(km, 12.112::DOUBLE) ELSE least(km, 12.112::DOUBLE) END AS km FROM {SIDES} JOIN {ALL_DIST} USING (event_id))"


RING = "(SELECT event_id, CASE WHEN ring THEN -least(km, 12.112::DOUBLE) ELSE least(km, 12.112::DOUBLE) END AS km FROM {0} JOIN {1} USING (event_id))".format(SIDES, DIST.replace("coast_segment", "ring_segment"))
RANGE = "CASE WHEN max(km) <= 5.556::DOUBLE THEN 'LAND' WHEN min(km) > 5.556::DOUBLE THEN 'SEA' ELSE 'CUT' END"


def _signed(spark, d, key=("event_id",), coast=True):
    return lines.signed(get(spark, d, "probe"), list(key), get(spark, d, "coast_line") if coast else None, get(spark, d, "ring_segment"), 2 * lines.MARGIN_KM + 1)


def _squares(spark, d, level, coast=True):
    """Squares of a level with their edges, the range of the field over their probes, these probes' number and the verdict."""
    probe = get(spark, d, "probe").select("event_id", "lon", "lat", grid.tile_x("lon", level).alias("tx"), grid.tile_y("lat", level).alias("ty"))
    field = lines.signed(probe, ["event_id", "tx", "ty"], get(spark, d, "coast_line") if coast else None, get(spark, d, "ring_segment"), 2 * lines.MARGIN_KM + 1)
    t = field.groupBy("tx", "ty").agg(F.min("km").alias("least"), F.max("km").alias("most"), F.count(F.lit(1)).alias("n_probes"))
    t = t.select("*", *[c.alias(k) for k, c in grid.square_edges("tx", "ty", level).items()])
    return lines.square_verdicts(t, get(spark, d, "coast_segment") if coast else None, get(spark, d, "ring_segment"), lines.MARGIN_KM)


def _squares_sql(level, signed=SIGNED):
    return f"(SELECT CAST(floor({gx('lon', level)}) AS BIGINT) AS tx, CAST(floor({gy('lat', level)}) AS BIGINT) AS ty, {RANGE} AS by_range, count(*) AS n FROM probe JOIN {signed} USING (event_id) GROUP BY 1, 2)"


def _outside(level):
    return f"CASE WHEN {lat_of('ty', level)} >= (SELECT min(lat) FROM coast_point) AND {lat_of('ty + 1', level)} <= (SELECT max(lat) FROM coast_point) THEN by_range ELSE 'OUTSIDE' END"


PAD = "(6.556::DOUBLE/110.9::DOUBLE)"
FAR = f"(SELECT min(lat) - {PAD} AS s, max(lat) + {PAD} AS n, min(lon) - p AS w, max(lon) + p AS e FROM ring_point CROSS JOIN (SELECT 6.556::DOUBLE/(111.32::DOUBLE*cos(radians(max(abs(lat)) + {PAD}))) AS p FROM ring_point) GROUP BY p)"


@query("geo_parity", "event_id b, coast l, ring l", f"SELECT * FROM {SIDES}")
def geo_parity(spark, d):
    return _sides(spark, d)


@query("geo_signed_field", "event_id b, km d", f"SELECT * FROM {SIGNED}")
def geo_signed_field(spark, d):
    return _signed(spark, d)


@query("geo_is_covered", "event_id b, covered l", f"SELECT event_id, km <= 5.556::DOUBLE AS covered FROM {SIGNED}")
def geo_is_covered(spark, d):
    return _signed(spark, d).withColumn("covered", F.col("km") <= lines.MARGIN_KM)


@query("classify_squares", "verdict v, squares b", f"SELECT {_outside(13)} AS verdict, count(*) AS squares FROM {_squares_sql(13)} GROUP BY 1")
def classify_squares(spark, d):
    return _squares(spark, d, 13).groupBy("verdict").agg(F.count(F.lit(1)).alias("squares"))


@query("agg_classify", "tx b, ty b, verdict v, n b", f"SELECT tx, ty, {_outside(12)} AS verdict, n FROM {_squares_sql(12)}")
def agg_classify(spark, d):
    return _squares(spark, d, 12).withColumn("n", F.col("n_probes"))


@query("classify_islands", "tx b, ty b, verdict v", f"SELECT tx, ty, CASE WHEN f.n >= {lat_of('ty', 13)} AND f.s <= {lat_of('ty + 1', 13)} AND f.e >= {lon_of('tx', 13)} AND f.w <= {lon_of('tx + 1', 13)} THEN by_range ELSE 'FAR' END AS verdict FROM {_squares_sql(13, RING)} CROSS JOIN {FAR} f")
def classify_islands(spark, d):
    """Verdicts where there is no coast, only an island."""
    return _squares(spark, d, 13, coast=False)


@query("geo_ring_hand", "clockwise l, area d", "SELECT sum(a_lon*b_lat - b_lon*a_lat) < 0 AS clockwise, abs(sum(a_lon*b_lat - b_lon*a_lat))/2 AS area FROM ring_segment")
def geo_ring_hand(spark, d):
    twice = F.sum(F.col("a_lon") * F.col("b_lat") - F.col("b_lon") * F.col("a_lat"))
    return get(spark, d, "ring_segment").agg((twice < 0).alias("clockwise"), (F.abs(twice) / 2).alias("area"))


@query("geo_sea_hand", "hand v", "SELECT CASE WHEN arg_max(lat, seq) > arg_min(lat, seq) THEN 'left' ELSE 'right' END AS hand FROM coast_point")
def geo_sea_hand(spark, d):
    # land to the east: going north, the sea lies to the left
    return get(spark, d, "coast_point").agg(F.when(F.max_by("lat", "seq") > F.min_by("lat", "seq"), "left").otherwise("right").alias("hand"))


@query("geo_open_island", "island b, gap d, open l", "SELECT island, gap, gap > 0.5 AS open FROM (SELECT stroke % 7 AS island, abs(arg_max(lat, stroke*100 + seq) - arg_min(lat, stroke*100 + seq))*110.9::DOUBLE AS gap FROM stroke_point GROUP BY 1)")
def geo_open_island(spark, d):
    t = get(spark, d, "stroke_point").withColumn("o", F.col("stroke") * 100 + F.col("seq"))
    t = t.groupBy((F.col("stroke") % 7).alias("island")).agg((F.abs(F.max_by("lat", "o") - F.min_by("lat", "o")) * 110.9).alias("gap"))
    return t.withColumn("open", F.col("gap") > 0.5)


@query("geo_stretch", "land v, lo d, hi d", "SELECT v.land, CASE WHEN v.land IN ('E', 'W') THEN min(lat) ELSE min(lon) END AS lo, CASE WHEN v.land IN ('E', 'W') THEN max(lat) ELSE max(lon) END AS hi FROM coast_point CROSS JOIN (VALUES ('E'), ('N')) v(land) GROUP BY v.land")
def geo_stretch(spark, d):
    t = get(spark, d, "coast_point").agg(*[f(c).alias(f"{n}{c}") for c in ("lat", "lon") for n, f in (("lo_", F.min), ("hi_", F.max))])
    t = t.withColumn("land", F.explode(F.array(F.lit("E"), F.lit("N"))))
    along = F.col("land").isin("E", "W")
    return t.select("land", F.when(along, F.col("lo_lat")).otherwise(F.col("lo_lon")).alias("lo"), F.when(along, F.col("hi_lat")).otherwise(F.col("hi_lon")).alias("hi"))


@query("geo_winding", "event_id b, inside l", "SELECT event_id, abs(sum(d)) > pi() AS inside FROM (SELECT event_id, atan2(sin(t), cos(t)) AS d FROM (SELECT event_id, atan2(b_lat - lat, b_lon - lon) - atan2(a_lat - lat, a_lon - lon) AS t FROM probe CROSS JOIN ring_segment)) GROUP BY event_id")
def geo_winding(spark, d):
    turns = lines.winding(get(spark, d, "probe"), ["event_id"], get(spark, d, "ring_segment"))
    return turns.select("event_id", (F.col("turns") != 0).alias("inside"))


# empty cells of a strip that is as long as there are suppliers, and points all along it
CELLS = "(SELECT s_suppkey AS x, (s_suppkey*5) % 12 AS y FROM supplier WHERE s_suppkey % 3 <> 1)"
CELL_POINTS = "(SELECT event_id, (event_id*31 % ((SELECT count(*) FROM supplier)*100))*0.01::DOUBLE AS px, (user_id*17 % 1200)*0.01::DOUBLE AS py FROM events)"


def cell_points(spark, d):
    suppliers = table(spark, d, "supplier")
    length = suppliers.agg((F.count(F.lit(1)) * 100).alias("n"))  # one row
    points = table(spark, d, "events").crossJoin(F.broadcast(length)).selectExpr("event_id", "(event_id*31 % n)*0.01D AS px", "(user_id*17 % 1200)*0.01D AS py")
    return points, suppliers.where("s_suppkey % 3 <> 1").selectExpr("s_suppkey AS x", "(s_suppkey*5) % 12 AS y")


@query("geo_edge_alpha", "event_id b, alpha d", f"SELECT event_id, CASE WHEN km < 8 THEN round_even(least(greatest(km/8, 0), 1)*4, 0)/4 END AS alpha FROM (SELECT event_id, min(sqrt(pow(greatest(x - px, 0, px - x - 1)*111.32::DOUBLE*0.1, 2) + pow(greatest(y - py, 0, py - y - 1)*110.57::DOUBLE*0.1, 2))) AS km FROM {CELL_POINTS} CROSS JOIN {CELLS} GROUP BY event_id)")
def geo_edge_alpha(spark, d):
    from tilewright.operators.edges import edge_alpha

    points, cells = cell_points(spark, d)
    return edge_alpha(points, ["event_id"], cells, 111.32 * 0.1, 110.57 * 0.1, 8.0, 4)


# every pairing of class and code, names with and without the prefix, heights in and out of range and none
PLACE_CODES = ("ADM3", "ADM2", "PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLC", "PPLL", "PPLX", "PPLQ")
GAZETTEER = f"""(SELECT place_id, CASE WHEN place_id % 4 = 0 THEN 'A' WHEN place_id % 13 = 0 THEN 'S' ELSE 'P' END AS feature_class, [{", ".join(f"'{c}'" for c in PLACE_CODES)}][1 + place_id % 11] AS feature_code,
 CASE place_id % 3 WHEN 0 THEN 'Comuna de ' WHEN 1 THEN 'Comuna ' ELSE '' END || name AS name, CASE WHEN place_id % 5 < 2 THEN 0 ELSE population END AS population,
 CASE place_id % 7 WHEN 0 THEN CAST(place_id % 9000 AS VARCHAR) WHEN 1 THEN '12.5' WHEN 2 THEN '8000' ELSE '' END AS elevation, CASE WHEN place_id % 6 = 0 THEN '-9999' ELSE CAST(place_id % 500 - 450 AS VARCHAR) END AS dem FROM place)"""


@query("geo_place_filter", "place_id b, name v, height d", f"""SELECT place_id, CASE WHEN feature_class = 'A' AND name LIKE 'Comuna de %' THEN substr(name, 11) WHEN feature_class = 'A' AND name LIKE 'Comuna %' THEN substr(name, 8) ELSE name END AS name,
 50 + CASE WHEN place_id % 7 = 0 AND place_id % 9000 <= 7000 THEN place_id % 9000 WHEN place_id % 6 <> 0 AND place_id % 500 - 450 >= -400 THEN place_id % 500 - 450 ELSE 0 END AS height
 FROM {GAZETTEER} WHERE (feature_class = 'A' AND feature_code = 'ADM3') OR (feature_class = 'P' AND feature_code LIKE 'PPL%' AND feature_code NOT IN ('PPLA4', 'PPLQ') AND (population > 0 OR feature_code IN ('PPLC', 'PPLA', 'PPLA2', 'PPLA3')))""")
def geo_place_filter(spark, d):
    from tilewright.operators.places import filtered

    codes = F.array(*[F.lit(c) for c in PLACE_CODES])
    t = get(spark, d, "place").select(
        "place_id",
        F.expr("CASE WHEN place_id % 4 = 0 THEN 'A' WHEN place_id % 13 = 0 THEN 'S' ELSE 'P' END").alias("feature_class"),
        F.element_at(codes, (F.col("place_id") % 11 + 1).cast("int")).alias("feature_code"),
        F.expr("concat(CASE place_id % 3 WHEN 0 THEN 'Comuna de ' WHEN 1 THEN 'Comuna ' ELSE '' END, name)").alias("name"),
        F.expr("CASE WHEN place_id % 5 < 2 THEN 0 ELSE population END").alias("population"),
        F.expr("CASE place_id % 7 WHEN 0 THEN CAST(place_id % 9000 AS STRING) WHEN 1 THEN '12.5' WHEN 2 THEN '8000' ELSE '' END").alias("elevation"),
        F.expr("CASE WHEN place_id % 6 = 0 THEN '-9999' ELSE CAST(place_id % 500 - 450 AS STRING) END").alias("dem"),
    )
    return filtered(t).select("place_id", "name", "height")


@query("geo_chain", "line b, place b, stroke b, flipped l, seq b, lat d, lon d")
def geo_chain(spark, d):
    return strokes.chain(get(spark, d, "stroke_point").withColumn("line", F.col("stroke") % 5))


@query("geo_simplify", "stroke b, seq b, lat d, lon d")
def geo_simplify(spark, d):
    return strokes.simplify(get(spark, d, "stroke_point"), 30.0, ["stroke"])


@query("geo_cut_line", "file b, piece b, seq b, lat d, lon d")
def geo_cut_line(spark, d):
    """The cut of a file with the coast, whose sea lies to the left going north, and one island."""
    from tilewright.operators.cutlines import cut_lines

    coast = get(spark, d, "coast_point").selectExpr("0L AS file", "0L AS line", "'left' AS sea", "seq", "lat", "lon")
    island = get(spark, d, "ring_point").selectExpr("0L AS file", "1L AS line", "CAST(NULL AS STRING) AS sea", "seq", "lat", "lon")
    return cut_lines(coast.unionByName(island), lines.MARGIN_KM)


@query("geo_capture", "stroke b, seq b, x d, y d", """SELECT stroke, seq, x, y FROM c WHERE took""", """RECURSIVE p AS (SELECT stroke, seq, CAST(floor((lon + 72)*10) AS DOUBLE) AS x, CAST(floor((lat + 34)*10) AS DOUBLE) AS y FROM stroke_point), c AS (SELECT stroke, seq, x, y, true AS took, x AS lx, y AS ly FROM p WHERE seq = 0 UNION ALL
 SELECT p.stroke, p.seq, p.x, p.y, sqrt((p.x - lx)*(p.x - lx) + (p.y - ly)*(p.y - ly)) >= 4, CASE WHEN sqrt((p.x - lx)*(p.x - lx) + (p.y - ly)*(p.y - ly)) >= 4 THEN p.x ELSE lx END, CASE WHEN sqrt((p.x - lx)*(p.x - lx) + (p.y - ly)*(p.y - ly)) >= 4 THEN p.y ELSE ly END FROM c JOIN p ON p.stroke = c.stroke AND p.seq = c.seq + 1)""")
def geo_capture(spark, d):
    t = get(spark, d, "stroke_point").select("stroke", "seq", F.floor((F.col("lon") + 72) * 10).alias("x"), F.floor((F.col("lat") + 34) * 10).alias("y"))
    return strokes.capture(t, ["stroke"], 4.0)


@query("geo_dedupe_places", "place_id b, name v, population b")
def geo_dedupe_places(spark, d):
    """Towns and divisions of forty names, some tens of kilometres apart."""
    near = get(spark, d, "place").selectExpr("place_id", "name", "place_id % 40 * 0.5D - 71 + lon % 1 * 0.2D AS lon", "lat % 1 * 0.2D - 33 AS lat", "population div 1000 AS population", "kind = 0 AS division")
    return strokes.dedupe_places(near)
