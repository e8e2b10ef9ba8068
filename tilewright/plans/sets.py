"""Queries of the set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import catalog, lines
from tilewright.plans.registry import query
from tilewright.plans.views import get
from tilewright.session import table

CROSS = "(a_lat <= lat) <> (b_lat <= lat) AND a_lon + (lat - a_lat)/(b_lat - a_lat)*(b_lon - a_lon) > lon"
SIDES = f"(SELECT event_id, c % 2 = 0 AS coast, r % 2 = 1 AS ring FROM (SELECT event_id, count(*) FILTER (WHERE {CROSS}) AS c FROM probe CROSS JOIN coast_line GROUP BY event_id) JOIN (SELECT event_id, count(*) FILTER (WHERE {CROSS}) AS r FROM probe CROSS JOIN ring_segment GROUP BY event_id) USING (event_id))"


def _sides(spark, d, key=("event_id",)):
    return lines.sides(get(spark, d, "probe"), list(key), get(spark, d, "coast_line"), get(spark, d, "ring_segment"), 2 * lines.MARGIN_KM + 1)


@query("set_union_lands", "event_id b, land l", f"SELECT event_id, coast OR ring AS land FROM {SIDES}")
def set_union_lands(spark, d):
    return _sides(spark, d).withColumn("land", F.col("coast") | F.col("ring"))


@query("set_diff_lakes", "event_id b", f"SELECT event_id FROM {SIDES} WHERE coast AND NOT ring")
def set_diff_lakes(spark, d):
    return _sides(spark, d).where("coast AND NOT ring")


@query("set_diff_install", "name v", "SELECT DISTINCT name FROM catalog_file WHERE p_partkey % 4 <> 0 AND lower(name) LIKE '%.ttc' AND lower(name) NOT IN (SELECT lower(name) FROM catalog_file WHERE p_partkey % 3 = 0)")
def set_diff_install(spark, d):
    t = get(spark, d, "catalog_file")
    return catalog.install_plan(t.where("p_partkey % 3 = 0"), t.where("p_partkey % 4 <> 0")).where("action = 'delete'").select("name")


@query("set_diff_names", "name v", "SELECT DISTINCT folder || '_x' AS name FROM catalog_file WHERE p_partkey % 2 = 0 EXCEPT SELECT folder || '_x' FROM catalog_file WHERE p_partkey % 22 < 9")
def set_diff_names(spark, d):
    t = get(spark, d, "catalog_file").withColumn("n", F.concat("folder", F.lit("_x")))
    return t.where("p_partkey % 2 = 0").select(F.col("n").alias("name")).exceptAll(t.where("p_partkey % 22 < 9").select("n")).distinct().join(t.where("p_partkey % 22 < 9").select(F.col("n").alias("name")), "name", "left_anti")


@query("set_distinct_parents", "parent v", "SELECT DISTINCT left(name, 11) AS parent FROM catalog_file WHERE name LIKE 'map%'")
def set_distinct_parents(spark, d):
    return get(spark, d, "catalog_file").where("name LIKE 'map%'").select(F.substring("name", 1, 11).alias("parent")).distinct()


@query("set_diff_offered", "kind v, field v", "SELECT DISTINCT event_type AS kind, 'f' || user_id % 13 AS field FROM events EXCEPT SELECT event_type, 'f' || user_id % 13 FROM events WHERE event_id % 50 = 0")
def set_diff_offered(spark, d):
    t = table(spark, d, "events")
    offered = t.select(F.col("event_type").alias("kind"), F.concat(F.lit("f"), F.col("user_id") % 13).alias("field"))
    log = t.where("event_id % 50 = 0").select(F.format_string("error: %s has no field f%d!", "event_type", F.col("user_id") % 13).alias("line"))
    return catalog.offered_not_rejected(offered, log)


@query("set_intersect_halo", "x b, y b", "SELECT DISTINCT CAST(floor(lon) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y FROM geo_point WHERE event_id % 2 = 0 INTERSECT SELECT CAST(floor(lon) AS BIGINT), CAST(floor(lat) AS BIGINT) FROM geo_point WHERE event_id % 2 = 1")
def set_intersect_halo(spark, d):
    t = get(spark, d, "geo_point").select("event_id", F.floor("lon").alias("x"), F.floor("lat").alias("y"))
    return t.where("event_id % 2 = 0").select("x", "y").intersect(t.where("event_id % 2 = 1").select("x", "y"))
