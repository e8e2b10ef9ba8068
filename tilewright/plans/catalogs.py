"""Queries of sources, sinks and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import grid
from tilewright.operators import catalog, fetch
from tilewright.plans.registry import query
from tilewright.plans.scalars import HEX
from tilewright.plans.views import get
from tilewright.session import table
from tilewright.sources import text_jobs

FIELD = r"<\[([^\]]*)\]\[([^\]]*)\]\[([^\]]*)\]"
ROWS = f"(SELECT n_nationkey, pos, regexp_extract(f, '{FIELD}', 1) AS kind, regexp_extract(f, '{FIELD}', 2) AS name, regexp_extract(f, '{FIELD}', 3) AS value FROM (SELECT n_nationkey, unnest(range(len(fs))) AS pos, unnest(fs) AS f FROM (SELECT n_nationkey, regexp_extract_all(text, '{FIELD}') AS fs FROM job_text)))"


@query("src_tmfields", "n_nationkey b, pos b, kind v, name v, value v", f"SELECT * FROM {ROWS}")
def src_tmfields(spark, d):
    return text_jobs.field_rows(get(spark, d, "job_text"), "n_nationkey")


REG = f"r AS (SELECT *, sum(CASE WHEN name = 'level' THEN 1 ELSE 0 END) OVER (PARTITION BY n_nationkey ORDER BY pos) AS region FROM {ROWS}), reg AS (SELECT n_nationkey, region - 1 AS region, max(value) FILTER (WHERE name = 'level') AS level, max(value) FILTER (WHERE name = 'lonlat_min') AS a, max(value) FILTER (WHERE name = 'lonlat_max') AS b, max(value) FILTER (WHERE name = 'write_images_with_mask') AS mask FROM r WHERE region > 0 GROUP BY n_nationkey, region)"
XY = "CAST(split_part({0}, ' ', {1}) AS DOUBLE)".format


@query("src_tmc", "n_nationkey b, region b, level b, w d, e d, s d, n d, mask l", f"SELECT n_nationkey, region, level, least({XY('a', 1)}, {XY('b', 1)}) AS w, greatest({XY('a', 1)}, {XY('b', 1)}) AS e, least({XY('a', 2)}, {XY('b', 2)}) AS s, greatest({XY('a', 2)}, {XY('b', 2)}) AS n, coalesce(mask, 'false') = 'true' AS mask FROM reg", REG)
def src_tmc(spark, d):
    return text_jobs.regions(get(spark, d, "job_text"), "n_nationkey")


@query("snk_tmc", "s_suppkey b, text v", r"""SELECT s_suppkey, '<[file][][]<[tm_config][aerial_images][]' || chr(10) || '<[list][region_list][]' || chr(10) || printf('<[region][element][0]<[int][level][%d]><[vector2_float64][lonlat_min][%.8f %.8f]><[vector2_float64][lonlat_max][%.8f %.8f]><[bool][write_images_with_mask][%s]>>', 9 + s_suppkey % 5, w + 0.01::DOUBLE, n - 0.01::DOUBLE, e - 0.01::DOUBLE, s + 0.01::DOUBLE, CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END) || chr(10) || '>>>' || chr(10) AS text FROM geo_box""")
def snk_tmc(spark, d):
    t = get(spark, d, "geo_box").withColumn("level", 9 + F.col("s_suppkey") % 5).withColumn("mask", F.col("s_suppkey") % 2 == 0)
    return text_jobs.job_text(t, "s_suppkey")


AID = "'<[file][][]' || chr(10) || '<[tm_aerial_image_definition][][]' || chr(10) || '<[string8][image][img' || s_suppkey || '.png]>' || chr(10) || '<[bool][flip_vertical][false]>' || chr(10) || printf('<[vector2_float64][steps_per_pixel][%.12f %.12f]>', (e - w)/256, -(n - s)/256) || chr(10) || printf('<[vector2_float64][top_left][%.12f %.12f]>', w, n) || chr(10) || '>>' || chr(10)"


@query("snk_aid", "s_suppkey b, text v", f"SELECT s_suppkey, {AID} AS text FROM geo_box")
def snk_aid(spark, d):
    t = get(spark, d, "geo_box")
    image = F.format_string("img%d.png", "s_suppkey")
    return t.select("s_suppkey", text_jobs.georeference_text(image, (F.col("e") - F.col("w")) / 256, -(F.col("n") - F.col("s")) / 256, "w", "n").alias("text"))


@query("src_aid", "s_suppkey b, image v, flip l, step_x d, step_y d, x d, y d", "SELECT s_suppkey, 'img' || s_suppkey || '.png' AS image, false AS flip, (e - w)/256 AS step_x, -(n - s)/256 AS step_y, w AS x, n AS y FROM geo_box")
def src_aid(spark, d):
    return text_jobs.georeferences(snk_aid(spark, d), "s_suppkey")


@query("gen_aid_tmc", "s_suppkey b, level b, image v, w d, n d", "SELECT s_suppkey, l AS level, 'img' || s_suppkey || '.png' AS image, w + 0.01::DOUBLE AS w, n - 0.01::DOUBLE AS n FROM geo_box CROSS JOIN (VALUES (9), (11), (12)) v(l)")
def gen_aid_tmc(spark, d):
    levels = F.explode(F.array(*[F.lit(x) for x in (9, 11, 12)]))
    return get(spark, d, "geo_box").select("s_suppkey", levels.alias("level"), F.format_string("img%d.png", "s_suppkey").alias("image"), (F.col("w") + 0.01).alias("w"), (F.col("n") - 0.01).alias("n"))


@query("src_folder_images", "folder v, name v, priority b", "SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY lower(name), name) AS priority FROM (SELECT DISTINCT folder, name FROM catalog_file)")
def src_folder_images(spark, d):
    return catalog.numbered(get(spark, d, "catalog_file").select("folder", "name").distinct(), "name")


HEADS = ["FFD8FFE000104A4649460001", "89504E470D0A1A0A0000000D", "474946383961010001000000", "424D36000000000000003600", "49492A000800000000000000", "4D4D002A0000000800000000", "524946460000000057454250", "3C68746D6C3E3C626F64793E", "FFD8FF"]
KINDS = ["'jpeg'", "'png'", "'gif'", "'bmp'", "'tiff'", "'tiff'", "'webp'", "NULL", "NULL"]


@query("fmt_sniff", "event_id b, kind v", f"SELECT event_id, CASE event_id % 9 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(KINDS))} END AS kind FROM events")
def fmt_sniff(spark, d):
    head = F.element_at(F.lit(HEADS), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", fetch.sniff(F.unhex(head)).alias("kind"))


LINE_FILES = "(SELECT o_orderkey % 6 AS file, o_orderkey AS n, CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 97 = 1 THEN '# coast' WHEN o_orderkey % 83 = 2 THEN '# island ' || o_orderkey % 5 ELSE (o_orderkey % 50 - 60) || '.5 ' || (o_custkey % 90) || '.25' END AS line FROM orders)"
POINTS = f"""lf AS (SELECT file, n, line, line NOT LIKE '#%' AND line <> '' AS p FROM {LINE_FILES}), lg AS (SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY n) AS stroke, coalesce(last_value(CASE WHEN line = '# coast' THEN -1 WHEN line LIKE '# island%' THEN CAST(split_part(line, ' ', 3) AS INT) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY n), -1) AS island FROM lf)"""


def _line_files(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey % 6 AS file", "o_orderkey AS n",
        "CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 97 = 1 THEN '# coast' WHEN o_orderkey % 83 = 2 THEN concat('# island ', o_orderkey % 5) ELSE concat(o_orderkey % 50 - 60, '.5 ', o_custkey % 90, '.25') END AS line",
    )


@query("src_coast_file", "file b, stroke b, seq b, island b, lat d, lon d", "SELECT * FROM (SELECT file, stroke, row_number() OVER (PARTITION BY file, stroke ORDER BY n) - 1 AS seq, island, CAST(split_part(line, ' ', 1) AS DOUBLE) AS lat, CAST(split_part(line, ' ', 2) AS DOUBLE) AS lon, count(*) OVER (PARTITION BY file, stroke) AS k FROM lg WHERE p) WHERE k > 1", POINTS)
def src_coast_file(spark, d):
    return text_jobs.line_points(_line_files(spark, d))


@query("src_lakes_file", "file b, lakes b, points b", "SELECT file, count(DISTINCT island) AS lakes, count(*) AS points FROM (SELECT file, island, count(*) OVER (PARTITION BY file, stroke) AS k FROM lg WHERE p) WHERE k > 1 AND island >= 0 GROUP BY file", POINTS)
def src_lakes_file(spark, d):
    lakes = _line_files(spark, d).withColumn("line", F.regexp_replace("line", "island", "lake"))
    return text_jobs.line_points(lakes).where("island >= 0").groupBy("file").agg(F.count_distinct("island").alias("lakes"), F.count(F.lit(1)).alias("points"))


@query("snk_coast_file", "file b, points b, marks b", "SELECT file, count(*) AS points, count(*) FILTER (WHERE pi IS NULL OR pi <> island) AS marks FROM (SELECT file, island, lag(island) OVER (PARTITION BY file ORDER BY stroke, n) AS pi FROM (SELECT *, count(*) OVER (PARTITION BY file, stroke) AS k FROM lg WHERE p) WHERE k > 1) GROUP BY file", POINTS)
def snk_coast_file(spark, d):
    text = text_jobs.point_lines(text_jobs.line_points(_line_files(spark, d)))
    lines = text.select("file", F.posexplode(F.split("text", "\n")).alias("n", "line"))  # emitted, then read again
    again = text_jobs.line_points(lines).groupBy("file").agg(F.count(F.lit(1)).alias("points"))
    return again.join(lines.groupBy("file").agg(F.count_if(F.col("line").startswith("#")).alias("marks")), "file")


@query("src_geonames", "id b, name v, lat d, population b", "SELECT c_custkey AS id, 'n' || c_custkey AS name, (c_custkey % 90)::DOUBLE AS lat, c_custkey*10 AS population FROM customer")
def src_geonames(spark, d):
    from tilewright.sources.tables import parse_places

    row = F.concat_ws("\t", F.col("c_custkey").cast("string"), F.format_string("n%d", "c_custkey"), F.lit("a"), F.lit(""), (F.col("c_custkey") % 90).cast("string"), F.lit("0"), F.lit("P"), F.lit("PPL"), F.lit("CL"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(""), (F.col("c_custkey") * 10).cast("string"), F.lit(""), F.lit("5"), F.lit("tz"), F.lit("2020-01-01"))
    return parse_places(table(spark, d, "customer").select(row.alias("value"))).selectExpr("geonameid AS id", "name", "latitude AS lat", "population")


@query("src_patch_state", "event_id b, clicks b, lon d, again v", "SELECT event_id, 2 AS clicks, event_id % 90 + 0.5::DOUBLE AS lon, 'ok' AS again FROM events")
def src_patch_state(spark, d):
    from tilewright.operators import patches

    text = F.format_string('{"version":1,"clicks":[{"lon":%d.5,"lat":1.0,"tol":20.0},{"lon":2.0,"lat":3.0,"tol":5.0}]}', F.col("event_id") % 90)
    t = table(spark, d, "events").select("event_id", text.alias("text")).withColumn("c", patches.clicks(F.col("text")))
    same = F.when(patches.state(F.col("c")) == F.col("text"), "ok").otherwise(patches.state(F.col("c")))
    return t.select("event_id", F.size("c").alias("clicks"), F.col("c")[0]["lon"].alias("lon"), same.alias("again"))


@query("cat_downloaded", "name v, level b, tx b, ty b", f"SELECT DISTINCT left(name, 16) AS name, CAST(substr(name, 5, 2) AS BIGINT) AS level, {HEX('substr(name, 8, 4)')} // CAST(pow(2, 16 - CAST(substr(name, 5, 2) AS INT)) AS BIGINT) AS tx, {HEX('substr(name, 13, 4)')} // CAST(pow(2, 16 - CAST(substr(name, 5, 2) AS INT)) AS BIGINT) AS ty FROM catalog_file WHERE regexp_matches(name, '^map_[0-9][0-9]_[0-9a-f]{{4}}_[0-9a-f]{{4}}')")
def cat_downloaded(spark, d):
    t = get(spark, d, "catalog_file").select(F.substring("name", 1, 16).alias("name")).distinct()
    return catalog.downloaded(t)


@query("cat_installed", "x b, y b", f"SELECT DISTINCT {HEX('substr(name, 8, 4)')} // 128 AS x, {HEX('substr(name, 13, 4)')} // 128 AS y FROM catalog_file WHERE regexp_matches(name, '^map_[0-9][0-9]_[0-9a-f]{{4}}_[0-9a-f]{{4}}(_mask)?[.]ttc$')")
def cat_installed(spark, d):
    return catalog.installed(get(spark, d, "catalog_file"))


@query("cat_find_squares", "folder v, levels b, squares b", "SELECT folder, count(DISTINCT substr(name, 5, 2)) AS levels, count(DISTINCT left(name, 16)) AS squares FROM catalog_file WHERE regexp_matches(name, '^map_[0-9][0-9]_[0-9a-f]{4}_[0-9a-f]{4}(_mask)?[.]ttc$') GROUP BY folder")
def cat_find_squares(spark, d):
    return catalog.squares(get(spark, d, "catalog_file"))


JOBS = "(SELECT 'r' || p_partkey % 7 AS root, CASE p_partkey % 5 WHEN 0 THEN 'z/' WHEN 1 THEN 'A/b/' WHEN 2 THEN 'a/c/' WHEN 3 THEN 'a/b/c/d/' ELSE CASE WHEN p_partkey % 7 = 3 THEN '' ELSE 'q/r/s/t/u/' END END || 'Job' || p_partkey % 50 || CASE WHEN p_partkey % 2 = 0 THEN '.tmc' ELSE '.TMC' END AS path FROM part)"


@query("cat_find_tmc", "root v, path v", f"SELECT root, path FROM (SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY f[:-2], f[-1], path) AS k FROM (SELECT *, string_split(lower(path), '/') AS f FROM {JOBS}) WHERE len(f) <= 4) WHERE k = 1")
def cat_find_tmc(spark, d):
    t = table(spark, d, "part").selectExpr("concat('r', p_partkey % 7) AS root", "concat(CASE p_partkey % 5 WHEN 0 THEN 'z/' WHEN 1 THEN 'A/b/' WHEN 2 THEN 'a/c/' WHEN 3 THEN 'a/b/c/d/' ELSE CASE WHEN p_partkey % 7 = 3 THEN '' ELSE 'q/r/s/t/u/' END END, 'Job', p_partkey % 50, CASE WHEN p_partkey % 2 = 0 THEN '.tmc' ELSE '.TMC' END) AS path")
    return catalog.find_job(t)


THERE = "(SELECT CASE WHEN p_partkey % 4 = 0 THEN upper(name) ELSE name END AS name FROM catalog_file WHERE p_partkey % 3 = 0)"


def _there(spark, d):
    return get(spark, d, "catalog_file").where("p_partkey % 3 = 0").selectExpr("CASE WHEN p_partkey % 4 = 0 THEN upper(name) ELSE name END AS name")


@query("snk_install", "level b, action v, name v", f"SELECT l AS level, 'copy' AS action, name FROM (SELECT DISTINCT name FROM catalog_file WHERE p_partkey % 2 = 0) CROSS JOIN (VALUES (9), (11)) v(l) UNION ALL SELECT DISTINCT 9, 'delete', name FROM {THERE} WHERE lower(name) LIKE '%.ttc' AND lower(name) NOT IN (SELECT lower(name) FROM catalog_file WHERE p_partkey % 2 = 0)")
def snk_install(spark, d):
    """Into a folder of a square's own, and into one that several smaller squares share."""
    built = get(spark, d, "catalog_file").where("p_partkey % 2 = 0")
    plans = [catalog.install_plan(built, _there(spark, d), level).withColumn("level", F.lit(level)) for level in (9, 11)]
    return plans[0].unionByName(plans[1])


@query("cat_dup_tiles", "name v, n b", "SELECT name, count(*) AS n FROM catalog_file GROUP BY name HAVING count(*) > 1")
def cat_dup_tiles(spark, d):
    return catalog.duplicates(get(spark, d, "catalog_file"))


@query("cat_delete", "name v, kind v", "SELECT p_partkey || CASE p_partkey % 4 WHEN 0 THEN '-raw' WHEN 1 THEN '-ttc' WHEN 2 THEN '-stitched' ELSE '' END AS name, CASE p_partkey % 4 WHEN 3 THEN 'tiles' ELSE 'output' END AS kind FROM part WHERE p_partkey % 4 <> 2")
def cat_delete(spark, d):
    t = table(spark, d, "part").selectExpr("concat(p_partkey, CASE p_partkey % 4 WHEN 0 THEN '-raw' WHEN 1 THEN '-ttc' WHEN 2 THEN '-stitched' ELSE '' END) AS name")
    return catalog.deletable(t, raw=True, stitched=False, tiles=True)


@query("cat_backup", "name v", "SELECT name FROM (SELECT name, row_number() OVER (ORDER BY name DESC) AS k FROM (SELECT DISTINCT 'backup_' || strftime(o_orderdate, '%Y%m%d') AS name FROM orders)) WHERE k > 20")
def cat_backup(spark, d):
    t = table(spark, d, "orders").select(F.concat(F.lit("backup_"), F.date_format("o_orderdate", "yyyyMMdd")).alias("name")).distinct()
    return catalog.stale_backups(t)


@query("cat_hash_manifest", "folder v, name v, sha v, manifest v", "SELECT folder, name, sha, m AS manifest FROM f JOIN (SELECT folder, sha256(string_agg(sha || '  ' || name, chr(10) ORDER BY name)) AS m FROM f GROUP BY folder) USING (folder)", "f AS (SELECT DISTINCT folder, name, sha256(folder || name) AS sha FROM catalog_file)")
def cat_hash_manifest(spark, d):
    t = get(spark, d, "catalog_file").select("folder", "name", F.concat("folder", "name").cast("binary").alias("content")).distinct()
    return catalog.hash_manifest(t)


@query("cat_landmark_text", "place_id b, text v", "SELECT place_id, printf('<[landmark][element][]<[string8][name][%s]><[vector2_float64][lon_lat][%.6f %.6f]><[uint32][type][%d]><[uint32][priority][%d]><[float64][height][%.1f]>>', name, lon, lat, kind, 3, 50.0::DOUBLE) AS text FROM place")
def cat_landmark_text(spark, d):
    from tilewright.operators.places import landmark_text

    t = get(spark, d, "place").withColumn("priority", F.lit(3)).withColumn("h", F.lit(50.0))
    return t.select("place_id", landmark_text("name", "lon", "lat", "kind", "priority", "h").alias("text"))


@query("src_ttc", "tile b, magic b, level b, width b, levels b, kind b, bytes b", "SELECT (3 - y)*4 + x AS tile, 12346 AS magic, 12 AS level, 16 AS width, 5 AS levels, 10 AS kind, (16 + 4 + 1 + 1 + 1)*8 AS bytes FROM range(4) a(x) CROSS JOIN range(4) b(y)")
def src_ttc(spark, d):
    """Texture files made from the test raster, then read back by their headers."""
    from tilewright.operators import blocks
    from tilewright.sources.containers import texture_headers

    t = get(spark, d, "raster").selectExpr("12L AS level", "x div 16 AS tx", "3 - y div 16 AS ty", "y % 16 AS y", "x % 16 AS x", "r", "g", "b", "have")
    files = blocks.textures(blocks.from_pixels(t, 16), 16).select((F.col("ty") * 4 + F.col("tx")).alias("path"), F.col("texture").alias("content"))
    return texture_headers(files).selectExpr("path AS tile", "magic", "level", "width", "levels", "kind", "length AS bytes")


def _answers(url: str, headers: dict) -> fetch.Answer:
    """A source that answers by a tile's place: not there, zipped image, page, fault, image that stands for no tile."""
    import gzip

    x, y = (int(k) for k in url.split("/")[-2:])
    image = bytes.fromhex("89504E470D0A1A0A") + x.to_bytes(4, "big") + y.to_bytes(4, "big")
    return [
        (404, {}, b"not here"),
        (200, {"Content-Encoding": "gzip"}, gzip.compress(image)),
        (200, {}, b"<html>come again</html>"),
        (503, {}, None),
        (200, {"X-VE-Tile-Info": "no-tile"}, image),
    ][(x + y) % 5]


@query("src_http_tile", "url v, http b, attempts b, status v, bytes b", """SELECT printf('made://%s/%d/%d', source, tile_x, tile_y) AS url, CASE k WHEN 0 THEN 404 WHEN 3 THEN 503 ELSE 200 END AS http,
 CASE WHEN k NOT IN (0, 3) THEN 1 WHEN source = 'ArcGIS' THEN 7 WHEN source = 'US_USGS' THEN 3 ELSE 1 END AS attempts, CASE k WHEN 1 THEN 'saved' WHEN 2 THEN 'not_image' WHEN 3 THEN 'failed' ELSE 'unavailable' END AS status,
 CASE k WHEN 0 THEN 8 WHEN 2 THEN 23 WHEN 3 THEN 0 ELSE 16 END AS bytes
FROM (SELECT DISTINCT tile_x, tile_y, (tile_x + tile_y) % 5 AS k, CASE tile_x % 3 WHEN 0 THEN 'Bing' WHEN 1 THEN 'US_USGS' ELSE 'ArcGIS' END AS source FROM tile_image)""")
def src_http_tile(spark, d):
    """The fetch stage over a source made for it: unzipped, asked again by the source's rule, told what became of it."""
    t = get(spark, d, "tile_image").select("tile_x", "tile_y", F.expr("CASE tile_x % 3 WHEN 0 THEN 'Bing' WHEN 1 THEN 'US_USGS' ELSE 'ArcGIS' END").alias("source")).distinct()
    t = fetch.fetched(t.select("source", F.format_string("made://%s/%d/%d", "source", "tile_x", "tile_y").alias("url")), _answers, retries=2)
    told = fetch.status("http", "no_tile", fetch.sniff("content").isNotNull())
    return t.select("url", "http", "attempts", told.alias("status"), F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes"))


@query("src_image_tile", "key v, n d, w d", "SELECT DISTINCT printf('src_16_%d_%d', tile_x, tile_y) AS key, 90 - 360*atan(exp(-(0.5::DOUBLE - tile_y/65536.0::DOUBLE)*2*pi()))/pi() AS n, tile_x/65536.0::DOUBLE*360 - 180 AS w FROM tile_image")
def src_image_tile(spark, d):
    from tilewright.functions import mercator

    t = get(spark, d, "tile_image").select("tile_x", "tile_y").distinct()
    return t.select(F.format_string("src_16_%d_%d", "tile_x", "tile_y").alias("key"), mercator.tile_north("tile_y", F.lit(16)).alias("n"), mercator.tile_west("tile_x", F.lit(16)).alias("w"))


@query("square_names_round_trip", "c_custkey b, same l", "SELECT c_custkey, true AS same FROM grid_square")
def square_names_round_trip(spark, d):
    """A point's tile, its name, the name's tile: the same tile."""
    t = get(spark, d, "grid_square").select("c_custkey", "level", grid.tile_x("lon", "level").alias("tx"), grid.tile_y("lat", "level").alias("ty"))
    t = t.withColumn("t", grid.parse_tile_name(grid.tile_name("tx", "ty", "level")))
    return t.select("c_custkey", ((F.col("t.tx") == F.col("tx")) & (F.col("t.ty") == F.col("ty")) & (F.col("t.level") == F.col("level"))).alias("same"))
