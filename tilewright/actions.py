"""What a user runs: convert a job, tell verdicts of squares, plan and carry out an installation, make landmarks.

Each reads files from any store that Spark reads and gives a frame; `python -m tilewright` prints it. Files are
written by executors, so that output folders must be shared ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import grid
from tilewright.operators import catalog, convert, lines, places, strokes
from tilewright.session import shared_dir, stored
from tilewright.sources import file_sink, tables, text_jobs


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(0).alias("file"), F.col("value").alias("text"))


def read_line(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The segments of a coast file: those of the coast, chained, and those of its closed islands."""
    numbered = _text(spark, path).select("file", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    points = text_jobs.line_points(numbered).withColumn("line", F.col("island")).checkpoint()
    chained = strokes.chain(points)
    in_order = chained.select("line", (F.col("place") * 1_000_000_000 + F.col("seq")).alias("seq"), "lon", "lat")
    kinds = {r["line"] >= 0 for r in points.select("line").distinct().collect()}  # a coast and some islands
    coast = lines.segments(in_order.where("line < 0"), closed=False) if False in kinds else None
    ring = lines.segments(in_order.where("line >= 0"), closed=True) if True in kinds else None
    return coast, ring


def carried_on(coast: DataFrame | None, south: float, north: float) -> DataFrame | None:
    return None if coast is None else lines.extended(coast, south, north)


def classify(spark: SparkSession, names: DataFrame, line_file: str, margin_km: float = lines.MARGIN_KM, texels: int = 65) -> DataFrame:
    """Squares by name: their range of the signed field, sampled from edge to edge, and their verdict."""
    coast, ring = read_line(spark, line_file)
    squares = catalog.downloaded(names).select("name", "level", "tx", "ty")
    squares = squares.select("*", *[c.alias(k) for k, c in grid.square_edges("tx", "ty", F.col("level")).items()])
    south, north = squares.agg(F.min("s"), F.max("n")).first()
    steps = F.sequence(F.lit(0), F.lit(texels - 1))
    at = squares.select("name", "w", "e", "s", "n", F.explode(steps).alias("j")).select("*", F.explode(steps).alias("i"))
    lon = F.col("w") + (F.col("e") - F.col("w")) * F.col("i") / F.lit(texels - 1.0)
    lat = F.col("s") + (F.col("n") - F.col("s")) * F.col("j") / F.lit(texels - 1.0)
    spots = at.select("name", "i", "j", lon.alias("lon"), lat.alias("lat"))
    km = lines.signed(spots, ["name", "i", "j"], carried_on(coast, south - 1, north + 1), ring, 2 * margin_km + 1)
    ranges = km.groupBy("name").agg(F.min("km").alias("least"), F.max("km").alias("most"))
    return lines.square_verdicts(squares.join(ranges, "name"), coast, ring, margin_km).select("name", "w", "e", "s", "n", "least", "most", "verdict")


def check_job(spark: SparkSession, job: str) -> DataFrame:
    """What of a job a conversion does not do: kind (error or note) and message."""
    return text_jobs.unsupported(_text(spark, job), "file").orderBy("pos").select("kind", "message")


def convert_job(
    spark: SparkSession, job: str, images: str, references: str, out: str, n: int = 2048, linear: bool = False, line_file: str | None = None, margin_km: float = lines.MARGIN_KM,
    lakes_file: str | None = None, water: str | None = None, black_is_missing: bool = False,
) -> DataFrame:
    """A job's textures from images and their georeference files; rows (name, bytes) of what was written.

    Cut at a coast, and at lakes, where files of these are given; corrected where fields of water are.
    """
    regions = text_jobs.regions(_text(spark, job), "file")
    refs = spark.read.text(references, wholetext=True).select(F.monotonically_increasing_id().alias("file"), F.col("value").alias("text"))
    refs = text_jobs.georeferences(refs.checkpoint(), "file").withColumn("folder", F.lit(0))
    refs = catalog.numbered(refs, "image")
    pictures = tables.read_images(spark, images).withColumn("image", F.element_at(F.split("origin", "/"), -1))
    found = pictures.join(refs, "image").select("priority", "x", "y", "step_x", "step_y", "height", "width", "rgb")
    coast, ring = read_line(spark, line_file) if line_file else (None, None)
    south, north = regions.agg(F.min("s"), F.max("n")).first()
    lakes = read_line(spark, lakes_file)[1] if lakes_file else None
    fields = tables.read_water(spark, water) if water else None
    files = convert.convert(regions, found, n, linear, carried_on(coast, south - 1, north + 1), ring, margin_km, lakes, fields, black_is_missing)
    return write_textures(files.withColumn("name", F.regexp_replace(grid.tile_name("tx", "ty", F.col("level")), "[.]ttc$", "")), out)


def write_textures(files: DataFrame, out: str) -> DataFrame:
    """Write texture and mask files by name, as one job that is committed as a whole; rows (name, bytes) of what was written."""
    spark = files.sparkSession
    kinds = F.array(F.struct(F.lit("").alias("kind"), F.col("texture").alias("content")), F.struct(F.lit("_mask").alias("kind"), F.col("mask").alias("content")))
    rows = files.select("name", F.explode(F.filter(kinds, lambda x: x["content"].isNotNull())).alias("f"))
    manifest = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    file_sink.write_files(rows.select(F.concat("name", "f.kind", F.lit(".ttc")).alias("name"), F.col("f.content").alias("content")), out, manifest=manifest)
    return spark.read.schema("name string, bytes long").csv(manifest)


def install(spark: SparkSession, built: str, there: str, level: int = 9) -> DataFrame:
    """Copy a square's textures into an installation, and delete those that it no longer makes, as one job: the plan that was carried out."""
    made = tables.list_files(spark, built, "*.ttc")
    plan = stored(catalog.install_plan(made, tables.list_files(spark, there, "*"), level), "install-plan")
    rows = plan.join(made.select("name", "path"), "name", "left").select("name", F.when(F.col("action") == "copy", F.col("path")).alias("source"))
    file_sink.write_files(rows, there)
    return plan


def write_jobs(spark: SparkSession, regions: DataFrame, references: DataFrame, out: str) -> None:
    """A square's job file for each key of regions (job, level, w, e, s, n, mask) and the georeferences of its images
    (image, step_x, step_y, x, y), as files of one folder; job files of earlier runs go."""
    jobs = text_jobs.job_text(regions, "job").select(F.concat(F.col("job").cast("string"), F.lit(".tmc")).alias("name"), F.col("text").cast("binary").alias("content"))
    aids = references.select(F.concat("image", F.lit(".aid")).alias("name"), text_jobs.georeference_text("image", "step_x", "step_y", "x", "y").cast("binary").alias("content"))
    file_sink.write_files(jobs.unionByName(aids), out, stale="*.tmc")


def landmarks(spark: SparkSession, gazetteer: str, km: float = 8.0) -> DataFrame:
    """Labels of a gazetteer's divisions and towns, one of those of a name that lie near each other, with their text."""
    kept = places.filtered(tables.read_places(spark, gazetteer))
    kept = kept.selectExpr("geonameid AS place_id", "name", "latitude AS lat", "longitude AS lon", "population", "division", "height")
    labels = kept.join(strokes.dedupe_places(kept, km).select("place_id"), "place_id", "left_semi")
    labels = labels.withColumn("kind", F.lit(0)).withColumn("priority", F.lit(3))
    return labels.withColumn("text", places.landmark_text("name", "lon", "lat", "kind", "priority", "height")).drop("kind", "priority")
