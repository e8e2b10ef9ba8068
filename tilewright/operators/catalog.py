"""Catalogues of files: what is there, what is stale, what an installation does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import grid


def offered_not_rejected(offered: DataFrame, log: DataFrame) -> DataFrame:
    """(kind, field) offered, without those that a log's lines reject."""
    pattern = r"error: (\S+) has no field (\w+)!"
    rejected = log.select(F.regexp_extract("line", pattern, 1).alias("kind"), F.regexp_extract("line", pattern, 2).alias("field")).where("kind <> ''")
    return offered.distinct().join(rejected, ["kind", "field"], "left_anti")


def downloaded(names: DataFrame, name: str = "name") -> DataFrame:
    """Folders named after squares whose name round-trips through the grid.

    A name that parses does: its digits are canonical and its corner is a multiple of the level's step.
    """
    t = names.withColumn("_t", grid.parse_tile_name(name, grid.SQUARE_PATTERN)).where("_t is not null")
    return t.select("*", "_t.level", "_t.tx", "_t.ty").drop("_t")


def installed(names: DataFrame, level: int = 9, name: str = "name") -> DataFrame:
    """Distinct squares of a level that hold any installed tile of that level or deeper."""
    t = names.select(grid.parse_tile_name(name).alias("t")).where(F.col("t.level") >= level)
    up = F.pow(F.lit(2.0), F.col("t.level") - level)
    return t.select(F.floor(F.col("t.tx") / up).cast("long").alias("x"), F.floor(F.col("t.ty") / up).cast("long").alias("y")).distinct()


def squares(names: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """Squares by folder, for folders of one level only; mixed folders are reported with their levels' number."""
    t = names.select(folder, grid.parse_tile_name(name).alias("t")).where("t is not null")
    t = t.select(folder, "t.level", "t.tx", "t.ty")
    return t.groupBy(folder).agg(F.count_distinct("level").alias("levels"), F.count_distinct("level", "tx", "ty").alias("squares"))


def find_job(paths: DataFrame, depth: int = 3) -> DataFrame:
    """Per root the job file of the first folder that has one: a folder before those in it, these by name, down to a depth.

    Of a folder's job files the first by name, whatever its case.
    """
    parts = F.split(F.lower("path"), "/")
    t = paths.where((F.size(parts) <= depth + 1) & F.lower("path").endswith(".tmc"))
    folder = F.slice(parts, F.lit(1), F.size(parts) - 1)  # arrays are ordered by their parts, a shorter one first
    return t.groupBy("root").agg(F.min_by("path", F.struct(folder, F.element_at(parts, -1), "path")).alias("path"))


def install_plan(built: DataFrame, there: DataFrame, level: int = 9) -> DataFrame:
    """(action, name): copy what is built; in a folder that a square owns, as only one of level 9 does, first delete
    the tiles that are there and not built. Names are compared whatever their case; an empty build does nothing."""
    b = built.select("name").distinct()
    copies = b.select(F.lit("copy").alias("action"), "name")
    if level != 9:
        return copies
    t = there.select("name").distinct().withColumn("_key", F.lower("name")).where(F.col("_key").endswith(".ttc"))
    some = b.limit(1).select(F.lit(1).alias("_some"))
    stale = t.join(b.select(F.lower("name").alias("_key")), "_key", "left_anti").crossJoin(some).select(F.lit("delete").alias("action"), "name")  # one row at most
    return stale.unionByName(copies)


def duplicates(files: DataFrame) -> DataFrame:
    return files.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def deletable(folders: DataFrame, raw: bool, stitched: bool, tiles: bool) -> DataFrame:
    """Working folders by kind: raw or texture output, stitched images, downloaded tiles (all digits)."""
    kind = F.when(F.col("name").rlike("-(raw|ttc)$"), "output").when(F.col("name").endswith("-stitched"), "stitched").when(F.col("name").rlike("^[0-9]+$"), "tiles")
    wanted = [k for k, on in (("output", raw), ("stitched", stitched), ("tiles", tiles)) if on]
    return folders.withColumn("kind", kind).where(F.col("kind").isin(*wanted) if wanted else F.lit(False))


def stale_backups(names: DataFrame, keep: int = 20) -> DataFrame:
    """All but the newest backups by name, without a sort of all of them: what lies below the keep-th name."""
    least = names.orderBy(F.desc("name")).limit(keep).agg(F.min("name").alias("_least"))
    return names.crossJoin(F.broadcast(least)).where(F.col("name") < F.col("_least")).drop("_least")  # least is one row


def hash_manifest(files: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 of each file, and in `manifest` that of a folder's sorted lines (a folder's list is bounded by its square)."""
    t = files.select("folder", "name", F.sha2(F.col(content), 256).alias("sha"))
    line = F.concat_ws("  ", "sha", "name")
    m = t.groupBy("folder").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("name", line.alias("l"))))["l"], "\n").cast("binary"), 256).alias("manifest"))
    return t.join(m, "folder")


def numbered(files: DataFrame, name: str) -> DataFrame:
    """Files in case-insensitive name order: priority 1 first, per folder."""
    return files.withColumn("priority", F.row_number().over(Window.partitionBy("folder").orderBy(F.lower(name), name)))
