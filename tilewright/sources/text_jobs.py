"""Text formats: typed triples, job and georeference files, coast lines; parsing and emitting.

A field is <[type][name][value]; an opening bracket begins it, nesting is by order only. Values are
read with regular expressions into an ordered array, so a file is one row until it is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.grid import col

FIELD = r"<\[([^\]]*)\]\[([^\]]*)\]\[([^\]]*)\]"


def fields(text) -> Column:
    """Array of structs (kind, name, value) in order of the text."""
    part = lambda k: F.regexp_extract_all(col(text), F.lit(FIELD), F.lit(k))
    return F.arrays_zip(part(1).alias("kind"), part(2).alias("name"), part(3).alias("value"))


def field_rows(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    return files.select(key, F.posexplode(fields(text)).alias("pos", "f")).select(key, "pos", "f.kind", "f.name", "f.value")


def _pair(value: Column, k: int) -> Column:
    return F.try_element_at(F.split(F.trim(value), r"\s+"), F.lit(k)).cast("double")


def regions(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Jobs' regions: key, region, level, w, e, s, n, mask.

    A `level` opens a region and later fields are its own; a mask flag before any level is the
    file's and inherited; corners are put in order; a file without a region raises.
    """
    w = Window.partitionBy(key).orderBy("pos")
    rows = field_rows(files, key, text).withColumn("region", F.sum((F.col("name") == "level").cast("int")).over(w))
    pick = lambda n: F.max_by("value", F.when(F.col("name") == n, F.col("pos")))
    t = rows.groupBy(key, "region").agg(*[pick(n).alias(n) for n in ("level", "lonlat_min", "lonlat_max", "write_images_with_mask")])
    file_mask = t.where("region = 0").select(key, F.col("write_images_with_mask").alias("_file"))
    checked = files.select(key).join(t.where("region > 0"), key, "left").join(file_mask, key, "left")
    level = F.when(F.col("region").isNull(), F.raise_error(F.lit("a job without regions"))).otherwise(F.col("level").cast("long"))
    a, b = F.col("lonlat_min"), F.col("lonlat_max")
    low = lambda k: F.least(_pair(a, k), _pair(b, k))
    high = lambda k: F.greatest(_pair(a, k), _pair(b, k))
    mask = F.coalesce(F.col("write_images_with_mask"), F.col("_file"), F.lit("false")) == "true"
    return checked.select(key, (F.col("region") - 1).alias("region"), level.alias("level"), low(1).alias("w"), high(1).alias("e"), low(2).alias("s"), high(2).alias("n"), mask.alias("mask"))


#: Fields of a job that a conversion knows; structure has no name, or these two. Fixed values.
KNOWN = ("", "region_list", "element", "folder_source_files", "folder_destination_ttc", "folder_destination_raw", "write_ttc_files", "write_raw_files", "do_heightmaps", "always_overwrite", "write_images_with_mask", "level", "lonlat_min", "lonlat_max", "aerial_images")


def unsupported(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """What a conversion does not do of what a job asks for: key, kind (error or note) and message, in order of the text.

    Heights are not made and textures are all that is, so a job that wants heights, or no textures, is an
    error. What changes nothing is a note.
    """
    rows = field_rows(files, key, text).withColumn("_n", F.lower("name")).withColumn("_on", F.lower(F.trim("value")).isin("true", "1"))
    message = (
        F.when((F.col("_n") == "do_heightmaps") & F.col("_on"), "error: heights are not made")
        .when((F.col("_n") == "always_overwrite") & ~F.col("_on"), "note: files are overwritten whatever always_overwrite says")
        .when((F.col("_n") == "write_raw_files") & F.col("_on"), "note: raw files are not made")
        .when((F.col("_n") == "write_ttc_files") & ~F.col("_on"), "error: textures are all that is made, and the job wants none")
        .when(~F.col("_n").isin(*KNOWN), F.concat(F.lit("note: unknown field "), F.col("name")))
    )
    out = rows.withColumn("_m", message).where("_m is not null")
    return out.select(key, "pos", F.substring_index("_m", ":", 1).alias("kind"), F.expr("substr(_m, instr(_m, ': ') + 2)").alias("message"))


def georeferences(files: DataFrame, key: str, text: str = "text", strict: bool = True) -> DataFrame:
    """Georeference files: key, image, flip, step_x, step_y, x, y. strict: missing parts or a zero step raise."""
    rows = field_rows(files, key, text)
    pick = lambda n: F.min_by("value", F.when(F.col("name") == n, F.col("pos")))
    t = files.select(key).join(rows.groupBy(key).agg(*[pick(n).alias(n) for n in ("image", "flip_vertical", "steps_per_pixel", "top_left")]), key, "left")
    out = t.select(key, "image", (F.col("flip_vertical") == "true").alias("flip"), _pair(F.col("steps_per_pixel"), 1).alias("step_x"), _pair(F.col("steps_per_pixel"), 2).alias("step_y"), _pair(F.col("top_left"), 1).alias("x"), _pair(F.col("top_left"), 2).alias("y"))
    bad = F.col("image").isNull() | F.col("x").isNull() | F.col("y").isNull() | F.coalesce(F.col("step_x") == 0, F.lit(True)) | F.coalesce(F.col("step_y") == 0, F.lit(True))
    if strict:
        return out.withColumn("image", F.when(bad, F.raise_error(F.lit("a georeference is incomplete"))).otherwise(F.col("image")))
    return out.withColumn("ok", ~bad)


def georeference_text(image, step_x, step_y, x, y, flip=False) -> Column:
    num = lambda c: F.format_string("%.12f", col(c))
    flag = F.when(col(flip), "true").otherwise("false")
    return F.concat(
        F.lit("<[file][][]\n<[tm_aerial_image_definition][][]\n<[string8][image]["), col(image), F.lit("]>\n<[bool][flip_vertical]["), flag,
        F.lit("]>\n<[vector2_float64][steps_per_pixel]["), num(step_x), F.lit(" "), num(step_y), F.lit("]>\n<[vector2_float64][top_left]["), num(x), F.lit(" "), num(y), F.lit("]>\n>>\n"),
    )


def region_text(level, w, e, s, n, mask, shrink: float = 0.01) -> Column:
    """One region of a job, its box shrunk."""
    num = lambda c: F.format_string("%.8f", c)
    w, e, s, n = col(w) + shrink, col(e) - shrink, col(s) + shrink, col(n) - shrink
    return F.concat(F.lit("<[region][element][0]<[int][level]["), col(level).cast("string"), F.lit("]><[vector2_float64][lonlat_min]["), num(w), F.lit(" "), num(n), F.lit("]><[vector2_float64][lonlat_max]["), num(e), F.lit(" "), num(s), F.lit("]><[bool][write_images_with_mask]["), F.when(col(mask), "true").otherwise("false"), F.lit("]>>"))


def job_text(regions_: DataFrame, key: str) -> DataFrame:
    """One job text per key from its regions, in order of level."""
    t = regions_.select(key, "level", region_text("level", "w", "e", "s", "n", "mask").alias("_r"))
    t = t.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("level", "_r"))).alias("_rs"))
    body = F.array_join(F.col("_rs")["_r"], "\n")
    return t.select(key, F.concat(F.lit("<[file][][]<[tm_config][aerial_images][]\n<[list][region_list][]\n"), body, F.lit("\n>>>\n")).alias("text"))


def line_points(lines: DataFrame, key: str = "file") -> DataFrame:
    """Lines (file, n, line) of coast files to points: stroke, seq, island (-1: the coast), lat, lon.

    A blank line ends a stroke, `# coast` and `# island N` (or `# lake N`) say what follows; strokes
    of fewer than two points are dropped.
    """
    w = Window.partitionBy(key).orderBy("n")
    text = F.trim("line")
    marker = F.when(text.rlike("^# *coast"), F.lit(-1)).when(text.rlike("^# *(island|lake) +[0-9]+"), F.regexp_extract(text, "([0-9]+)", 1).cast("int"))
    point = text.rlike(r"^[-+0-9.eE]+\s+[-+0-9.eE]+$")
    t = lines.withColumn("_m", marker).withColumn("_p", point)
    t = t.withColumn("island", F.coalesce(F.last("_m", True).over(w), F.lit(-1)))
    t = t.withColumn("stroke", F.sum(F.when(~F.col("_p"), 1).otherwise(0)).over(w)).where("_p")
    parts = F.split(F.trim("line"), r"\s+")
    t = t.select(key, "stroke", "n", "island", parts[0].cast("double").alias("lat"), parts[1].cast("double").alias("lon"))
    s = Window.partitionBy(key, "stroke")
    t = t.withColumn("seq", F.row_number().over(s.orderBy("n")) - 1).withColumn("_k", F.count(F.lit(1)).over(s)).where("_k > 1")
    return t.select(key, "stroke", "seq", "island", "lat", "lon")


def line_settings(lines: DataFrame, key: str = "file") -> DataFrame:
    """land and margin_km of coast files."""
    value = lambda k: F.max(F.when(F.trim("line").rlike(f"^# *{k} "), F.regexp_extract(F.trim("line"), rf"^# *{k} +(\S+)", 1)))
    return lines.groupBy(key).agg(value("land").alias("land"), value("margin_km").cast("double").alias("margin_km"))


def point_lines(points: DataFrame, key: str = "file") -> DataFrame:
    """The inverse: a text per file; a marker stands where the kind of line changes."""
    w = Window.partitionBy(key).orderBy("stroke", "seq")
    kind = F.when(F.col("island") < 0, F.lit("# coast")).otherwise(F.concat(F.lit("# island "), F.col("island").cast("string")))
    t = points.withColumn("_k", kind).withColumn("_pk", F.lag("_k").over(w)).withColumn("_ps", F.lag("stroke").over(w))
    head = F.when(F.col("_ps").isNull() | (F.col("_k") != F.col("_pk")), F.concat(F.when(F.col("_ps").isNull(), "").otherwise("\n"), F.col("_k"), F.lit("\n"))).when(F.col("stroke") != F.col("_ps"), F.lit("\n")).otherwise(F.lit(""))
    t = t.select(key, "stroke", "seq", F.concat(head, F.col("lat").cast("string"), F.lit(" "), F.col("lon").cast("string")).alias("_l"))
    t = t.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("stroke", "seq", "_l"))).alias("_ls"))
    return t.select(key, F.array_join(F.col("_ls")["_l"], "\n").alias("text"))
