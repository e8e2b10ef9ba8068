"""Tables: the gazetteer's tab-separated rows, one XML file per tile, folders of files, settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the gazetteer that are used, by place. Fixed values.
PLACE_COLUMNS = {0: ("geonameid", "long"), 1: ("name", "string"), 2: ("asciiname", "string"), 4: ("latitude", "double"), 5: ("longitude", "double"), 6: ("feature_class", "string"), 7: ("feature_code", "string"), 14: ("population", "long"), 15: ("elevation", "string"), 16: ("dem", "string")}
PLACE_WIDTH = 19

TILE_XML = "FileName STRING, Source STRING, ZoomLevel INT, TileX INT, TileY INT, LocalTileX INT, LocalTileY INT, Width INT, Height INT, ImageExtension STRING, NorthLatitude DOUBLE, SouthLatitude DOUBLE, WestLongitude DOUBLE, EastLongitude DOUBLE, URL STRING"


def parse_places(lines: DataFrame) -> DataFrame:
    """Lines (value) with at least nineteen columns; others are left out."""
    part = F.split("value", "\t")
    t = lines.where(F.size(part) >= PLACE_WIDTH)
    return t.select(*[F.expr(f"try_cast(split(value, '\\t')[{k}] AS {kind})").alias(name) for k, (name, kind) in PLACE_COLUMNS.items()])


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return parse_places(spark.read.text(path))


def read_tile_xml(spark: SparkSession, path: str) -> DataFrame:
    """One record per XML file."""
    return spark.read.format("xml").option("rowTag", "ImageTile").schema(TILE_XML).load(path)


def write_tile_xml(tiles: DataFrame, path: str) -> None:
    tiles.write.format("xml").option("rootTag", "ImageTiles").option("rowTag", "ImageTile").save(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, folder, name and length of files, without reading them."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    return t.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "length")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images as RGB bytes, rows from the top: Spark's decoder gives blue first."""
    t = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for h, w, n, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                out.append((np.repeat(a, 3, 2) if n == 1 else a[:, :, 2::-1]).tobytes())
            yield pdf[["origin", "height", "width"]].assign(rgb=out)

    return t.mapInPandas(run, "origin string, height int, width int, rgb binary")


def read_water(spark: SparkSession, path: str) -> DataFrame:
    """Correction fields: their box, size and the factors of each texel (scale and three offsets, float32, row 0 in the north)."""
    t = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import numpy as np

        from tilewright.sources.containers import parse_field

        for pdf in batches:
            found = [parse_field(bytes(c)) for c in pdf["content"]]
            rows = [(*(f[k] for k in "wesn"), f["size"], np.concatenate([f["scale"][..., None], f["offset"]], 2).astype("<f4").tobytes()) for f in found]
            yield type(pdf)(rows, columns=["w", "e", "s", "n", "size", "factors"])

    return t.mapInPandas(run, "w double, e double, s double, n double, size int, factors binary")


@dataclass
class Settings:
    """Settings of a run; what a saved file lacks keeps its default."""

    source: str = "google"
    zoom: int = 17
    wait_ms: int = 10
    workers: int = 4
    tiles_per_image: int = 66
    shrink: float = 0.01
    cut_at_coast: bool = True
    margin_km: float = 5.556

    @classmethod
    def load(cls, saved: dict) -> Settings:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in saved.items() if k in known and v is not None})

    def save(self) -> dict:
        return asdict(self)
