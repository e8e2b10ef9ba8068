"""Places and landmarks: filters, heights, text of landmark files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the gazetteer: divisions, populated places that are wanted, those of them that are capitals.
DIVISION = "ADM3"
CODES = ("PPL", "PPLA", "PPLA2", "PPLA3", "PPLC", "PPLL", "PPLX")
CAPITALS = ("PPLC", "PPLA", "PPLA2", "PPLA3")
PREFIX = "^Comuna (de )?"
HEIGHT_MARGIN = 50.0


def height() -> Column:
    """Elevation, else the terrain model, whichever first is a plausible whole number, else 0; with a margin."""
    plausible = lambda v: F.when(v.between(-400, 7000), v)
    whole = [F.expr(f"CASE WHEN trim({c}) RLIKE '^[+-]?[0-9]+$' THEN try_cast(trim({c}) AS BIGINT) END") for c in ("elevation", "dem")]
    return F.coalesce(*[plausible(v) for v in whole], F.lit(0)).cast("double") + HEIGHT_MARGIN


def filtered(places: DataFrame, divisions: bool = True) -> DataFrame:
    """Third-order divisions, their names without the prefix, and populated places of the wanted codes that have people or are capitals."""
    division = (F.col("feature_class") == "A") & (F.col("feature_code") == DIVISION) & F.lit(divisions)
    town = (F.col("feature_class") == "P") & F.col("feature_code").isin(*CODES) & ((F.col("population") > 0) | F.col("feature_code").isin(*CAPITALS))
    name = F.trim(F.when(F.col("feature_class") == "A", F.regexp_replace("name", PREFIX, "")).otherwise(F.col("name")))
    return places.where(division | town).withColumn("height", height()).withColumn("division", F.col("feature_class") == "A").withColumn("name", name)


def landmark_text(name, lon, lat, kind, priority, height_) -> Column:
    return F.format_string("<[landmark][element][]<[string8][name][%s]><[vector2_float64][lon_lat][%.6f %.6f]><[uint32][type][%d]><[uint32][priority][%d]><[float64][height][%.1f]>>", F.col(name), F.col(lon), F.col(lat), F.col(kind), F.col(priority), F.col(height_))
