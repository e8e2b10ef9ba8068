"""Correction of water: haze over a body's tone, cloud, feathered masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the correction.
CLOUD_FROM, CLOUD_TO = 60.0, 100.0
DEAD_WEIGHT, DEAD_OFFSET, DEAD_SCALE = 0.004, 0.25, 1e-4


def _dead(c: Column, limit: float) -> Column:
    return F.when(c < limit, 0.0).otherwise(c)


def correction(texels: DataFrame) -> DataFrame:
    """texels (local, target, soft, ref, ref_local, ...) with scale and offset.

    What a texel is above its body's tone is haze and is taken off by the mask's weight; as haze grows
    to cloud the reference's own detail takes over.
    """
    t = texels.withColumn("_haze", F.greatest(F.col("local") - F.col("target"), F.lit(0.0)))
    cloud = F.least(F.greatest((F.col("_haze") - CLOUD_FROM) / (CLOUD_TO - CLOUD_FROM), F.lit(0.0)), F.lit(1.0))
    t = t.withColumn("_heavy", _dead(cloud * F.col("soft"), DEAD_WEIGHT)).withColumn("_soft", _dead(F.col("soft"), DEAD_WEIGHT))
    scale = 1 - F.col("_heavy")
    offset = (F.col("ref") + F.col("target") - F.col("ref_local")) * F.col("_heavy") - F.col("_haze") * F.col("_soft") * (1 - F.col("_heavy"))
    t = t.withColumn("scale", F.when(F.abs(scale - 1) < DEAD_SCALE, 1.0).otherwise(scale))
    return t.withColumn("offset", F.when(F.abs(offset) < DEAD_OFFSET, 0.0).otherwise(offset)).drop("_haze", "_heavy", "_soft")


def identity(texels: DataFrame, keys: list[str]) -> DataFrame:
    """Squares whose whole field changes nothing: these need no rebuild."""
    same = (F.col("scale") == 1) & (F.col("offset") == 0)
    return texels.groupBy(*keys).agg(F.bool_and(same).alias("same")).where("same").select(*keys)
