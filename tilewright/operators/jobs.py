"""Rules about jobs: levels to build for a square and zoom, and what must hold before a run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.grid import col

DEEPEST = 14
#: Sources that need a key, and the deepest zoom of those that have one. Fixed values.
KEYED = ("mapbox", "here")
DEEPEST_ZOOM = {"usgs": 16}


def choose_levels(size, zoom) -> Column:
    """The square's own level and the up to three that resolve its zoom, none deeper than 14."""
    deep = F.least(col(zoom) - 3, F.lit(DEEPEST))
    levels = F.sequence(col(size), F.lit(15).cast("long"))
    return F.filter(levels, lambda x: (x <= deep) & ((x == col(size)) | (x >= F.least(col(zoom) - 5, F.lit(DEEPEST)))))


def precondition(source, zoom, key) -> Column:
    deep = F.lit(False)
    for name, most in DEEPEST_ZOOM.items():
        deep |= (col(source) == name) & (col(zoom) > most)
    return F.when(deep, "zoom too deep").when(col(source).isin(*KEYED) & F.coalesce(col(key), F.lit("")).eqNullSafe(""), "key missing").otherwise("ok")
