"""A Spark-first engine for georeferenced raster tiles and their catalogues."""

__version__ = "0.1.0"
