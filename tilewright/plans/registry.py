"""Names of the queries, the Spark side and the DuckDB side.

A query's schema is written once ("a b, x d, s v, f l": long, double, text, boolean); both sides are
cut to it, and doubles are rounded to six places, where the two engines' mathematics agree.
"""

from __future__ import annotations

import functools
import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.plans import views

FLAGSHIP = "classify_squares"
MODULES = ("scalars", "generators", "joins", "aggregations", "windows", "sets", "geometry", "rasters", "catalogs", "kernels", "fields")

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_SPARK_TYPES = {"b": "long", "d": "double", "v": "string", "l": "boolean"}
_DUCK_TYPES = {"b": "BIGINT", "d": "DOUBLE", "v": "VARCHAR", "l": "BOOLEAN"}


def _with_views(sql: str) -> str:
    """Put the views that a text names before it, those they need first."""
    found: list[str] = []

    def need(text: str) -> None:
        for name in views.DUCK:
            if re.search(rf"(?:FROM|JOIN) {name}\b", text) and name not in found:
                need(views.DUCK[name])
                if name not in found:
                    found.append(name)

    need(sql)
    return ", ".join(f"{n} AS ({views.DUCK[n]})" for n in found)


def query(name: str, schema: str, duck: str | None = None, ctes: str = ""):
    """Register f(spark, sf_dir) under a name; duck: a SELECT; ctes: named tables it needs beside the views."""
    fields = [x.split() for x in schema.split(",")]

    def put(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            value = lambda c, t: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) if t == "d" else F.col(c).cast(_SPARK_TYPES[t])
            return df.select(*[value(c, t).alias(c) for c, t in fields])

        assert name not in _QUERIES, name
        _QUERIES[name] = run
        if duck:
            value = lambda c, t: f"round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE AS {c}" if t == "d" else f"CAST({c} AS {_DUCK_TYPES[t]}) AS {c}"
            word = "WITH RECURSIVE" if ctes.startswith("RECURSIVE ") else "WITH"
            named = ", ".join(filter(None, [_with_views(f"{ctes} {duck}"), ctes.removeprefix("RECURSIVE ")]))
            _SQL[name] = (f"{word} {named} " if named else "") + f"SELECT {', '.join(value(c, t) for c, t in fields)} FROM ({duck})"
        return f

    return put


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tilewright.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
