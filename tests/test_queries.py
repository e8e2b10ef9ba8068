"""Every registered query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from tilewright.plans import registry
from tilewright.session import TABLES

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rounded(rows):
    fix = lambda x: round(x, 5) + 0.0 if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    out = duck.execute(SQL[name])
    names = [c[0] for c in out.description]
    want = rounded(out.fetchall())
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == names
    assert rounded(tuple(r) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()
