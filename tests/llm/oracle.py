"""Hold a query against its DuckDB SQL over given frames or folders."""

import math

import duckdb


def duck_rows(sql, sf_dir, tables=("documents", "labels", "pages", "conversations")):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def rounded(rows):
    fix = lambda x: (round(x, 9) if math.isfinite(x) else str(x)) if isinstance(x, float) else x
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


def assert_same(df, sql, sf_dir):
    names, want = duck_rows(sql, sf_dir)
    got = [tuple(r) for r in df.select(*names).collect()]
    assert rounded(got) == rounded(want)
