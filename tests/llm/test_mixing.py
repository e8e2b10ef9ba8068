import re
from collections import defaultdict

import duckdb
import pytest
from oracle import assert_same, rounded
from pyspark.sql import types as T

from tilewright.llm import mixing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType()), T.StructField("copies", T.LongType())])


def reshared(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def check(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    want, taken, largest = reshared(dict(sizes)), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_given_tables(spark, sf_dir):
    df = mixing.assignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    check(df.collect())
    assert_same(mixing.op2_mixing(spark, sf_dir), mixing.ORACLE_SQL, sf_dir)


def test_odd_rows(spark):
    rows = [(1, "a b c", "x", "s", 9), (1, "a b c", "x", "s", 9), (2, None, "x", None, None), (3, "", None, "", 0), (4, "w " * 5000, None, "", 0), (None, "q r", "y", "", 0), (None, "q", "y", "", 0), (5, None, "z", "", 0), (6, "a\x0bb\x1cc d", "y", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.assignments(docs).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["size"]) for r in got}
    assert (6, 2) in by and (2, 0) in by and (3, 0) in by
    check(got)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in out.collect())
    assert words == sum(r["taken"] for r in got)


def test_a_repeated_row_is_cut_by_count(spark, tmp_path):
    """Null ids, one id for a third of all rows, and copies in several partitions: near the target to one row."""
    rows = [(None, "a b c d e", "p", "", 0)] * 1000 + [(7, "a b c", "q", "", 0)] * 900 + [(k, "w " * (k % 9), "q", "", 0) for k in range(1000)] + [(None, None, "p", "", 0)] * 30
    for name, kept in (("all", rows), ("one", rows[:1000] + [(1, "x " * 300, "q", "", 0)])):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(kept, SCHEMA).repartition(7).write.parquet(path)
        docs = spark.read.parquet(path)
        got = mixing.assignments(docs).collect()
        assert len(got) == len(kept)
        check(got)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
        want = con.execute(mixing.ORACLE_SQL).fetchall()
        assert rounded((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == rounded(want)
        words = sum(len((r["text"] or "").split()) for r in mixing.mix(docs).collect())
        assert words == sum(r["taken"] for r in got)


def test_many_sources(spark):
    rows = [(k, "w " * (1 + k % 5), f"host{k % 200}", "", 0) for k in range(600)]
    check(mixing.assignments(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.assignments(docs).count() == 0 and mixing.mix(docs).count() == 0


def test_one_source(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "only", "", 0) for i in range(50)], SCHEMA)
    got = mixing.assignments(docs).collect()
    assert all(r["taken"] == r["size"] for r in got)


def test_mix_does_not_depend_on_the_split(spark, tmp_path):
    rows = [(7, "one two three", "a", "", 0)] * 3000 + [(k, "w " * (k % 9), "b", "", 0) for k in range(2000)] + [(8, "x y", None, "", 0)] * 500
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "docs"))
    key, held = "spark.sql.files.minPartitionNum", {}
    try:
        for first, then in (("2", "17"), ("17", "2")):
            spark.conf.set(key, first)
            out = mixing.mix(spark.read.parquet(str(tmp_path / "docs")))
            spark.conf.set(key, then)
            held[first] = {r["source"]: r["n"] for r in out.groupBy("source").count().withColumnRenamed("count", "n").collect()}
    finally:
        spark.conf.unset(key)
    want = reshared({"a": 9000, "b": sum(k % 9 for k in range(2000)), None: 1000})
    assert held["2"] == held["17"]
    assert abs(3 * held["2"]["a"] - want["a"]) <= 3 and abs(2 * held["2"][None] - want[None]) <= 2
