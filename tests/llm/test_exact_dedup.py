import hashlib

from oracle import assert_same
from pyspark.sql import functions as F

from tilewright.llm import exact_dedup as ed

ROWS = [(1, None, "a"), (2, "", "b"), (3, "x", "c"), (3, "x", "c"), (None, "x", "d"), (None, "n", "e"), (5, "é" * 90000, "f"), (4, "é" * 90000, "g"), (6, "X", "h")]
SCHEMA = "doc_id long, text string, keep_id string"


def test_against_sql(spark, sf_dir):
    assert_same(ed.op10_exact_dedup(spark, sf_dir), ed.ORACLE_SQL, sf_dir)


def test_odd_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in ed.groups(df).collect()), key=repr)
    want = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (None, None, 1, True), (5, 5, 2, True), (4, 5, 2, False), (6, 6, 1, True)]
    assert got == sorted(want, key=repr)
    assert ed.groups(df.limit(0)).count() == 0
    sha = {r["doc_id"]: r["text_sha256"] for r in ed.groups(df).collect()}
    assert sha[1] == hashlib.sha256(b"").hexdigest()


def test_colliding_hashes_are_told_apart(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    weak = ed.groups(df, hashed=lambda text: F.lit(b"0"))
    assert sorted(map(tuple, weak.collect()), key=repr) == sorted(map(tuple, ed.groups(df).collect()), key=repr)


def test_smallest_id(spark):
    df = spark.createDataFrame([(2, "a", ""), (1, "a", "")], SCHEMA)
    assert {r["keep_id"] for r in ed.groups(df, keep="min").collect()} == {1}


def test_deduplicate(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = ed.deduplicate(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["keep_id"]) for r in out.collect()), key=repr)
    assert got == sorted([(2, "b"), (3, "c"), (None, "e"), (5, "f"), (6, "h")], key=repr)
    assert ed.deduplicate(df.where("doc_id = 1")).first()["text"] is None


def test_columns_of_any_name_and_type(spark):
    rows = [(1, "x", {"a": 1}, "p"), (1, "x", {"a": 2}, "p"), (2, None, None, None), (2, "", {}, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash map<string,int>, `row.c``0` string")
    for keep in ("max", "min"):
        out = ed.deduplicate(df, keep)
        assert out.columns == df.columns and out.count() == 2
        assert {r["hash"]["a"] for r in out.where("doc_id = 1").collect()} == {2 if keep == "max" else 1}


def test_native_plan(spark, sf_dir):
    plan = ed.op10_exact_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
