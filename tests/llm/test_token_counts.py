import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from tilewright.llm import token_counts as tc


def blocks(spark, ids, size):
    data = np.array(ids, "<u2").tobytes()
    rows = [("f", k, data[a : a + size]) for k, a in enumerate(range(0, len(data), size))] or [("f", 0, b"")]
    return spark.createDataFrame(rows, "file string, block long, data binary")


@pytest.mark.parametrize("size", [2, 6, 64])
def test_stitching(spark, size):
    ids = [5, 6, 9, 9, 1, 2, 3, 4, 5, 6, 7, 9, 8, 8, 9, 3, 3, 3]
    got = sorted((r["ordinal"], r["n_tokens"], r["ended"]) for r in tc.scan(blocks(spark, ids, size), 9).collect())
    assert got == [(0, 2, True), (1, 0, True), (2, 7, True), (3, 2, True), (4, 3, False)]


def test_no_tokens(spark):
    assert tc.scan(blocks(spark, [], 4), 9).count() == 0


def test_given_tables(spark, sf_dir):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids)) for r in docs)
    assert sorted(tuple(r) for r in tc.op5_token_counts(spark, sf_dir).collect()) == want


def test_odd_rows(spark):
    rows = [(1, None, 0), (1, "", 0), (None, "a b", 0), (2, "<|endoftext|> x", 0), (3, "w " * 9000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file long")
    files = tc.written(tc.flat_files(df, block=64), "t")
    got = tc.names(files).join(tc.scan(files.where("kind = 'ids'")), ["file", "ordinal"]).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in got) == [(0, True), (1, False), (1, False), (2, True), (3, True)]
    assert tc.names(tc.flat_files(df.limit(0))).count() == 0


def test_a_lost_document_is_an_error(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tc, "scan", lambda blocks: spark.createDataFrame([("f", 0, 1)], "file string, ordinal long, n_tokens long"))
    with pytest.raises(Exception, match="not met"):
        tc.op5_token_counts(spark, sf_dir).collect()
