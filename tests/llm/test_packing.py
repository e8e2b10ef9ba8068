import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from tilewright.llm import bpe, packing


@given(st.lists(st.integers(1, 64), max_size=200))
def test_pack(lengths):
    bins = packing.pack(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= len(packing.best_fit(np.array(lengths, np.int64), 64))


def test_local_search_empties_a_bin():
    lengths = np.array([5, 4, 4, 3, 2, 2])
    bad = [[0, 3], [1, 2], [4, 5]]
    assert len(packing.local_search(bad, lengths, 10)) == 2


def test_near_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(1023, rng.lognormal(5, 1, 5000).astype(int) + 1)
    assert len(packing.pack(lengths)) <= 1.005 * lengths.sum() / 1024 + 1


LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

ODD = ["", "a", " a", "a  b", "a\n b", "it's <|endoftext|> x", "​q r　s", "a\r\n\r\n b", "tab\tx", " ", "\n", "don't we'll 3 4's", "a\x85 b", "a\x1c b", "é́ ñ", "\U0001f600 x"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_those_of_the_library(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.shared().encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


MIXED = ["a\tb\tc\n\n", "x\u3000y\u3000z\n\n", "a\tb\tc\td\n\n e", "a\xa0b  c", "a\tb ", "\ta b\n", "a\n \tb\tc", "one two\nthree", "a\x0bb\x0cc\r\n\r\nd"]


@pytest.mark.parametrize("text", MIXED)
def test_ids_where_other_gaps_offset_longer_ones(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.shared().encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def check(docs, got, whole=True):
    """Pieces against the library's ids; with whole, also that sequences are filled without gaps."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, text in docs:
        want.setdefault(d, []).append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = want[r["doc_id"]][0]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for spots in places.values() if whole else ():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in got) == sum(len(x) for v in want.values() for x in v)
    for d, texts in want.items():
        mine = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == d)
        if len(texts) == 1:
            n, at = len(texts[0]), 0
            for k, (piece, start, length) in enumerate(mine):
                assert (piece, start) == (k, at) and (length == 1024 or k == 0)
                at += length
            assert at == n and len(mine) == -(-n // 1024)


def test_given_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, packing.op4_packing(spark, sf_dir).collect())


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (3, "<|endoftext|>", 0), (4, "word " * 5000, 0), (None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long")
    check([r[:2] for r in rows], packing.pack_documents(df).collect())
    assert packing.pack_documents(df.where("doc_id = 99")).count() == 0


WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() or c in "\u200b\ufeff") + "  \n\n\n"


@given(st.text(st.sampled_from("ab1'." + WHITE), max_size=14))
def test_ids_over_all_white_space(text):
    assert bpe.shared().encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_no_step_is_left():
    """After the search no move and no swap with one or two smaller pieces would fill a fuller sequence more."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(8, 32, 120)
    before = [[2 * k, 2 * k + 1] if k % 2 else [2 * k] for k in range(60)] + [[2 * k + 1] for k in range(0, 60, 2)]
    bins = packing.local_search(before, lengths, 64)
    assert len(bins) <= len(before)
    fill = [sum(lengths[i] for i in b) for b in bins]
    for b in range(len(bins)):
        for c in range(len(bins)):
            if c == b or fill[c] == 64 or fill[c] < fill[b]:
                continue
            for i in bins[b]:
                for out in [(), *[(j,) for j in bins[c]], *itertools.combinations(bins[c], 2)]:
                    gain = lengths[i] - sum(lengths[j] for j in out)
                    assert not (0 < gain <= 64 - fill[c] and (out == () or fill[c] > fill[b]))


def test_repeated_rows_fill_groups_evenly(spark, monkeypatch):
    docs = spark.createDataFrame([(7, "the same words")] * 900, "doc_id long, text string")
    cut = packing.written(packing.pieces(docs), "t")
    rows = packing.packed(cut, group=300).collect()
    assert sum(r["length"] for r in rows) == cut.agg({"length": "sum"}).first()[0]
    per = Counter(r["sequence_id"] % 6 for r in rows)
    assert len(per) == 3 and max(per.values()) < 450
