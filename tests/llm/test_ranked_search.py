import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import duck_rows, rounded

from tilewright.llm import ranked_search as rs

SCHEMA = "doc_id long, text string, block long, q int, terms string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    """Every document scored for every item."""
    held = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c, n in held:
            m = 100 - 75 + 75 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item_id, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def corpus(n, seed=3):
    r = random.Random(seed)
    topics = [[f"w{t}x{k}" for k in range(30)] for t in range(8)] + [[f"common{k}" for k in range(40)]]
    return [(k, " ".join(r.choice(topics[r.choice([k % 8, 8])]) for _ in range(r.randint(1, 120)))) for k in range(n)]


ODD = [
    (None, "w0x1 w0x2 null id"), (9001, None), (9002, ""), (9003, " .,;\n"), (9004, "Straße ÄÖ äö İ Zürich zürich"), (9005, "A-B_c9 a b"), (9006, "w1x1 " * 50_000), (9007, "tie tie"), (9008, "tie tie"), (9008, "tie tie"), (9009, "tie\x00tie x"),
    *[(9100 + k, "copied passage of words w0x3") for k in range(40)],
]
ITEMS = [(1, "w0x1 w0x2 w0x3 common1"), (2, "copied passage of words w0x3"), (3, None), (4, " - "), (5, "TIE"), (5, "TIE"), (6, "straße zürich İ ÄÖ"), (None, "w3x3 w3x3 w4x1"), (7, "nowhere"), (8, "w1x1 a b c9 " * 30)]


def answers(spark, docs, items, **kw):
    frame = spark.createDataFrame([(d, t, 0, 0, "") for d, t in docs], SCHEMA)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    out = rs.search(rs.index(frame, **kw), asked, queries=4)
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"postings": 300, "shard": 4}, {"postings": 3000, "shard": 16, "passes": 3}])
def test_against_scores_of_all_documents(spark, kw):
    docs = corpus(600) + ODD
    assert answers(spark, docs, ITEMS, **kw) == plain(docs, ITEMS)


def test_empty_tables(spark):
    assert answers(spark, [], ITEMS) == [] and answers(spark, ODD, []) == []
    assert answers(spark, [(1, None), (2, "")], ITEMS) == []


def test_bisection_brings_alike_documents_together():
    r = np.random.default_rng(1)
    kind = r.permutation(np.repeat(np.arange(8), 32))
    rows = [(d, k * 20 + t) for d, k in enumerate(kind) for t in r.choice(20, 8, replace=False)] + [(d, 160 + t) for d in range(256) for t in r.choice(40, 4, replace=False)]
    doc, term = np.array(rows).T
    order, edges = rs.bisected(doc, term, 256, leaf=32, passes=20)
    assert sorted(order.tolist()) == list(range(256)) and edges[0] == 0 and edges[-1] == 256 and np.diff(edges).max() <= 32

    def bits(order):
        place = np.empty(256)
        place[order] = np.arange(256)
        return sum(np.log2(np.diff(np.sort(place[doc[term == t]]), prepend=-1)).sum() for t in range(160))

    assert bits(order) < 0.85 * bits(np.arange(256))


def test_shards_below_the_bound_are_not_visited():
    docs = corpus(1000, 5)
    docs[500] = (500, "needle one needle two needle three")
    docs += [(2000 + k, "needle one needle two") for k in range(12)]
    rows = []
    for d, t in docs:
        c = Counter(rs.terms_of(t))
        rows.append((d, sum(c.values()), b" ".join(c), np.array(list(c.values()), "<u4").tobytes()))
    block = rs.block_of(rows, len(rows), sum(r[1] for r in rows), shard=16)
    q = rs.Queries(["needle one needle two needle three common1"])
    df = np.array([sum(t in c.split() for _, _, c, _ in rows) for t in q.terms])
    q.weigh(df, len(rows))
    best = {}
    visited = rs.search_block(block, q, np.array([0]), best)
    assert visited < block["shards"] / 2
    assert max(best[0])[1] == 500


def test_same_as_sql(spark, sf_dir):
    names, want = duck_rows(rs.ORACLE_SQL, sf_dir, ("documents", "benchmark"))
    got = [tuple(r) for r in rs.op12_ranked_search(spark, sf_dir).select(*names).collect()]
    assert rounded(got) == rounded(want) and len(got) > 50


def block_rows(docs):
    rows = []
    for d, t in docs:
        c = Counter(rs.terms_of(t))
        rows.append((d, sum(c.values()), b" ".join(c), np.array(list(c.values()), "<u4").tobytes()))
    return rows


def test_a_block_is_narrow():
    """Rows of the index lie in an executor's memory several times over: with 4 bytes a number they took it all."""
    rows = block_rows(corpus(600))
    block = rs.block_of(rows, len(rows), sum(r[1] for r in rows))
    postings = sum(len(r[3]) // 4 for r in rows)
    assert sum(len(v) for v in block.values() if isinstance(v, bytes)) < 4 * postings


@pytest.mark.parametrize("most", [0, 1, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**62])
def test_packed_numbers_are_read_back(most):
    for numbers in ([most], [], [0, most, 1, most // 2] * 50):
        assert rs.unpacked(rs.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_wide_numbers_in_a_block(spark):
    docs = [*corpus(400), (7000, "w1x1 " * 70_000 + "w2x2"), (7001, "w1x1 w2x2 " * 300), *[(8000 + k, f"only{k}") for k in range(300)]]
    items = [(1, "w1x1 w2x2"), (2, "only7 only299 only0"), (3, "common1 w1x1 only3")]
    assert answers(spark, docs, items, postings=10**6, shard=1, passes=2) == plain(docs, items)  # over 255 shards, over 65,535 of a term


def test_stored_bounds_are_never_lower():
    rows = block_rows(corpus(300))
    length = sum(r[1] for r in rows)
    block = rs.block_of(rows, len(rows), length, shard=8)
    at = {t: k for k, t in enumerate(rs.zlib.decompress(block["terms"]).split(b" "))}
    peak = rs.STEP * rs.unpacked(block["peak"])
    most = np.zeros(len(at), np.int64)
    for _, n, words, tf in rows:
        for w, x in zip(words.split(b" "), np.frombuffer(tf, "<u4").tolist(), strict=True):
            most[at[w]] = max(most[at[w]], 10**9 * x // (1000 * x + 8 * (25 + 75 * n * len(rows) // length)))
    assert (peak >= most).all() and (peak < most + rs.STEP).all()
