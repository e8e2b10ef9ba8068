import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from tilewright.llm import components as cc
from tilewright.llm import ngram_join as nj

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("sid", T.LongType())])


def brute(rows):
    """Per row: set size and the smallest id it reaches, by comparing all pairs of word sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in nj.classes(df).collect()), key=repr)


def families(seed, groups, copies, words, edits):
    rng = random.Random(seed)
    rows = []
    passage = [f"p{k}" for k in range(30)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(words)]
        if g % 2:
            base[5:5] = passage
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    return rows


def test_families_at_the_threshold(spark):
    rows = families(1, 6, 25, 120, 6)
    assert got(spark, rows) == brute(rows)


def test_lists_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(nj, "LIST_BLOCK", 4)
    monkeypatch.setattr(nj, "BLOCK", 3)
    rows = families(2, 3, 40, 60, 4)
    assert got(spark, rows) == brute(rows)


def test_without_a_table_of_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(nj, "FREQUENT", 0)
    monkeypatch.setattr(nj, "BROADCAST", 0)
    rows = families(3, 6, 10, 50, 3)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a"), (5, "A"), (5, "a b c d e f"), (None, "a b c d e f"), (6, "a b c d e f"), (6, "a b c d e f"), (7, "one two\x0bthree\x1cfour five six"), (8, "w " * 30000), (None, "")]
    assert got(spark, rows) == brute(rows)
    assert nj.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each(spark):
    text = " ".join(map(str, range(100)))
    rows = [(3, text, 0), (2, text + " x", 0), (9, "q", 0), (4, None, 0), (None, "a", 0), (2, text + " x", 0)]
    out = nj.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "sid"]
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == [2, 4, 9, None]


def test_sizes_of_another_percent(spark):
    """At 60 percent, sets of 60 and of 100 shingles link, though no other set lies between them in size."""
    words = [[f"{c}{k}" for k in range(104)] for c in "abc"]
    rows = [(10 * i + k, " ".join(w[:m])) for i, w in enumerate(words) for k, m in enumerate((104, (64, 63, 84)[i]))]
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    assert [len(sets[d]) for d in (0, 1, 11, 21)] == [100, 60, 59, 80]
    want = sorted((d, min(e for e in sets if 100 * len(sets[d] & sets[e]) >= 60 * len(sets[d] | sets[e]))) for d in sets)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA)
    assert sorted((r["doc_id"], r["component_id"]) for r in nj.classes(df, percent=60).collect()) == want == [(0, 0), (1, 0), (10, 10), (11, 11), (20, 20), (21, 20)]


def test_one_of_each_goes_by_class(spark):
    text, other, third = (" ".join(f"{c}{k}" for k in range(100)) for c in "abc")
    near = [(3, text), (5, text + " x"), (None, text + " y")]
    rows = [*near, (5, "clean words of one text only"), (5, None), (5, ""), (None, other), (None, other + " x"), (None, other), (7, third), (7, third + " x"), (7, third), (None, None), (None, " \x0b"), (5, None)]
    for k in range(2):
        df = spark.createDataFrame([(d, t, 0) for d, t in (rows, rows[::-1])[k]], SCHEMA).repartition(3 + k)
        out = sorted(((r["doc_id"], r["text"]) for r in nj.one_of_each(df).collect()), key=repr)
        sure = [(3, text), (5, "clean words of one text only"), (5, None), (5, ""), (None, None), (None, " \x0b")]
        assert all(out.count(r) == 1 for r in sure)
        open_ = [r for r in out if r not in sure]
        assert len(open_) == 2
        assert {(d, t.removesuffix(" x")) for d, t in open_} == {(None, other), (7, third)}
        assert k == 0 or out == before
        before = out


@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=40), min_size=1, max_size=12))
def test_divide_skip(sets):
    sets = [np.unique(np.array(s, np.uint64)) for s in sets]
    want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(sets[0], s)) >= 80 * len(np.union1d(sets[0], s))]
    assert sorted(nj.divide_skip(sets[0], sets)) == want


@given(st.lists(st.sets(st.integers(0, 300), min_size=1, max_size=200), min_size=2, max_size=8))
def test_parities_never_rule_out_a_link(sets):
    sets = [nj._mix(np.array(sorted(s), np.uint64)) for s in sets]
    sets += [np.append(s, np.uint64(7)) for s in sets]
    pairs = {tuple(sorted(p[:2])) for p in nj.may_link(np.array([len(s) for s in sets]), [nj.parity_bits(s) for s in sets])}
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                assert (j, i) in pairs


@given(st.lists(st.tuples(st.sets(st.integers(0, 60), min_size=1, max_size=60), st.integers(0, 2), st.integers(0, 1)), min_size=2, max_size=14))
def test_pairs_of_different_roots(members):
    sets = [nj._mix(np.array(sorted(s), np.uint64)) for s, _, _ in members]
    root, own = np.array([r for _, r, _ in members]), np.array([o for _, _, o in members])
    n, bits = np.array([len(s) for s in sets]), [nj.parity_bits(s) for s in sets]
    pairs = [p[:2] for p in nj.may_link(n, bits, root=root, own=own)]
    assert len(pairs) == len({tuple(sorted(p)) for p in pairs})
    found = {tuple(sorted(p)) for p in pairs}
    assert all(root[i] != root[j] and own[i] != own[j] for i, j in found)
    for i in range(len(sets)):
        for j in range(i):
            link = 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
            if link and root[i] != root[j] and own[i] != own[j]:
                assert (j, i) in found


@pytest.mark.parametrize("per_task", [7, 1000])
def test_components(spark, per_task):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(500, 500)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    want = sorted((x, find(x)) for x in up)
    df = cc.components(spark.createDataFrame(edges, "a long, b long"), per_task)
    assert sorted(tuple(r) for r in df.collect()) == want


def test_lists_of_many_classes_and_sizes(spark, monkeypatch):
    """Blocks of two members: passive and active ones over several bands, and sets told of in several rows."""
    monkeypatch.setattr(nj, "LIST_BLOCK", 2)
    monkeypatch.setattr(nj, "ROLES", 2)
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(90)]
    rows = []
    for k in range(90):
        own = [f"o{rng.randrange(40)}x{j}" for j in range(rng.randrange(45))]
        rows.append((k, " ".join(passage[: rng.randrange(60, 90)] + own)))
    rows += [(k + 100, t) for k, t in families(11, 2, 12, 60, 3)]
    assert got(spark, rows) == brute(rows)


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c", 1, {"k": 1}), (2, "a b c", 2, None), (1, None, 3, None)], "doc_id long, text string, _row int, _row_ map<string,int>")
    out = nj.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r["_row"] for r in out.collect()) == [1, 3]
