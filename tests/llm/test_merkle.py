import hashlib
import zlib
from collections import defaultdict

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from tilewright.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, i int, seq string"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def encoded(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes):
    """All levels, by the rule: while multiple nodes remain, every 8 consecutive ones become their hash."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    for level in levels[:-1]:
        k = i // 8 * 8
        yield level[k:i], level[i + 1 : k + 8]
        i //= 8


def plain(rows, tamper):
    """rows of (doc_id, text, lang, source, n_chars) by the contract, in plain Python."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        low = text
        if text is not None and doc_id is not None and tamper and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        groups[lang].append((doc_id, digest(encoded(doc_id, source, lang, n, text)), digest(encoded(doc_id, source, lang, n, low))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (doc_id, leaf, low) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            path = [*siblings(trees[g], i), *siblings(top, at)]
            folded = low
            for left, right in path:
                folded = digest("".join([*left, folded, *right]))
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], digest("".join("".join(a + b) for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def got(docs, levels):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return sorted((tuple(r) for r in merkle.manifest(docs, tampered, levels).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, d, e, "x", 1, "y") for a, b, c, d, e in rows], SCHEMA)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_against_plain_trees(spark, levels):
    rows = [(k, f"Text {k} ÄÖ", f"l{k % 7}" if k % 5 else "hot", f"s{k % 3}", k) for k in range(700)]
    rows += [(1000, "lone", "one", "s", 4), (1001, "A", None, None, None), (None, "NULL id", "hot", "s", 7), (None, "NULL id", "hot", "s", 7), (None, None, None, None, None)]
    rows += [(5, "other text of 5", "hot", "s", 1), (9, "", "é", "", 0), (12, "x" * 300_000, "ü", "s", 300_000)] + [(3000, "Same Row", "copies", "s", 8)] * 90
    assert got(frame(spark, rows), levels) == plain(rows, True)


def test_sizes_about_a_run_and_a_block(spark):
    for n in (1, 2, 8, 9, 64, 65):
        rows = [(k, f"T{k}", None, "s", k) for k in range(n)]
        assert got(frame(spark, rows), 1) == plain(rows, True), n


def test_many_groups(spark):
    rows = [(k, f"T{k}", f"g{k}", "s", k) for k in range(150)]
    assert got(frame(spark, rows), 1) == plain(rows, True)


def test_empty_and_untouched(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0
    rows = [(k, "UP", "a", "s", 2) for k in range(20)]
    whole = merkle.manifest(frame(spark, rows)).collect()
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in whole)


def test_same_as_sql(spark, sf_dir):
    out = merkle.op13_merkle(spark, sf_dir)
    assert_same(out, merkle.ORACLE_SQL, sf_dir)
    assert 0 < out.where("not verified").count() < out.count()
