"""Stages of the pipeline, each against plain Python over its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_mixing import reshared
from test_packing import check as check_packing

from tilewright.llm import toxicity
from tilewright.llm.common import written

ODD = "doc_id long, text string, lang string, source string, n_chars long, _score double, `_row` string, hash map<string,int>"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = [x.encode().lower() for x in words(text)]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def plain_dedup(rows):
    """Texts (null as empty) and the largest id of each."""
    last = {}
    for r in rows:
        t = r["text"] or ""
        last[t] = max(last.get(t, r["doc_id"]), r["doc_id"], key=lambda x: (x is not None, x or 0))
    return Counter((k, t) for t, k in last.items())


def plain_classes(rows):
    """Of each class of linked sets its smallest id; how many rows without words."""
    rows = list({(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None or words(r["text"])})
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    of = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            of[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in of[x] if j < i).items():
            if 100 * both >= 80 * len(s | sets[j]):
                up[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            key = (d is None, d or 0)
            first[find(i)] = min(first.get(find(i), key), key)
    return Counter(None if last else d for last, d in first.values()), sum(not s for s in sets)


def check_mix(before, after):
    size, taken, most = Counter(), Counter(), Counter()
    for r in before:
        size[r["source"]] += len(words(r["text"]))
        most[r["source"]] = max(most[r["source"]], len(words(r["text"])))
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
    for s, want in reshared({s: n for s, n in size.items()}).items():
        assert abs(taken[s] - want) <= most[s]
    rows = Counter((r["doc_id"], r["text"], r["source"]) for r in before)
    for key, n in Counter((r["doc_id"], r["text"], r["source"]) for r in after).items():
        assert n <= 3 * rows[key]


def check_stage(name, before, after, model):
    if name == "toxicity":
        assert Counter((r["doc_id"], r["text"]) for r in after) == Counter((r["doc_id"], r["text"]) for r in before if model.score(r["text"]) < 0.5)
    elif name == "exact_dedup":
        assert Counter((r["doc_id"], r["text"] or "") for r in after) == plain_dedup(before)
    elif name == "ngram_join":
        ids, bare = plain_classes(before)
        kept = [r for r in after if words(r["text"])]
        assert Counter(r["doc_id"] for r in kept) == ids
        assert {(r["doc_id"], r["text"]) for r in after} <= {(r["doc_id"], r["text"]) for r in before}
        assert sum(r["doc_id"] is not None for r in after if not words(r["text"])) == bare
    elif name == "mixing":
        check_mix(before, after)
    else:
        once = Counter(r["doc_id"] for r in before)
        assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == once
        check_packing([(r["doc_id"], r["text"]) for r in before if once[r["doc_id"]] == 1], [r for r in after if once[r["doc_id"]] == 1], whole=False)


def hold(spark, docs, sf_dir):
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(False))
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        check_stage(name, docs.collect(), out.collect(), model)
        docs = out


def test_stages(spark, sf_dir):
    hold(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    text, near = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(61))
    texts = [(3, text), (5, near), (5, "another text of the same id"), (None, text + " x y"), (None, "of no id"), (None, "of no id"), (7, None), (7, ""), (8, " \t"), (None, None), (9, "long " * 30000), (3, text)]
    rows = [(d, t, "en", [None, "a", "b"][k % 3], k, 0.9, "r", {"k": k} if k % 2 else None) for k, (d, t) in enumerate(texts)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, ODD).repartition(3).write.parquet(path)
    hold(spark, spark.read.parquet(path), sf_dir)
    for _, stage in cp.STAGES:
        assert stage(spark, spark.read.parquet(path).limit(0), sf_dir).count() == 0


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = lambda df: Counter(tuple(r) for r in df.select(*columns).collect())
    assert whole(cp.run(spark, sf_dir)) == whole(docs)
