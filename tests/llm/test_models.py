import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm import language_id as li
from tilewright.llm import toxicity as tx


def test_gradient_is_that_of_the_loss():
    net = li.Network(["a", "b"], 2, 4, 3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 101, (6, 4)).astype(np.uint8), np.array([0, 1, 0, 1])
    _, grads = net.gradient(x, y)
    for p, g in zip(net.params(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[i]
        p[i] = old + 1e-2
        above = net.gradient(x, y)[0]
        p[i] = old - 1e-2
        below = net.gradient(x, y)[0]
        p[i] = old
        assert abs((above - below) / 2e-2 - g[i]) < 1e-3 + 0.02 * abs(g[i])


def test_whole_texts_count():
    """A document's probabilities are the mean over all its letter positions, whatever is beside it in the batch."""
    net = li.Network(["a", "b"], 3)
    texts = [b"abc " * 100, b"x", b"hello world" * 30]
    together = li.document_probabilities(net, texts)
    alone = np.concatenate([li.document_probabilities(net, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and np.allclose(together.sum(1), 1, atol=1e-5)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.op1_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() > 150
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_odd_documents(spark):
    rows = [(1, "the cat and the dog " * 20, "en", 0.5), (2, "le chat et la souris " * 20, "fr", 0.5), (3, None, "en", 0.5), (4, "123 !", None, 0.5), (None, "", "fr", 0.5), (1, "le chat", "fr", 0.5), (5, "the dog " * 20000, None, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    net = li.fit(df, F.lit(False))
    got = [(r["doc_id"], r["lang_pred"]) for r in li.identified(df, net).collect()]
    assert sorted((x for x in got if x[1] == "und"), key=repr) == sorted([(3, "und"), (4, "und"), (None, "und")], key=repr)
    assert (5, "en") in got and len(got) == 7
    assert {r["lang_pred"] for r in li.identified(df, li.fit(df.where("lang = 'xx'"), F.lit(False))).collect()} == {"und"}
    assert li.identified(df.limit(0), net).count() == 0


def toxic_corpus():
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        words = rng.choices(plain, k=30)
        bad = k % 5 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["vexidor", "grumblat", "shoddewick"])
        rows.append((k, " ".join(words), 0.0))
        labels.append((k, int(bad)))
    return rows, labels, plain


def test_toxicity(spark):
    rows, labels, plain = toxic_corpus()
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(docs, labs, F.col("doc_id") % 4 == 1)
    got = {r["doc_id"]: r["_s"] for r in tx.scored(docs, model, "_s").collect()}
    held = [(k, y) for k, y in labels if k % 4 == 1]
    assert all((got[k] >= 0.5) == bool(y) for k, y in held)
    for disguised in ("v3x1dor", "g r u m b l a t", "shodd3w1ck", "vexiiiidor", "v.e.x.i.d.o.r", "VEXID0R!!", "$hoddewick"):
        assert model.score(f"{plain[0]} {disguised} {plain[1]}") >= 0.5, disguised
    assert model.score(None) == model.score("") < 0.5


def test_long_tokens_and_short_spaced_words():
    costs = tx.trigram_costs(np.ones(tx.SYMBOLS**3), {"vexidor": 50, "zug": 50, "hello": 50, "plain": 50})
    model = tx.Model(["vexidor", "zug"], np.full(4, 3.0), 0.0, costs)
    long = [f"ve{'x' * 70}idor", "v" * 5000 + "exidor", "/".join(["hello"] * 20 + ["v3x1dor"] + ["plain"] * 20), *(j.join(["hello", "plain"] * 40 + ["v3x1d0r"] + ["hello"] * 40) for j in "_-.")]
    for text in [*long, "z u g", "hello z.u.g, plain", "z-u-g", "z u 9"]:
        assert model.score(text) >= 0.5, text
    for text in ["hello_" * 5000 + "plain", "a b c", "z u", "h e l l o", "x" * 100_000]:
        assert model.score(text) < 0.5, text


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 0), (None, None, 0), (2, "x" * 100000 + " a" * 50000, 0)], "doc_id long, text string, toxic int")
    labs = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = tx.fit(docs, labs, F.lit(False))
    assert {r["s"] for r in tx.scored(docs, model, "s").collect()} == {0.0}
    assert tx.scored(docs.limit(0), model).count() == 0


def test_every_path_of_a_lattice_is_weighed():
    costs = tx.trigram_costs(np.ones(tx.SYMBOLS**3), {"idiot": 50})
    assert tx.restore("1d10t", costs) == "idiot"
    assert tx.restore("plain", costs) == "plain"
    assert [w for ways in tx.lattice("aaab") for w, _ in ways] == ["a", "aa", "aaa", "b"]


def test_query_on_given_labels(spark):
    d = "/root/testdata/sf0.01"
    got = tx.op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    toxic, flagged = [r for r in held if r["toxic"]], [r for r in held if r["predicted"]]
    both = sum(r["predicted"] for r in toxic)
    assert len(toxic) >= 5 and both >= 0.8 * len(toxic) and both >= 0.8 * len(flagged)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)


@given(st.text("aeiobst013$@*-. ", min_size=1, max_size=9))
def test_viterbi_finds_the_cheapest_of_all_paths(token):
    costs = tx.trigram_costs(np.arange(tx.SYMBOLS**3) % 7 + 1.0, {"beast": 9, "toast": 4, "obtiase": 2})
    got = tx.restore(token, costs)
    readings = {}
    for ways in itertools.product(*tx.lattice(token)):
        text, cost, a, b = "".join(w for w, _ in ways) + " ", sum(c for _, c in ways), 0, 0
        for c in map(tx.symbol, text):
            cost += costs[a, b, c]
            a, b = b, c
        readings[text.strip()] = min(cost, readings.get(text.strip(), math.inf))
    assert readings[got] == pytest.approx(min(readings.values()))


def test_long_spaced_runs_are_decoded_whole():
    costs = tx.trigram_costs(np.ones(tx.SYMBOLS**3), {"vexidor": 50, "hello": 50, "plain": 50})
    model = tx.Model(["vexidor"], np.full(2, 3.0), 0.0, costs)
    for at in range(0, 130, 13):  # wherever the word lies in the run
        run = " ".join("hello" * at + "vexidor" + "plain" * 40)
        assert model.counts(run) == {0: 1}, at


@given(st.lists(st.sampled_from(["vexidor", "hello", "plain", "garden"]), min_size=1, max_size=12), st.sampled_from(" .-_*"))
def test_spaced_words_of_a_vocabulary_come_back(words, between):
    costs = tx.trigram_costs(np.ones(tx.SYMBOLS**3), {w: 50 for w in ("vexidor", "hello", "plain", "garden")})
    assert tx.restore(between.join("".join(words)), costs).split() == words


def test_repeated_and_absent_ids_are_not_learned(spark):
    rows, labels, _ = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labs = spark.createDataFrame(labels, "doc_id long, toxic int")
    noise = spark.createDataFrame([(5000 + k % 2, "vexidor grumblat shoddewick", 0.0) for k in range(300)], docs.schema)
    odd = spark.createDataFrame([(5000, 0), (5001, 0), *[(9000 + k, 0) for k in range(500)], (1, 1), (1, 0)], labs.schema)
    plain = tx.fit(docs, labs.where("doc_id <> 1"), F.lit(False), 300)
    assert len(plain.marks) >= 3
    got = tx.fit(docs.union(noise), labs.where("doc_id <> 1").union(odd), F.lit(False), 300)
    assert got.marks == plain.marks and got.weights == plain.weights and got.bias == plain.bias
    assert tx.scored(docs.union(noise), got).where("doc_id >= 5000 and score > 0.5").count() == 300
