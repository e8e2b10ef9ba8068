import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import mixture_packing as mp

SCHEMA = "doc_id long, text string, source string, n long, ids int, _p string"


def walked(lengths, queue, share, owed, packet, quantum):
    """Deficit round-robin, round after round."""
    queues = [[] for _ in share]
    for d, (n, q) in enumerate(zip(lengths, queue, strict=True)):
        queues[q] += [(d, a, min(packet, n - a)) for a in range(0, n, packet)]
    deficit, out = list(map(Fraction, owed)), []
    while any(queues):
        if not any(queues[q] and share[q] for q in range(len(share))):  # what has no share comes last
            for rest in queues:
                out += rest
            break
        for q in range(len(share)):
            deficit[q] += Fraction(share[q]) * quantum
            while queues[q] and share[q] and deficit[q] >= queues[q][0][2]:
                out.append(queues[q].pop(0))
                deficit[q] -= out[-1][2]
    return out


@given(st.lists(st.tuples(st.integers(1, 70), st.integers(0, 3)), min_size=1, max_size=40), st.permutations([0.5, 0.25, 0.25, 0.0]), st.lists(st.integers(-60, 60), min_size=4, max_size=4), st.integers(3, 20))
def test_the_order_is_that_of_deficit_round_robin(docs, share, owed, packet):
    lengths, queue = (np.array(x, np.int64) for x in zip(*docs, strict=True))
    used = sorted(set(queue.tolist()))
    queue, share, owed = np.searchsorted(used, queue), [share[q] for q in used], [owed[q] for q in used]
    got = list(zip(*(x.tolist() for x in mp.served(lengths, queue, np.array(share), np.array(owed, float), packet, 16)), strict=True))
    assert got == walked(lengths.tolist(), queue.tolist(), share, owed, packet, 16)


@given(st.integers(0, 9000))
def test_windows_need_no_padding(total):
    sizes = np.diff(mp.windows(total)).tolist()
    assert sum(sizes) == total and all(s == mp.LENGTH or s & (s - 1) == 0 for s in sizes)
    assert sum(s < mp.LENGTH for s in sizes) <= 11


def check(rows, docs, packet=mp.PACKET):
    """Each id in one piece, windows gapless and of a length without padding."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = False
    want = Counter()
    ids_of = defaultdict(list)
    for doc_id, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        ids_of[doc_id].append(np.array(ids, "<u4"))
        want[doc_id] += len(ids)
    got, in_window = Counter(), defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["length"]
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids_of[r["doc_id"]])
        in_window[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in in_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= mp.LENGTH and at & (at - 1) == 0
    once = [r for r in rows if len(ids_of[r["doc_id"]]) == 1]
    starts = defaultdict(list)
    for r in once:
        starts[r["doc_id"]].append((r["start"], r["length"]))
    for pieces in starts.values():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mp.op11_mixture_packing(spark, sf_dir).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_shares_hold_in_every_window_and_deficits_cross_partitions(spark):
    rows = [(k, "word " * (20 + k * 7 % 300), f"s{k % 3}" if k % 2 else "hot", 0, 0, "") for k in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    pieces = mp.pack_documents(docs, group=150_000).withColumn("part", F.shiftright("sequence_id", 32))
    source = {r[0]: r[2] for r in rows}
    held = pieces.collect()
    total = sum(r["length"] for r in held)
    share = Counter()
    for r in held:
        share[source[r["doc_id"]]] += r["length"] / total
    served, t, tested = Counter(), 0, 0
    parts = sorted({r["part"] for r in held})
    assert len(parts) > 3
    for p in parts:
        mine = sorted((r for r in held if r["part"] == p), key=lambda r: (r["sequence_id"], r["offset"]))
        own = Counter()
        for r in mine:
            own[source[r["doc_id"]]] += r["length"]
        # from when all have paid or been paid what they brought from the partitions before, to when the first queue is dry
        owed, begin = {s: share[s] * t - served[s] for s in share}, t
        paid = max(abs(owed[s]) / share[s] for s in share) + mp.ROUND
        dry = min((own[s] - owed[s]) / share[s] for s in share) - mp.ROUND
        for k, r in enumerate(mine):
            served[source[r["doc_id"]]] += r["length"]
            t += r["length"]
            if (k + 1 == len(mine) or mine[k + 1]["sequence_id"] != r["sequence_id"]) and paid < t - begin < dry:
                tested += 1
                assert all(abs(served[s] - share[s] * t) < mp.PACKET + mp.ROUND for s in share), (p, k)
    assert tested > 100


def test_odd_rows_and_given_shares(spark):
    rows = [(1, None, "a", 0, 0, ""), (2, "", None, 0, 0, ""), (3, "long " * 40_000, "a", 0, 0, ""), (4, "x <|endoftext|> y", "b", 0, 0, ""), (5, "tie", "b", 0, 0, ""), (5, "tie", "b", 0, 0, ""), (None, "no id", "c", 0, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    shares = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 0.0)], "source string, weight double")
    for given_shares in (None, shares):
        for group in (10**9, 500):
            out = mp.pack_documents(docs, given_shares, group=group).collect()
            check(out, [r[:2] for r in rows])
    assert mp.pack_documents(docs.limit(0)).count() == 0


def test_a_given_mixture_is_met_while_sources_last(spark):
    rows = [(k, "word " * 99, "ab"[k % 2], 0, 0, "") for k in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mp.pack_documents(docs, spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double"), group=10**9)
    per = out.where("sequence_id < 60").groupBy("sequence_id").agg(F.sum(F.when(F.col("doc_id") % 2 == 0, F.col("length")).otherwise(0)).alias("a"), F.sum("length").alias("n")).collect()
    assert len(per) == 60 and all(abs(r["a"] - 0.75 * r["n"]) <= 2 * mp.PACKET for r in per)
