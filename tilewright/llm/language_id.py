"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of WINDOW bytes, forwards and backwards with gated
recurrent units, and labels every position from both states. A document's probabilities are the
mean over its positions that belong to letters. It is trained in numpy by backpropagation through
time on SAMPLES windows of each of at most PER_LANGUAGE documents of each of the LANGUAGES most
frequent languages. Documents are those least by a hash of id and text: a threshold on it, from the
language's count, leaves a few times as many as are wanted, whatever the size of the corpus, and only
these are ranked. Windows are cut from whole texts by the tasks that read them, so the driver gets at
most SAMPLES * WINDOW bytes a document. Weights are a few kilobytes.

Defined results: null texts and texts without a letter are `und` with score 0; where nothing can be
learned (no labelled text with letters) everything is; labels that are null are not learned; rows
that repeat an id are labelled each, and learned once where they repeat its text and label; extra columns are ignored; an empty table gives an empty
result. Bytes 128 and up count as letters, and so do A to Z and a to z.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import crc_mod, slices, table

WINDOW, HIDDEN, EMBED = 64, 8, 12
PER_LANGUAGE, STEPS, BATCH, RATE = 250, 300, 192, 0.02
LANGUAGES, SAMPLES = 1000, 16
#: How many times PER_LANGUAGE documents a threshold is meant to leave.
SPARE = 4
#: Windows that are run at once.
AT_ONCE = 4096

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Gru:
    """One direction. Input weights of all bytes are multiplied out, so a step reads a row of a table."""

    def __init__(self, rng, embed: int, hidden: int):
        scale = 1 / np.sqrt(hidden)
        self.w = rng.normal(0, 1 / np.sqrt(embed), (embed, 3 * hidden)).astype(np.float32)
        self.u = rng.uniform(-scale, scale, (hidden, 3 * hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)
        self.b[:hidden] = 1.0
        self.c = np.zeros(hidden, np.float32)

    def params(self):
        return [self.w, self.u, self.b, self.c]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(table_: np.ndarray, g: Gru, x: np.ndarray, keep: bool):
    """States after each byte of x (steps, windows); with keep also what training needs."""
    steps, n = x.shape
    k = g.u.shape[0]
    h = np.zeros((n, k), np.float32)
    out = np.empty((steps, n, k), np.float32)
    tape = []
    for t in range(steps):
        a, hu = table_[x[t]], h @ g.u
        zr = _sigmoid(a[:, : 2 * k] + hu[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        q = hu[:, 2 * k :] + g.c
        c = np.tanh(a[:, 2 * k :] + r * q)
        new = c + z * (h - c)
        if keep:
            tape.append((h, z, r, q, c))
        h = out[t] = new
    return out, tape


def _back(g: Gru, x, tape, d_out, grads, d_table):
    """Backpropagation through time of one direction."""
    k = g.u.shape[0]
    d_h = np.zeros_like(d_out[0])
    for t in range(len(tape) - 1, -1, -1):
        h, z, r, q, c = tape[t]
        d = d_out[t] + d_h
        d_z = d * (h - c) * z * (1 - z)
        d_c = d * (1 - z) * (1 - c * c)
        d_r = d_c * q * r * (1 - r)
        d_q = d_c * r
        d_hu = np.concatenate([d_z, d_r, d_q], 1)
        d_a = np.concatenate([d_z, d_r, d_c], 1)
        grads[1] += h.T @ d_hu
        grads[3] += d_q.sum(0)
        np.add.at(d_table, x[t], d_a)
        d_h = d * z + d_hu @ g.u.T
    return k


class Network:
    def __init__(self, languages: list[str], seed: int = 1, embed: int = EMBED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, embed)).astype(np.float32)
        self.fore, self.back = Gru(rng, embed, hidden), Gru(rng, embed, hidden)
        self.v = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.vb = np.zeros(len(languages), np.float32)

    def params(self):
        return [self.embed, self.v, self.vb, *self.fore.params(), *self.back.params()]

    def tables(self):
        return [self.embed @ g.w + g.b for g in (self.fore, self.back)]

    def states(self, x: np.ndarray, keep: bool = False, tables=None):
        """x: (steps, windows). States of both directions at each position."""
        tables = tables or self.tables()
        f, tape_f = _run(tables[0], self.fore, x, keep)
        b, tape_b = _run(tables[1], self.back, x[::-1], keep)
        return np.concatenate([f, b[::-1]], 2), tape_f, tape_b

    def positions(self, x: np.ndarray, tables=None) -> np.ndarray:
        """Probabilities (steps, windows, languages)."""
        h, _, _ = self.states(x, tables=tables)
        logit = h.reshape(-1, h.shape[2]) @ self.v + self.vb
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        return logit.reshape(*x.shape, -1)

    def gradient(self, x: np.ndarray, y: np.ndarray):
        """Mean cross entropy over letter positions, and its gradient in the order of params()."""
        h, tape_f, tape_b = self.states(x, True)
        logit = h @ self.v + self.vb
        logit -= logit.max(2, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(2, keepdims=True)
        weight = LETTER[x].astype(np.float32)
        weight /= max(1.0, float(weight.sum()))
        steps, n = x.shape
        own = p[:, np.arange(n), y]
        loss = float(-(np.log(own + 1e-9) * weight).sum())
        d = p * weight[:, :, None]
        d[:, np.arange(n), y] -= weight
        flat_d, flat_h = d.reshape(-1, d.shape[2]), h.reshape(-1, h.shape[2])
        d_v, d_vb, d_h = flat_h.T @ flat_d, flat_d.sum(0), d @ self.v.T
        k = self.fore.u.shape[0]
        out, d_embed = [], np.zeros_like(self.embed)
        for g, xs, tape, d_o in ((self.fore, x, tape_f, d_h[:, :, :k]), (self.back, x[::-1], tape_b, d_h[::-1, :, k:])):
            grads = [np.zeros_like(a) for a in g.params()]
            d_table = np.zeros((256, 3 * k), np.float32)
            _back(g, xs, tape, d_o, grads, d_table)
            grads[0] = self.embed.T @ d_table
            grads[2] = d_table.sum(0)
            d_embed += d_table @ g.w.T
            out += grads
        return loss, [d_embed, d_v, d_vb, *out]


def windows_of(text: str | None, seed: int, samples: int = SAMPLES) -> list[bytes]:
    """Windows of a whole text at random places, those without a letter left out; the text itself if it is short."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= WINDOW:
        starts = [0]
    else:
        starts = np.random.default_rng(seed & 0xFFFFFFFF).integers(0, len(data) - WINDOW + 1, samples).tolist()
    return [data[a : a + WINDOW].tobytes() for a in starts if LETTER[data[a : a + WINDOW]].any()]


def train(texts: list[list[bytes]], languages: list[str], seed: int = 1, steps: int = STEPS) -> Network | None:
    """Adam on random windows of random documents, each language as often as any other."""
    names = sorted(set(languages))
    of = {n: [[np.frombuffer(w, np.uint8) for w in t] for t, y in zip(texts, languages, strict=True) if y == n and t] for n in names}
    names = [n for n in names if of[n]]
    if not names:
        return None
    net, rng = Network(names, seed), np.random.default_rng(seed)
    params = net.params()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = (np.arange(BATCH) + (step - 1) * BATCH) % len(names)
        x = np.full((WINDOW, BATCH), 32, np.uint8)
        for k, c in enumerate(y):
            t = of[names[c]][rng.integers(len(of[names[c]]))]
            w = t[rng.integers(len(t))]
            x[: len(w), k] = w
        _, grads = net.gradient(x, y)
        rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            g = np.clip(g, -1, 1)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over each text's letter positions; zeros where there are none."""
    lengths = np.array([len(t) for t in texts])
    windows = -(-lengths // WINDOW)
    starts = np.concatenate([[0], np.cumsum(windows)])
    flat = np.full(int(starts[-1]) * WINDOW, 32, np.uint8)
    for t, s in zip(texts, starts, strict=False):
        flat[s * WINDOW : s * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
    flat = flat.reshape(-1, WINDOW)
    sums, counts, tables = np.zeros((len(flat), len(net.languages))), np.zeros(len(flat)), net.tables()
    for a in range(0, len(flat), AT_ONCE):
        x = np.ascontiguousarray(flat[a : a + AT_ONCE].T)
        p, w = net.positions(x, tables), LETTER[x].astype(np.float32)
        sums[a : a + AT_ONCE] = np.einsum("tnk,tn->nk", p, w)
        counts[a : a + AT_ONCE] = w.sum(0)
    owner = np.repeat(np.arange(len(texts)), windows)
    out, n = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    np.add.at(out, owner, sums)
    np.add.at(n, owner, counts)
    return out / np.maximum(n, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def sample(docs: DataFrame, held_out, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most per_language labelled documents of each language: lang, windows."""
    rows = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    # a table of at most LANGUAGES rows
    share = counts.select("lang", (F.lit(float(SPARE * per_language)) / F.col("count")).alias("_share"))
    rows = rows.select("lang", "doc_id", "text", F.xxhash64("doc_id", "text").alias("_h")).join(F.broadcast(share), "lang")
    few = rows.where(F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53)) < F.col("_share")).select("lang", "_h", "text")

    def cut(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            windows = [windows_of(t, h) for t, h in zip(batch.column("text").to_pylist(), batch.column("_h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("_h"), pa.array(windows, pa.list_(pa.binary()))], names=["lang", "_h", "windows"])

    # repeated rows leave each task once, so a language's window holds SPARE times what is wanted
    once = few.mapInArrow(cut, "lang string, _h long, windows array<binary>").where(F.size("windows") > 0).groupBy("lang", "_h").agg(F.first("windows").alias("windows"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    return once.withColumn("_k", place).where(F.col("_k") <= per_language).select("lang", "_h", "windows")


def fit(docs: DataFrame, held_out, per_language: int = PER_LANGUAGE) -> Network | None:
    """Train on documents for which held_out (a condition) is false."""
    got = sorted(sample(docs, held_out, per_language).collect(), key=lambda r: (r["lang"], r["_h"]))
    return train([list(map(bytes, r["windows"])) for r in got], [r["lang"] for r in got])


def identified(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs' doc_id with lang_pred and score for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        import pyarrow as pa

        net = shared.value
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            ok = [net is not None and has_letter(t) for t in texts]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if any(ok):
                at = np.flatnonzero(ok)
                p = document_probabilities(net, [texts[i].encode("utf-8", "surrogatepass") for i in at])
                for i, k, s in zip(at, p.argmax(1), p.max(1), strict=True):
                    names[i], scores[i] = net.languages[k], float(min(1.0, max(0.0, s)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    net = fit(docs, held_out)
    return identified(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
