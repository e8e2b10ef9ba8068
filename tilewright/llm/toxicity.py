"""Toxicity: a noisy channel restores disguised words, a model of marks scores the restored text.

Channel. A token with look-alike signs between letters, a run of three or more equal letters or
single letters with separators between them has a lattice: a sign is read as a letter or as a
boundary, a run as one, two or all of its letters, separators drop out. Viterbi decoding under a
character trigram model picks the reading. The model's counts come from all documents (a table of
28^3 sums), mixed with those of the words that the learned marks matched in training texts. Any
other token has one path, which is taken without decoding.

Score. Marks are words and word beginnings of 3 to 8 letters. Fitting picks them greedily: each next
one covers most words of toxic training texts that no other covers, minus a fine for clean texts. A text's
score is a noisy-or: one minus the product, over its marks, of the share of clean training texts
among those with one word, or with several, of the mark. At most TRAIN_DOCS labelled texts are
learned from, in order of a hash of the id. They stay on executors: the driver gets sums by mark, at most
MARKS candidates (those of highest value) and MARK_WORDS of the words they cover, and nothing else.

Defined results: null and empty texts have the score of a text without marks; null labels, labels of
ids that repeat with another label, of ids that are absent and of ids that several documents bear are
not learned; without labels of both kinds every score is 1 if all are toxic, else 0; rows that repeat
an id are scored each; extra columns are kept by scored(); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import crc_mod, scratch, slices, table, written

TRAIN_DOCS, MARKS, MARK_WORDS = 8_000, 5_000, 200_000
#: Labels that may be broadcast while the sample is looked for.
BROADCAST = 1 << 20
#: A mark is worth at least this many words; a clean text with it is a fine of so many.
LEAST, FINE = 8, 3.0
SYMBOLS = 28  # boundary, a to z, other letter
#: Signs and the letters they may stand for.
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
SEPARATORS = " *.-_~'`^,"
SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+(€£*.\-_~'`^,]+[^\W\d_]|[0-9@$!|+(€£]+[^\W\d_]|[^\W\d_][0-9@$!|+(€£]|([^\W\d_])\1\1")
SPACED = re.compile(r"(?<!\S)(?:[^\W_@$!|]|[@$!|])(?:[ .\-_*](?:[^\W_]|[@$!|])){2,}(?![^\s.,;:!?])")
PIECE = re.compile(r"[^\W_]+")
SIGN, DROP, ONCE, TWICE = 1.2, 0.8, 0.3, 0.7


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def _symbols_of_bytes() -> np.ndarray:
    lut = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b).lower()
        lut[b] = 27 if b >= 128 else symbol(c)
    return lut


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all texts, by symbol."""

    def count(batches):
        import pyarrow as pa

        lut, total = _symbols_of_bytes(), np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches, "text"):
            joined = "  ".join(t for t in batch.column("text").to_pylist() if t)
            s = lut[np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)]
            if len(s) > 2:
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


def trigram_costs(counts: np.ndarray, words: Counter, share: float = 0.5) -> np.ndarray:
    """-ln p(c | a, b) of the corpus, mixed with that of the given words."""

    def p(grams: np.ndarray) -> np.ndarray:
        grams = grams.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        one = grams.sum((0, 1)) + 1.0
        two = grams.sum(0) + 2.0 * one / one.sum()
        two /= two.sum(1, keepdims=True)
        three = grams + 2.0 * two[None]
        return three / three.sum(2, keepdims=True)

    own = np.zeros(SYMBOLS**3)
    for w, n in words.items():
        s = [0, 0, *map(symbol, w), 0]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            own[(a * SYMBOLS + b) * SYMBOLS + c] += n
    mixed = p(counts) if not words else (1 - share) * p(counts) + share * p(own)
    return -np.log(mixed)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal signs its readings and their costs; an empty reading drops it."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        if c.isalpha():
            ways = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, 1.0)] if n == 2 else [(c, ONCE), (c * 2, TWICE), (c * n, 3.0 + n)]
        else:
            inside = 0 < i and j < len(token)
            ways = [(" ", 3.0 if inside and c not in SEPARATORS else DROP)]
            if c in LOOKALIKE:
                ways += [(x * (1 if n > 2 else n), SIGN + 0.2 * (n > 1)) for x in LOOKALIKE[c]]
                ways += [(x, SIGN + 0.4) for x in LOOKALIKE[c] if n == 2]
            if c == " " or (c in SEPARATORS and inside):
                ways.append(("", DROP))
        out.append(ways)
        i = j
    return out


def restore(token: str, costs: np.ndarray) -> str:
    """The cheapest reading of a token's lattice under the character model (Viterbi).

    A state holds its last reading and a link to those before, so that time is linear in the token's length.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ways in [*lattice(token), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for reading, extra in ways:
                x, y, total = a, b, cost + extra
                for c in reading:
                    s = symbol(c)
                    total += costs[x, y, s]
                    x, y = y, s
                held = after.get((x, y))
                if held is None or total < held[0]:
                    after[x, y] = (total, (path, reading))
        states = after
    least = min(cost for cost, _ in states.values())
    return min(_joined(path) for cost, path in states.values() if cost == least).strip()


def _joined(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, reading = path
        out.append(reading)
    return "".join(reversed(out))


def marks_of(word: str) -> list[str]:
    """The possible marks of a word: its beginnings, each ending in *, and the word."""
    return [word, *(word[:k] + "*" for k in range(3, min(8, len(word)) + 1))]


class Model:
    """Marks with weights, and the restoring channel. Pickles as plain data."""

    def __init__(self, marks: list[str], weights: np.ndarray, bias: float, costs: np.ndarray):
        self.marks = {m: i for i, m in enumerate(marks)}
        self.weights, self.bias, self.costs = weights.tolist(), bias, costs
        self.starts = {m[:3] for m in marks}
        self.cache: dict[str, tuple] = {}

    def hits(self, word: str) -> tuple:
        """(mark, piece) pairs of a token, as written and as restored."""
        pieces = set(PIECE.findall(word))
        if SUSPECT.search(word):
            pieces |= set(PIECE.findall(restore(word, self.costs)))
        return tuple({(self.marks[m], p) for p in pieces if p[:3] in self.starts for m in marks_of(p) if m in self.marks})

    def found(self, text: str) -> set:
        """(mark, piece) pairs of a whole text in lower case."""
        cache, found = self.cache, set()
        if len(cache) > 500_000:
            cache.clear()
        for word in set(text.split()):
            got = cache.get(word)
            if got is None:
                got = self.hits(word)
                if len(word) <= 64:  # longer ones seldom come again
                    cache[word] = got
            if got:
                found.update(got)
        for m in SPACED.finditer(text):
            found |= self.hits_spaced(m.group())
        return found

    def counts(self, text: str | None) -> Counter:
        """How many words of each mark a text has."""
        return Counter(k for k, _ in self.found((text or "").lower()))

    def score(self, text: str | None) -> float:
        total = self.bias
        for k, n in self.counts(text).items():
            total += self.weights[2 * k + (n > 1)]
        return -math.expm1(-total)

    def hits_spaced(self, run: str) -> set:
        """Of single signs with separators between them, decoded in one piece, with and without the separators."""
        pieces = set(PIECE.findall(restore(run, self.costs))) | set(PIECE.findall(restore(re.sub(r"(?<=\S)[ .\-_*](?=\S)", "", run), self.costs)))
        return {(self.marks[m], p) for p in pieces if p[:3] in self.starts for m in marks_of(p) if m in self.marks}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}


def training_texts(docs: DataFrame, labels: DataFrame, held_out, most: int = TRAIN_DOCS) -> DataFrame:
    """At most `most` labelled documents: text, toxic. Only ids travel until these are known."""
    once = labels.where("doc_id is not null and toxic is not null").where(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("_least"))
    once = written(once.where("toxic = _least").select("doc_id", (F.col("toxic") > 0).alias("toxic"), F.xxhash64("doc_id").alias("_h")), "labels")
    n, share = once.count(), 4.0
    while True:  # labels below a threshold, more where documents of too few are there
        p = min(1.0, share * most / max(1, n))
        some = once.where(F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53)) < p)
        some = F.broadcast(some) if p * n <= BROADCAST else some
        there = docs.where(F.col("text").isNotNull()).select("doc_id").join(some, "doc_id").groupBy("doc_id", "toxic", "_h").count()
        there = written(there.where("count = 1").drop("count"), "labelled")
        if p == 1.0 or there.count() >= most:
            break
        share *= 4
    chosen = there.orderBy("_h", "doc_id").limit(most).select("doc_id", "toxic")
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def mark_columns(word: Column) -> Column:
    """marks_of() as an array column."""
    starts = F.transform(F.sequence(F.lit(3), F.least(F.lit(8), F.length(word))), lambda k: F.concat(F.substring(word, F.lit(1), k), F.lit("*")))
    return F.when(F.length(word) >= 3, F.concat(F.array(word), starts)).otherwise(F.array(word))


def word_table(texts: DataFrame) -> DataFrame:
    """From training texts to word, toxic (texts), clean (texts) and worth.

    A word is worth the toxic texts that have it, but no more than its distinct neighbourhoods there
    (copies of a text share them, so a word of one much copied text weighs little).
    """

    def toxic(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", 1 << 20):
            rows: Counter = Counter()
            for text in batch.column("text").to_pylist():
                words = PIECE.findall(text.lower())
                seen = set()
                for around in set(zip(["", *words], words, [*words[1:], ""], strict=False)):
                    rows[around] += around[1] not in seen
                    seen.add(around[1])
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = [pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], pa.array(list(rows.values()), pa.int64())], names=["before", "word", "after", "n"])

    def clean(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", 1 << 20):
            rows = Counter(w for text in batch.column("text").to_pylist() for w in set(PIECE.findall(text.lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64())], names=["word", "n"])

    bad = texts.where("toxic").select("text").mapInArrow(toxic, "before string, word string, after string, n long")
    bad = bad.groupBy("before", "word", "after").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("toxic"), F.count(F.lit(1)).alias("around"))
    good = texts.where("not toxic").select("text").mapInArrow(clean, "word string, n long").groupBy("word").agg(F.sum("n").alias("clean"))
    both = bad.join(good, "word", "full_outer").select("word", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("toxic", "around", "clean")])
    return both.withColumn("worth", F.when(F.length("word") > 2, F.least("toxic", "around")).otherwise(0))


def pick_marks(values: dict[str, float], words: dict[str, tuple[float, float]]) -> list[str]:
    """Marks in order, each next one with most that no other covers.

    values: what a mark's words are worth together, less the fines; words: the same of each word.
    """
    of: dict[str, list[str]] = {}
    for w in words:
        for m in marks_of(w):
            if m in values:
                of.setdefault(m, []).append(w)
    value, open_ = dict(values), dict(words)
    chosen: list[str] = []
    while value:
        best = max(value, key=lambda m: (value[m], len(m), m))
        if value.pop(best) < LEAST:
            break
        chosen.append(best)
        for w in of.get(best, []):
            worth, fines = open_.pop(w, (0.0, 0.0))
            if worth:
                for m in marks_of(w):
                    if m in value:
                        value[m] -= worth - fines
    return chosen


def fit(docs: DataFrame, labels: DataFrame, held_out, most: int = TRAIN_DOCS) -> Model:
    """Learn from labelled rows for which held_out (a condition on doc_id) is false."""
    grams = trigram_counts(docs)
    with scratch(docs.sparkSession):
        texts = written(training_texts(docs, labels, held_out, most), "training-texts")
        sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
        if len(sizes) < 2:
            return Model([], np.zeros(0), 30.0 if True in sizes else 0.0, trigram_costs(grams, Counter()))
        words = written(word_table(texts), "training-words")
        marked = words.withColumn("mark", F.explode(mark_columns(F.col("word"))))
        value = F.sum("worth") - F.lit(FINE) * F.sum("clean")
        best = marked.groupBy("mark").agg(value.alias("value")).where(F.col("value") >= LEAST).orderBy(F.desc("value"), "mark").limit(MARKS)
        best = written(best, "training-marks")
        kept = marked.where("worth > 0").join(F.broadcast(best.select("mark")), "mark", "left_semi").select("word", "toxic", "clean", "worth").distinct()
        kept = kept.orderBy(F.desc("worth"), "word").limit(MARK_WORDS).collect()
        marks = pick_marks({r["mark"]: r["value"] for r in best.collect()}, {r["word"]: (r["worth"], FINE * r["clean"]) for r in kept})
        known = set(marks)
        matched = Counter({r["word"]: r["toxic"] for r in kept if not known.isdisjoint(marks_of(r["word"]))})
        model = Model(marks, np.zeros(2 * len(marks)), 0.0, trigram_costs(grams, matched))
        return weighed(texts, model)


def weighed(texts: DataFrame, model: Model) -> Model:
    """The model with weights and bias from texts of both kinds, scored as any text is."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        import pyarrow as pa

        m, rows = shared.value, Counter()
        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts = m.counts(text)
                for k, n in counts.items():
                    rows[2 * k + (n > 1), toxic] += 1
                if not counts:
                    rows[-1, toxic] += 1
        at = [pa.array([k for k, _ in rows], pa.int64()), pa.array([bool(y) for _, y in rows]), pa.array(list(rows.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(at, names=["k", "toxic", "n"])

    hits, bad = np.zeros(2 * len(model.marks) + 1), np.zeros(2 * len(model.marks) + 1)
    for r in texts.mapInArrow(count, "k long, toxic boolean, n long").groupBy("k", "toxic").agg(F.sum("n").alias("n")).collect():
        hits[r["k"]] += r["n"]
        bad[r["k"]] += r["n"] * r["toxic"]
    total = texts.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("long"))).first()
    rate = total[1] / total[0]
    # -ln(1 - q): q the share of toxic texts among those with one word, or more, of a mark; the last: among those without marks
    q = (bad + 0.5 * rate) / (hits + 0.5)
    pairs = q[:-1].reshape(-1, 2)
    pairs[:, 1] = np.maximum(pairs[:, 0], pairs[:, 1])
    return Model(list(model.marks), -np.log1p(-np.minimum(pairs, 0.999)).ravel(), -math.log1p(-q[-1]), model.costs)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score between 0 and 1 of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return docs.withColumn(column, score(F.col("text").cast("string")))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, labels, held_out)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
