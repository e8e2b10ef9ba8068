"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their classes.

Sets. A text's words are hashed, five neighbours make a shingle, and a set is its distinct 64-bit
shingle hashes. Rows of equal sets are one class from the start, named by a hash of the set; that
two sets share a name is checked and stops the job (choose another seed).

Candidates. Shingles are ordered rare to frequent (those that tasks meet in two or more documents
are counted over all documents; the most frequent form a table of fixed size, which only sets the
order, never the result). Two sets that link must share one of their first n - ceil(0.8 n) + 1
shingles. Postings of these are sorted by shingle and size in one pass that holds one row; it pairs
neighbours of a list only. Pairs are verified and linked sets form classes. A list whose members
are all of one class is done, however long. What lists still hold of different classes is paired, in
blocks of bounded size, without the pairs that sizes, earlier tests or parities rule out (a
set of n has some 2 n parity bits, and those of two sets differ in no more bits than the sets in members,
so the rule is exact; it leaves little but true neighbours). Members of a list's most frequent class need not
meet each other: they are sent to one block each, and only the others, few as a rule, to every block whose
sizes are near their own. A first round tells, for each of these, of its likeliest partner in the frequent class
and of that in the others, so its pairs are no more than twice the members; links found so merge classes. A second
round tells of every pair of different classes that is then left untested; members that had no likeliest partner
have none, and need not meet each other there. So no link between different classes is lost and no group of
copies is ever expanded into all its pairs.

Verification is a T-occurrence search. The candidates of a set, in blocks, are inverted: a list of
candidates for each shingle of the set. The required overlap T tells how many of the longest lists
can be left out (DivideSkip): the short ones are merged by a heap, and what occurs T - L times in
them is probed for in the L long ones by bisection.

Defined results: null and empty texts have an empty set and are a class of their own row; rows
that repeat an id are rows of their own; a null id is never the smallest; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from itertools import groupby
from math import log, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import fresh, scratch, slices, table, written
from tilewright.llm.components import components

WORDS, PERCENT = 5, 80
#: Size of the table of frequent shingles, and the shingles a task counts at once.
FREQUENT, COUNTED = 1 << 20, 3_000_000
#: Rows (of 16 bytes) that may be broadcast.
BROADCAST = 1 << 20
#: Candidates that are inverted together, and members of a list that are paired in one block.
BLOCK, LIST_BLOCK = 64, 256
#: Tasks that share the lists of one family, and pairs of a set that are told of in one row.
FAMILY, ROLES = 8, 4096
#: Weighs a probe by bisection against a step of the heap.
MU = 0.0085

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, seed: int = 0, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)) + np.uint64(seed)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def name_of(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """A set's name and a second hash of it."""
    digest = hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return tuple(int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))


def parity_bits(s: np.ndarray) -> bytes:
    """A set as parities: bit k is the number of its hashes that are k modulo a power of two from twice its size on.

    Two sets' parities differ in no more bits than their symmetric difference has members. A longer
    one folds to half its length by exclusive or.
    """
    size = max(64, 2 << (max(1, len(s)) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def may_link(n: np.ndarray, bits: list[bytes], percent: int = PERCENT, root: np.ndarray | None = None, own: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Pairs of members of different roots (and own) whose sizes and parities do not rule a link out, and by how many bits.

    Members of the most common root are compared with, but don't compare: few others are left of a
    list that is nearly one class.
    """
    length = np.array([len(b) for b in bits])
    root = np.arange(len(n)) if root is None else root
    names, counts = np.unique(root, return_counts=True)
    passive = root == names[counts.argmax()] if counts.max() > 1 else np.zeros(len(n), bool)
    by = {int(x): np.flatnonzero(length == x) for x in np.unique(length)}
    words = {x: np.stack([np.frombuffer(bits[k], np.uint64) for k in at]) for x, at in by.items()}
    folded = {x: _folded(words[x]) for x in by if x // 2 in by or 2 * x in by}
    out = []
    for x, at in by.items():
        for row, k in enumerate(at):
            if passive[k]:
                continue
            parts = [(at, words[x], words[x][row])]
            if 2 * x in by:
                parts.append((by[2 * x], folded[2 * x], words[x][row]))
            if x // 2 in by:
                parts.append((by[x // 2], words[x // 2], folded[x][row]))
            for ids, held, mine in parts:
                # of two that both compare, the later one in order does
                ok = (root[ids] != root[k]) & (passive[ids] | (ids < k))
                if own is not None:
                    ok &= own[ids] != own[k]
                total = n[ids] + n[k]
                ok &= 100 * np.minimum(n[ids], n[k]) >= percent * np.maximum(n[ids], n[k])
                if ok.any():
                    need = -(-percent * total // (100 + percent))
                    spare = total - 2 * need - np.bitwise_count(held ^ mine).sum(1, dtype=np.int64)
                    ok &= spare >= 0
                    out += [(int(k), int(j), int(b)) for j, b in zip(ids[ok], spare[ok], strict=True)]
    return out


def required(n: int, m: int, percent: int = PERCENT) -> int:
    """The least overlap of sets of n and m that makes percent of their union."""
    return -(-percent * (n + m) // (100 + percent))


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Which of the sets (sorted arrays) reach the required overlap with the query."""
    need = [required(len(query), len(s), percent) for s in sets]
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order].tolist()
    start, end = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
    lists = sorted(((e - s, s) for s, e in zip(start.tolist(), end.tolist(), strict=True) if e > s), reverse=True)
    t = min(need, default=0)
    if len(lists) < t or not lists:
        return []
    long_ = min(len(lists), int(t / (MU * log2(lists[0][0] + 1) + 1)), t - 1)
    long_lists = [owners[s : s + n] for n, s in lists[:long_]]
    found = []
    for owner, run in groupby(heapq.merge(*(owners[s : s + n] for n, s in lists[long_:]))):
        count = sum(1 for _ in run)
        if count < need[owner] - long_:
            continue
        for k, held in enumerate(long_lists):
            if count >= need[owner] or count + long_ - k < need[owner]:
                break
            at = bisect_left(held, owner)
            count += at < len(held) and held[at] == owner
        if count >= need[owner]:
            found.append(owner)
    return found


def _frequent(docs: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents hold, sorted, and in how many; a table of at most FREQUENT rows."""

    def count(batches):
        import pyarrow as pa

        held, n = [], 0

        def told():
            token, times = np.unique(np.concatenate(held), return_counts=True)
            more = times > 1
            return pa.RecordBatch.from_arrays([pa.array(token[more].view(np.int64)), pa.array(times[more].astype(np.int64))], names=["token", "n"])

        for batch in slices(batches, "text"):
            for text in dict.fromkeys(batch.column("text").to_pylist()):
                held.append(shingles(text, seed))
                n += len(held[-1])
                if n > COUNTED:
                    yield told()
                    held, n = [], 0
        if held:
            yield told()

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = written(counts, "join-counts")
    # the least count that at most FREQUENT shingles reach: counts by count are few
    least, rows = 1 << 62, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        rows += r["count"]
        if rows > FREQUENT:
            break
        least = r["n"]
    top = counts.where(F.col("n") >= least).toArrow()
    token, times = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(token)
    return token[order], times[order]


def _prefixes(docs: DataFrame, seed: int, frequent, percent: int) -> DataFrame:
    """doc_id, sid (the set's name), check, n; of sets that the task meets first also parities and first shingles."""

    def run(batches):
        import pyarrow as pa

        common, times = frequent.value
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingles(text, seed)
                n = len(s)
                sid, check = name_of(s, seed)
                first = bits = None
                if n and sid not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(sid)
                    bits = parity_bits(s)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        rank = np.where(common[at] == s, times[at], 0)
                        s = s[np.argsort(rank, kind="stable")]
                    first = s[: n + (-percent * n // 100) + 1].view(np.int64)
                rows.append((doc_id, sid, check, n, bits, first))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "sid", "check", "n", "bits", "first"])

    return docs.mapInArrow(run, "doc_id long, sid long, check long, n long, bits binary, first array<long>")


def _neighbours(batches, percent: int):
    """Postings sorted by (token, n, sid): those whose list has others of a size that fits, and such a one before."""
    import pyarrow as pa

    def told(t, s, n, until):
        """Of rows 1 to until - 1; row 0 and, if not the last, row `until` are neighbours only."""
        # of a list's members the next in size fits best: one that fits neither neighbour fits none
        same = (t[1:] == t[:-1]) & (s[1:] != s[:-1]) & (100 * n[:-1] >= percent * n[1:])
        before = np.concatenate([[False], same])[:until]
        after = np.concatenate([same, [False]])[:until]
        keep = before | after
        keep[0] = False
        at = np.flatnonzero(keep)
        prev = np.where(before[at], s[at - 1], 0)
        return pa.RecordBatch.from_arrays([pa.array(t[at]), pa.array(s[at]), pa.array(n[at]), pa.array(prev, mask=~before[at])], names=["token", "sid", "n", "prev"])

    # row 0 is a stand-in that shares no list with the first row
    t, s, n = (np.zeros(1, np.int64) for _ in range(3))
    first = True
    for batch in batches:
        a, b, c = (batch.column(k).to_numpy() for k in range(3))
        if not len(a):
            continue
        if first:
            t, first = np.array([~a[0]]), False
        t, s, n = np.concatenate([t, a]), np.concatenate([s, b]), np.concatenate([n, c])
        again = np.concatenate([[False], (t[1:] == t[:-1]) & (s[1:] == s[:-1])])  # the same set from two tasks
        t, s, n = t[~again], s[~again], n[~again]
        if len(t) > 2:
            yield told(t, s, n, len(t) - 1)
            t, s, n = t[-2:], s[-2:], n[-2:]
    if not first:
        yield told(t, s, n, len(t))


def _search(pairs: DataFrame, docs: DataFrame, named: DataFrame, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) that link. Sets are made again from the texts of those documents that pairs name.

    A set is sent to each query that it is held against (and its own), never twice on the way: what
    it is needed for travels to the text, if that is of a size that can be broadcast.
    """
    asked = pairs.select(F.col("a").alias("sid"), "a", F.lit(None).cast("long").alias("b")).distinct()
    roles = asked.unionByName(pairs.select(F.col("b").alias("sid"), "a", "b"))
    # a set of many pairs is told of them in several rows
    many = roles.groupBy("sid").agg(F.ceil(F.count(F.lit(1)) / ROLES).alias("rows")).where("rows > 1")
    roles = roles.join(many, "sid", "left").withColumn("row", F.pmod(F.xxhash64("a", "b"), F.coalesce("rows", F.lit(1))))
    wanted = roles.groupBy("sid", "row").agg(F.collect_list(F.struct("a", "b")).alias("roles")).join(named.select("sid", "doc_id"), "sid")
    wanted = written(wanted.drop("row"), "join-wanted")
    if (wanted.agg(F.sum(F.size("roles") + 2)).first()[0] or 0) <= BROADCAST:
        wanted = F.broadcast(wanted)

    def send(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", 4 << 20):
            out = []
            for sid, roles, text in zip(*(batch.column(c).to_pylist() for c in ("sid", "roles", "text")), strict=True):
                s = shingles(text, seed)
                if name_of(s, seed)[0] == sid:  # else another text under the same id
                    out += [(r["a"], r["b"], s.tobytes()) for r in roles]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["a", "b", "items"])

    rows = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("w.sid", "w.roles", "d.text")
    sent = rows.mapInArrow(send, "a long, b long, items binary")

    def run(batches):
        import pyarrow as pa

        query, names, block = None, [], []
        links: list[tuple[int, int]] = []

        def flush():
            if block:
                links.extend((query[0], names[k]) for k in divide_skip(query[1], block, percent))
                names.clear()
                block.clear()

        def told():
            cols = list(zip(*links, strict=True)) or [[], []]
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

        for batch in batches:
            for a, b, items in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = np.frombuffer(items, np.uint64)
                if b is None:
                    flush()
                    query = (a, s)
                else:
                    names.append(b)
                    block.append(s)
                    if len(block) >= BLOCK:
                        flush()
            yield told()
        flush()
        yield told()

    dealt = sent.repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def _plausible(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parities do not rule out."""
    side = lambda c: named.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    @F.pandas_udf("boolean")
    def near(n_a, bits_a, n_b, bits_b):
        import pandas as pd

        return pd.Series([bool(may_link(np.array([n, m]), [x, y], percent)) for n, x, m, y in zip(n_a, bits_a, n_b, bits_b, strict=True)], dtype=bool)

    t = pairs.join(side("a"), "a").join(side("b"), "b")
    return t.where(near("n_a", "bits_a", "n_b", "bits_b")).select("a", "b")


def _likeliest(pairs: list[tuple[int, int, int]], sid: np.ndarray, passive: np.ndarray) -> list[tuple[int, int, int]]:
    """Of each member that is not passive, its likeliest pair with a passive one and with another."""
    best: dict[tuple[int, bool], tuple[int, int, int, int]] = {}
    for x, y, spare in pairs:
        for p, q in ((x, y), (y, x)):
            if not passive[p]:
                key, way = (p, bool(passive[q])), (-spare, int(sid[q]), x, y)
                best[key] = min(way, best.get(key, way))
    return list({(x, y, -spare) for spare, _, x, y in best.values()})


def _across(shared: DataFrame, classes: DataFrame, named: DataFrame, live: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of different classes that lists still hold and that sizes and parities do not rule out: (a, b); and these lists.

    A list's members fall into bands of size, so wide that sets which link lie in one band or in two next to each
    other, and those of a band, passive members apart from the others, into blocks of some LIST_BLOCK members. Blocks
    meet in pairs, if their bands are near and not both are passive. Without live, a list's passive members are those
    of its most frequent class, and only the likeliest pairs of each other one are told. With it (a table of sid),
    those that it does not name are passive, and all pairs are told.
    """
    rooted = shared.join(classes, shared["sid"] == classes["node"], "left").select("token", "sid", "n", F.coalesce("root", "sid").alias("root"))
    held = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
    lists = held.groupBy("token").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("m", "root"))["root"].alias("top")).where("roots > 1")
    width = -log(percent / 100) * (1 + 1e-9)
    band = F.floor(F.log(F.col("n").cast("double")) / width) if width else F.col("n")
    rows = rooted.join(lists.select("token", "top"), "token").withColumn("band", band.cast("long"))
    few = live is None
    if few:
        rows = rows.withColumn("passive", F.col("root") == F.col("top"))
    else:
        rows = rows.join(live.withColumn("live", F.lit(True)), "sid", "left").withColumn("passive", F.col("live").isNull()).drop("live")
    rows = written(rows, "join-members", stays=1)
    members = rows.select("token", "sid", "n")
    # a power of two, so that lists of alike lengths are cut alike
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.count(F.lit(1)) / LIST_BLOCK, F.lit(1.0))))).cast("long")
    bands = rows.groupBy("token", "band", "passive").agg(blocks.alias("k"))
    near = bands.groupBy("token").agg(F.collect_list(F.struct("band", "passive", "k")).alias("bands"))
    cell = lambda b, p, i: (b * 2 + p.cast("long")) * F.lit(1 << 40) + i
    meets = lambda x: (F.abs(x["band"] - F.col("band")) <= 1) & ~(x["passive"] & F.col("passive"))
    cells = lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["k"] - 1), lambda i: cell(x["band"], x["passive"], i))
    rows = rows.join(bands, ["token", "band", "passive"]).withColumn("own", cell(F.col("band"), F.col("passive"), F.pmod(F.xxhash64("sid"), F.col("k"))))
    rows = rows.join(near, "token").withColumn("other", F.explode(F.flatten(F.transform(F.filter("bands", meets), cells))))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") == F.col("i")).cast("int"))
    rows = rows.select("token", "sid", "n", "root", "top", "i", "j", "side").join(named.select("sid", "bits"), "sid")
    # lists of one family share members: some of them go to one task, which tells of a pair once
    to = F.xxhash64("top", F.pmod("token", F.lit(FAMILY)), "i", "j")
    member = F.struct("sid", "n", "root", "side", "bits")
    groups = rows.withColumn("to", to).repartition("to").groupBy("to", "token", "top", "i", "j").agg(F.collect_list(member).alias("members"))

    def run(batches):
        import pyarrow as pa

        told: set[tuple[int, int]] = set()
        for batch in batches:
            if len(told) > 1_000_000:
                told.clear()
            column = batch.column("members")
            top, i, j = (batch.column(c).to_numpy() for c in ("top", "i", "j"))
            offsets = column.offsets.to_numpy()
            sid, n, root, side = (column.values.field(k).to_numpy() for k in range(4))
            bits = column.values.field(4).to_pylist()
            out: set[tuple[int, int]] = set()
            for g, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                s, r = sid[a:b], root[a:b]
                if (r == r[0]).all():
                    continue
                found = may_link(n[a:b], bits[a:b], percent, r, side[a:b] if i[g] != j[g] else None)
                for x, y, _ in _likeliest(found, s, r == top[g]) if few else found:
                    p, q = int(s[x]), int(s[y])
                    out.add((min(p, q), max(p, q)))
            out -= told
            told |= out
            cols = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return groups.select("top", "i", "j", "members").mapInArrow(run, "a long, b long").distinct(), members


def _rooted(docs: DataFrame, percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (doc_id, sid, n), and sets that are not empty (sid, doc_id, root): root names the set's class."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(spark):
        with scratch(spark):
            frequent = spark.sparkContext.broadcast(_frequent(docs, seed))
            first = written(_prefixes(docs, seed, frequent, percent), "join-prefixes")
            rows = written(first.select("doc_id", "sid", "n"), "join-rows", stays=2)
            named = first.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("x"), F.max("check").alias("y"), F.max("n").alias("n"), F.max("bits").alias("bits"))
            clash = F.raise_error(F.lit("two sets share a name: choose another seed"))
            named = written(named.select("sid", "n", "bits", F.when(F.col("x") != F.col("y"), clash).otherwise(F.col("doc_id")).alias("doc_id")), "join-names", stays=1)
            postings = first.where("first is not null").select(F.explode("first").alias("token"), "sid", "n")
            shared = postings.repartition("token").sortWithinPartitions("token", "n", "sid").mapInArrow(lambda batches: _neighbours(batches, percent), "token long, sid long, n long, prev long")
            shared = written(shared, "join-lists", stays=1)
        frequent.unpersist()
        near = written(shared.where("prev is not null").select(F.least("sid", "prev").alias("a"), F.greatest("sid", "prev").alias("b")).distinct(), "join-pairs")
        with scratch(spark):
            links = written(_search(written(_plausible(near, named, percent), "join-pairs"), docs, named, percent, seed), "join-links")
            linked = written(components(links), "join-classes", stays=1)
        lists, live, tested = shared, None, near
        for _ in range(2):
            with scratch(spark):
                pairs, lists = _across(lists, linked, named, live, percent)
                pairs = written(pairs, "join-pairs", stays=1)
                if pairs.isEmpty():  # where no member has a likeliest pair, there is none
                    break
                more = written(_search(pairs.join(tested, ["a", "b"], "left_anti"), docs, named, percent, seed), "join-links")
                stars = linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
                linked = written(components(stars.unionByName(more)), "join-classes", stays=1)
                live = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
                tested = tested.unionByName(pairs)
        least = named.join(linked, named["sid"] == linked["node"], "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
        least = written(least, "join-least", stays=1)
    return rows, least


def classes(docs: DataFrame, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    rows, least = _rooted(docs, percent, seed)
    found = least.select("sid", "root").join(least.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("sid", "component_id")
    out = rows.join(found, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of each class the row with the smallest id, nulls last; of rows that share this id, that of a text by hash.

    Rows are told apart by a hash of id and text, so what repeats both is one row. Rows with neither an
    id nor a shingle stay.
    """
    text, key = F.col("text").cast("string"), fresh(docs, "_row")
    bare = F.col("doc_id").isNull() & (text.isNull() | ~text.rlike("[^ \\t\\n\\r\\x0B\\f]"))
    keyed = docs.where(~bare).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), text))
    rows, least = _rooted(keyed.select(F.col(key).alias("doc_id"), "text"), percent, 0)
    # an empty set is a class of its own row
    rows = rows.join(least.select("sid", "root"), "sid", "left")
    rows = rows.select(F.col("doc_id").alias("row"), F.struct((F.col("n") > 0).alias("set"), F.coalesce("root", "doc_id").alias("name")).alias("class")).distinct()
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    keep = rows.join(ids, "row").groupBy("class").agg(first.alias("first")).select(F.col("first.row").alias(key))
    kept = keyed.join(keep, key, "left_semi").dropDuplicates([key]).drop(key)
    return kept.unionByName(docs.where(bare))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
