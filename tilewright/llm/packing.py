"""Best-fit packing of token sequences, improved by swap-based local search.

A document is its ids and one end id. A document longer than a sequence is cut into pieces of full
length, the first of which is shorter; full pieces fill a sequence each. The others (one at most of
each document) are dealt by a hash of id and length into groups of some 100,000, each packed in one
task: best fit in decreasing order, then a local search among the sequences that are not full.
Groups are of bounded size and as many as the data needs; their loss against one packing of all is
less than a sequence each.

Local search: the sequence with least in it tries to give its pieces away. A piece moves to the
fullest sequence with room for it; else it changes places with a smaller piece of a fuller
sequence, or with two that are smaller together. Each step adds to the sum of squared fills, so it
ends; a sequence that has become empty is saved.

Defined results: null text counts as empty (one end id); rows that repeat an id are packed each for
itself; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import slices, table, written

LENGTH, END_ID = 1024, 2
GROUP = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of item numbers. Open bins are found by what is left in them, through a bit mask."""
    left_of: list[list[int]] = [[] for _ in range(room + 1)]
    mask, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = left_of[left].pop()
            if not left_of[left]:
                mask &= ~(1 << left)
            bins[b].append(i)
            left -= n
        else:
            b, left = len(bins), room - n
            bins.append([i])
        if left:
            left_of[left].append(b)
            mask |= 1 << left
    return bins


class _Open:
    """Sequences that are not full, by what is left in them and the lengths of their pieces."""

    def __init__(self, room: int):
        self.by_left: list[dict[tuple[int, ...], set[int]]] = [{} for _ in range(room + 1)]
        self.mask = 0

    def add(self, b: int, left: int, lengths: tuple[int, ...]) -> None:
        if left:
            self.by_left[left].setdefault(lengths, set()).add(b)
            self.mask |= 1 << left

    def remove(self, b: int, left: int, lengths: tuple[int, ...]) -> None:
        if left:
            alike = self.by_left[left][lengths]
            alike.discard(b)
            if not alike:
                del self.by_left[left][lengths]
                if not self.by_left[left]:
                    self.mask &= ~(1 << left)

    def others(self, b: int, least: int, below: int):
        """For what is left from least on, below a limit, in rising order: one sequence, not b, of each contents."""
        m = (self.mask >> least) << least
        while m:
            left = (m & -m).bit_length() - 1
            if left >= below:
                return
            for alike in self.by_left[left].values():
                c = next((c for c in alike if c != b), None)
                if c is not None:
                    yield left, c
            m &= m - 1


def _partners(held: list[tuple[int, int]], n: int, left: int) -> list[tuple[int, int]]:
    """One or two pieces of a sequence, smaller than n but not by more than `left`: what a piece of n may replace."""
    at = bisect_left(held, (n - left, -1))
    if at < len(held) and held[at][0] < n:
        return [held[at]]
    for j, small in enumerate(held):
        if 2 * small[0] >= n:
            break
        at = max(j + 1, bisect_left(held, (n - left - small[0], -1)))
        if at < len(held) and small[0] + held[at][0] < n:
            return [small, held[at]]
    return []


def local_search(bins: list[list[int]], lengths: np.ndarray, room: int) -> list[list[int]]:
    """Fewer bins, where moves and swaps can empty some."""
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    open_ = _Open(room)
    # contents by length, so that a partner of a wanted length is found by bisection
    content: dict[int, list[tuple[int, int]]] = {b: sorted((size[i], i) for i in bins[b]) for b, f in enumerate(fill) if f < room}
    alike = lambda b: tuple(n for n, _ in content[b])
    for b in content:
        open_.add(b, room - fill[b], alike(b))
    version = 0
    futile: dict[tuple[int, int], int] = {}  # (piece, fill) that found nothing, and when

    def change(b: int, out: list[tuple[int, int]], into: list[tuple[int, int]]) -> None:
        open_.remove(b, room - fill[b], alike(b))
        for x in out:
            content[b].remove(x)
            fill[b] -= x[0]
        for x in into:
            insort(content[b], x)
            fill[b] += x[0]
        if fill[b]:
            open_.add(b, room - fill[b], alike(b))

    def improve(b: int, item: tuple[int, int]) -> bool:
        nonlocal version
        n, below = item[0], room - fill[b]
        if futile.get((n, fill[b])) == version:
            return False
        found = next(((c, []) for _, c in open_.others(b, n, below + 1) if fill[c] + n > fill[b]), None)  # a move to the fullest with room
        if found is None:  # a swap with a fuller one
            for left, c in open_.others(b, 1, min(n, below)):
                if pieces := _partners(content[c], n, left):
                    found = c, pieces
                    break
        if found is None:
            futile[n, fill[b]] = version
            return False
        c, pieces = found
        change(b, [item], pieces)
        change(c, pieces, [item])
        version += 1
        return True

    before = -1
    while before != version:
        before = version
        for b in sorted((b for b in content if fill[b]), key=lambda b: fill[b]):
            again = True
            while again and fill[b]:
                again = any(improve(b, item) for item in reversed(content[b]))
    return [x for x in ([i for _, i in content[b]] if b in content else bins[b] for b in range(len(bins))) if x]


def pack(lengths, room: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers for lengths of at most `room`."""
    lengths = np.asarray(lengths, dtype=np.int64)
    return local_search(best_fit(lengths, room), lengths, room)


def pieces(docs: DataFrame, vocabulary: str | None = None, room: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Tokenize and cut: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        import pyarrow as pa

        from tilewright.llm.bpe import shared

        bpe = shared(vocabulary)
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(bpe.encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % room or room
                edges = [0, *range(first, len(ids) + 1, room)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def packed(cut: DataFrame, room: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Pieces with sequence_id and offset. cut is read twice, so give it written."""
    short = cut.where(F.col("length") < room)
    n = max(1, -(-short.count() // group))

    def run(key, batch):
        import pyarrow as pa

        batch = batch.combine_chunks()
        lengths = batch.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for s, items in enumerate(pack(lengths, room)):
            at = 0
            for i in items:
                sequence[i], offset[i] = s, at
                at += lengths[i]
        sequence = sequence * (2 * n) + 2 * key[0].as_py()
        return batch.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = short.withColumn("_g", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.monotonically_increasing_id()), F.lit(n)))
    small = dealt.groupBy("_g").applyInArrow(run, PACKED)
    # full pieces have a sequence each; odd numbers, so that no sequence of the others is met
    full = cut.where(F.col("length") >= room).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return small.unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, room: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    return packed(written(pieces(docs, vocabulary, room, end_id), "packing-pieces"), room)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
