"""Mixture-controlled packing: deficit round-robin over source queues fills every window.

A document is its ids and an end id. Documents are dealt at random to partitions of about GROUP tokens,
so that each has nearly the mixture of the whole; a partition is packed in one task. In it each source
has a queue of its documents, cut into packets of at most PACKET tokens. Deficit round-robin serves
them: a round adds to each queue's deficit its quantum (its share of ROUND tokens), and a queue is
served packets as long as its deficit covers the next one. What a queue could not spend is carried to
the next round, so to the next window, and from partition to partition: a queue begins with what its
source was owed by the partitions before (its share of all their tokens, less its own tokens there).
The windows are cut out of the stream that is served, each of LENGTH tokens.

The rounds are not walked one by one. A packet is served in the first round whose quanta, with the
deficit at the start, cover its queue up to its end, which is a running sum and a division; sorting
packets by round, source and place gives the order of service.

The shares are those of the sources' tokens unless others are given. A queue that is empty passes its turn,
so that the others share what it leaves. The tokens of a partition that fill no whole window go to
windows of a power of two each, so nothing is padded: a piece is never longer than a window, windows
are 2048 long or a power of two, and each partition adds at most log2(LENGTH) shorter ones.

Defined results: null text counts as empty (one end id); null is a source of its own; rows that repeat an
id are packed each for itself; a source that is given the share 0 or none comes after all others;
an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import prefix_sums, scratch, slices, table, written

LENGTH, END_ID = 2048, 1
PACKET, ROUND = 512, 2048
GROUP = 4_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, n and the ids with the end id, as little-endian unsigned 16-bit integers."""

    def run(batches):
        import pyarrow as pa

        from tilewright.llm.bpe import shared

        bpe = shared(vocabulary)
        for batch in slices(batches, "text"):
            ids = []
            for text in batch.column("text").to_pylist():
                x = np.append(bpe.encode(text or ""), np.uint32(end_id))
                if len(x) and int(x.max()) > 0xFFFF:
                    raise ValueError("ids of this vocabulary need more than 16 bits")
                ids.append(x.astype("<u2").tobytes())
            lengths = pa.array([len(x) // 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), lengths, pa.array(ids, pa.binary())], names=["doc_id", "source", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, n long, ids binary")


def served(lengths: np.ndarray, queue: np.ndarray, share: np.ndarray, owed: np.ndarray, packet: int = PACKET, quantum: float = ROUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of service as (document, first token, tokens) per packet.

    lengths and queue are by document, in order of the queues; share and owed (the deficit at the
    start) by queue.
    """
    count = -(-lengths // packet)
    doc = np.repeat(np.arange(len(lengths)), count)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * packet
    size = np.minimum(packet, lengths[doc] - first)
    q = queue[doc]
    by_queue = np.argsort(q, kind="stable")
    sums = np.cumsum(size[by_queue])
    begins = np.searchsorted(q[by_queue], np.arange(len(share)))
    before = np.concatenate([[0], sums])[begins]
    end = np.empty(len(doc), np.int64)
    end[by_queue] = sums - before[q[by_queue]]
    with np.errstate(divide="ignore", invalid="ignore"):
        rounds = np.where(share[q] > 0, np.ceil((end - owed[q]) / (share[q] * quantum)), np.inf)
    order = np.lexsort((end, q, np.maximum(rounds, 1)))
    return doc[order], first[order], size[order]


def windows(total: int, length: int = LENGTH) -> np.ndarray:
    """Where windows begin, and the end: whole ones, then the rest by powers of two."""
    sizes = [length] * (total // length)
    rest = total % length
    sizes += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def laid_out(doc: np.ndarray, first: np.ndarray, size: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Cut the stream of packets into windows: (document, start, tokens, window, offset) per piece."""
    # packets of one document that follow each other are one
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + size[:-1])
    at = np.flatnonzero(new)
    doc, first, size = doc[at], first[at], np.add.reduceat(size, at)
    begins = np.concatenate([[0], np.cumsum(size)])
    edges = windows(int(begins[-1]), length)
    cuts = np.union1d(begins, edges)
    left, tokens = cuts[:-1], np.diff(cuts)
    run = np.searchsorted(begins, left, side="right") - 1
    window = np.searchsorted(edges, left, side="right") - 1
    return doc[run], first[run] + left - begins[run], tokens, window, left - edges[window]


def packed(ids: DataFrame, shares: DataFrame | None, length: int, group: int, packet: int) -> DataFrame:
    """Pieces of encoded documents. ids is read several times, so give it written.

    shares: (source, weight), one row per source; None: by the sources' tokens.
    """
    spark = ids.sparkSession
    total = ids.agg(F.sum("n")).first()[0]
    if total is None:
        return spark.createDataFrame([], PIECES)
    n = max(1, -(-total // group))
    part = F.pmod(F.xxhash64("doc_id", "n", "_o"), F.lit(n)).cast("long")
    with scratch(spark):
        cells = written(ids.withColumn("_p", part).groupBy("source", "_p").agg(F.sum("n").alias("_n")), "mixture-cells")
        sources = cells.groupBy("source").agg(F.sum("_n").alias("_all"))
        if shares is None:
            sources = sources.withColumn("_share", F.col("_all") / F.lit(total))
        else:
            given = F.col("s.source").eqNullSafe(F.col("w.source"))
            weights = shares.crossJoin(F.broadcast(shares.agg(F.sum("weight").alias("_sum"))))  # one row
            weights = weights.select("source", (F.col("weight") / F.col("_sum")).alias("_share"))
            sources = sources.alias("s").join(weights.alias("w"), given, "left").select("s.source", "_all", F.coalesce("_share", F.lit(0.0)).alias("_share"))
        # tokens of a source, and of all, in the partitions before
        by_source = prefix_sums(cells, [F.col("source").asc_nulls_first(), F.col("_p").asc()], {"_own": F.col("_n")})
        start = by_source.groupBy("source").agg(F.min("_own").alias("_start"))
        start = start.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "_start", "_share")
        whole = prefix_sums(cells.groupBy("_p").agg(F.sum("_n").alias("_n")), [F.col("_p").asc()], {"_before": F.col("_n")}).select("_p", "_before")
        owed = by_source.alias("c").join(start.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        owed = owed.select("c.source", "c._p", "_share", (F.col("_own") - F.col("_start")).alias("_own")).join(whole, "_p")
        queues = written(owed.select("source", "_p", "_share", (F.col("_share") * F.col("_before") - F.col("_own")).alias("_owed")), "mixture-queues", stays=1)

    def run(key, rows, state):
        import pyarrow as pa
        import pyarrow.compute as pc

        # queues in order of the source, null last; within them documents in order of their places
        state = state.sort_by("source")
        rows = rows.sort_by("_o").combine_chunks()
        at = {s: k for k, s in enumerate(state.column("source").to_pylist())}
        queue = np.fromiter((at[s] for s in rows.column("source").to_pylist()), np.int64, rows.num_rows)
        lengths = rows.column("n").to_numpy()
        share, owed = (state.column(c).to_numpy() for c in ("_share", "_owed"))
        doc, start, tokens, window, offset = laid_out(*served(lengths, queue, share, owed, packet), length)
        ids = rows.column("ids").to_pylist()
        crc = np.zeros(len(doc), np.int64)
        for k in np.argsort(doc, kind="stable").tolist():
            a = int(start[k]) * 2
            crc[k] = zlib.crc32(np.frombuffer(ids[doc[k]], "<u2", int(tokens[k]), a).astype("<u4").tobytes())
        take = pa.array(doc)
        return pa.table({
            "doc_id": pc.take(rows.column("doc_id"), take), "start": start, "length": tokens, "ids_crc32": crc,
            "doc_tokens": lengths[doc], "sequence_id": key[0].as_py() << 32 | window, "offset": offset,
        })

    return ids.withColumn("_p", part).groupBy("_p").cogroup(queues.groupBy("_p")).applyInArrow(run, PIECES)


def pack_documents(
    docs: DataFrame, shares: DataFrame | None = None, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP, packet: int = PACKET
) -> DataFrame:
    """Pieces of docs, packed into windows of the shares' mixture (the operator's general form)."""
    ids = written(encoded(docs, vocabulary, end_id).withColumn("_o", F.monotonically_increasing_id()), "mixture-ids")
    return packed(ids, shares, length, group, packet)


def op11_mixture_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
