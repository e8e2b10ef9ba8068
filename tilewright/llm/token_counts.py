"""Token counts: a scan of flat token files for end-of-document ids.

A flat file holds ids only: no index tells where a document ends but the end id that closes it.
Files are read in blocks. Each block is searched at once (numpy) and gives, per separator, the ids
since the one before it in the block, and what it has after its last. Blocks are stitched by prefix
sums over the blocks of a file: how many documents ended before the block, and how many ids the
open document already has. Only a row per block takes part in that, never tokens.

Defined results: a file's ids after its last separator are a document without an end (reported with
ended = false); two separators in a row are an empty document; an empty file has none. In
flat_files(), null and empty texts give documents of the end id only, counted 0; rows that repeat
an id are documents each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import slices, table, written

END_ID = 50256
#: Bytes of a block, of two bytes an id, and documents a task puts in one file.
BLOCK, FILE_DOCS = 1 << 20, 50_000


def flat_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Tokenize into flat files of 16-bit ids: rows (file, block, kind, data).

    kind "ids": a block of the file. kind "names": the ids of the documents in order, as 64-bit
    numbers, with a byte for each that is null; a list beside the file, which the scan doesn't read.
    """

    def run(batches):
        import uuid

        import pyarrow as pa

        from tilewright.llm.bpe import shared

        bpe, end = shared(vocabulary, False), np.array([end_id], "<u2").tobytes()
        file, k, held, names, nulls, part = uuid.uuid4().hex, 0, bytearray(), [], [], 0

        def row(kind, number, data):
            cols = [pa.array([file]), pa.array([number], pa.int64()), pa.array([kind]), pa.array([bytes(data)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["file", "block", "kind", "data"])

        def named():
            return row("names", part, np.array(names, "<i8").tobytes() + bytes(nulls))

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held += bpe.encode(text or "").astype("<u2").tobytes() + end
                names.append(doc_id or 0)
                nulls.append(doc_id is None)
                while len(held) >= block:
                    yield row("ids", k, held[:block])
                    del held[:block]
                    k += 1
                if len(names) >= FILE_DOCS:
                    yield named()
                    part += 1
                    names.clear()
                    nulls.clear()
        if held:
            yield row("ids", k, held)
        if names:
            yield named()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, block long, kind string, data binary")


def scan(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """From (file, block, data) to one row per document: file, ordinal, n_tokens, ended.

    Counts leave out the end id. Blocks of any sizes of whole ids will do.
    """

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for file, block, data in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "data")), strict=True):
                ids = np.frombuffer(data, "<u2")
                at = np.flatnonzero(ids == end_id)
                lengths = np.diff(at, prepend=-1) - 1
                rows.append((file, block, lengths.astype(np.int64), len(ids) - (int(at[-1]) + 1 if len(at) else 0)))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "block", "lengths", "tail"])

    found = written(blocks.select("file", "block", "data").mapInArrow(search, "file string, block long, lengths array<long>, tail long"), "token-scan")
    light = found.select("file", "block", F.size("lengths").cast("long").alias("ends"), "tail")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # what is open when a block begins: tails since the last block with a separator, that one's included
    light = light.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    light = light.withColumn("run", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block")))
    tails = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    light = light.withColumn("total", F.sum("tail").over(tails)).withColumn("since", F.when(F.col("ends") > 0, F.col("total") - F.col("tail")))
    base = F.coalesce(F.last("since", ignorenulls=True).over(before), F.lit(0))
    light = light.withColumn("open", F.coalesce(F.lag("total").over(Window.partitionBy("file").orderBy("block")), F.lit(0)) - base)
    last = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    light = light.withColumn("last", last)
    joined = found.join(light.select("file", "block", "first", "open", "last"), ["file", "block"])
    ended = joined.select("file", "first", "open", F.posexplode("lengths").alias("k", "n")).select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("n") + F.when(F.col("k") == 0, F.col("open")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = F.col("tail") + F.when(F.size("lengths") == 0, F.col("open")).otherwise(0)
    loose = joined.where("last").where(rest > 0).select("file", (F.col("first") + F.size("lengths")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(loose)


def names(files: DataFrame) -> DataFrame:
    """From flat_files() the list beside it: file, ordinal, doc_id."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, part, data in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "data")), strict=True):
                n = len(data) // 9
                ids, null = np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.arange(n) + part * FILE_DOCS), pa.array(ids, mask=null)], names=["file", "ordinal", "doc_id"])

    return files.where("kind = 'names'").select("file", "block", "data").mapInArrow(run, "file string, ordinal long, doc_id long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    files = written(flat_files(table(spark, sf_dir, "documents")), "token-files")
    counts = scan(files.where("kind = 'ids'"))
    found = names(files).join(counts, ["file", "ordinal"], "left")
    lost = F.raise_error(F.lit("a document of the list was not met in its file"))
    return found.select("doc_id", F.when(F.col("n_tokens").isNull(), lost).otherwise(F.col("n_tokens")).alias("n_tokens"))
