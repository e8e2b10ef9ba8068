"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression's class of what is not white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where a session on one machine names none (tests), a temporary folder is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tilewright-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Tables that written() makes inside are deleted on leaving, but for those that stay.

    What is returned from inside must read only tables that stay; these pass to the scratch around it, if any.
    """
    stack = _scratch.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in stack.pop():
            at = hadoop(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, stays: int = 0) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    The files outlive lost executors. Within scratch() they go when it ends, or the scratch `stays` levels
    around it; where there is none, they stay until the folder is emptied, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    stack = _scratch.__dict__.get("stack", [])
    if len(stack) > stays:
        stack[-1 - stays].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(column: str) -> Column:
    """A column by its name, whatever signs that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the sum of its expression over the rows before in the given total order.

    Rows are range-partitioned and summed by partition; only a row per partition is sorted in one task.
    """
    part = fresh(df, "_part")
    ranged = df.select("*", *[e.alias(n) for n, e in sums.items()]).repartitionByRange(*order)
    ranged = written(ranged.withColumn(part, F.spark_partition_id()), "ranged")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(part).agg(*[F.sum(n).alias(n) for n in sums])
    base = totals.select(part, *[F.coalesce(F.sum(n).over(before(Window.orderBy(part))), F.lit(0)).alias(f"{n}_base") for n in sums])
    inside = before(Window.partitionBy(part).orderBy(*order))
    out = ranged.join(F.broadcast(base), part)
    return out.select(*df.columns, *[(F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"{n}_base")).alias(n) for n in sums])


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ runs of a text, 0 for null; a long."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda x: x != "")).cast("long")


def slices(batches: Iterator, column: str, most: int = 8 << 20) -> Iterator:
    """Cut Arrow record batches so that the named string column holds about `most` bytes each.

    A single row may be longer: texts are never cut here.
    """
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            end, held = start, 0
            while end < batch.num_rows and (end == start or held + lengths[end] <= most):
                held += int(lengths[end])
                end += 1
            yield batch.slice(start, end - start)
            start = end
