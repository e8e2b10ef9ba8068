"""Exact duplicates: group by a 128-bit content hash, keep one stable row, compare bytes.

The main path is DataFrame operations only. Equal texts meet by (hash, text), so the text itself
is part of the grouping key: two texts that share the hash stay apart because their bytes differ.
The partial aggregate before the shuffle folds copies, so a text that a third of the rows repeat
leaves each map task once. What the rows are joined with afterwards is small: 128-bit hash,
SHA-256 and an id; Spark can split a hot hash there, for the join needs no state of a key.

Defined results:
  * null text counts as the empty text; empty texts are equal to each other;
  * a null id is smaller than any id; a group of null ids only keeps null, and every such row is kept;
  * rows that repeat an id within a group: each row with the kept id is kept;
  * an empty table gives an empty result; other columns are left out of the digest and kept by deduplicate(),
    whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import quoted, table

ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes, as binary."""
    return F.unhex(F.md5(text.cast("binary")))


def groups(docs: DataFrame, keep: str = "max", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text")).withColumn("_hash", hashed(F.col("_text")))
    pick = F.max if keep == "max" else F.min
    same = rows.groupBy("_hash", "_text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # a second digest tells apart texts that share the first; two texts that shared both would stop the job
    same = same.select("_hash", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    same = same.groupBy("_hash", "text_sha256").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("_texts")
    )
    same = same.withColumn("group_size", F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts share both digests"))).otherwise(F.col("group_size")))
    light = rows.select("doc_id", "_hash", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"))
    return light.join(same, ["_hash", "text_sha256"]).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def _ordered(kind: T.DataType) -> bool:
    """Whether values of a type have an order."""
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def deduplicate(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of docs that stay, all their columns, one for each text.

    A row stays if it is the first of its text by (id, then all other columns; those of types without
    an order by their JSON): rows that repeat an id and a text give one row, unlike in groups(), where
    each is told of.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # the text is equal within a group, so it need not be carried twice
    others = [(f"c{k}", quoted(f.name), f.dataType) for k, f in enumerate(docs.schema.fields) if f.name != "text"]
    missing = F.col("text").isNull().alias("missing")
    row = F.struct(*[c.alias(n) for n, c, _ in others], missing)
    order = F.struct(F.col("doc_id"), *[(c if _ordered(t) else F.to_json(F.struct(c))).alias(n) for n, c, t in others], missing)
    pick = F.max_by if keep == "max" else F.min_by
    best = docs.groupBy(content_hash(text).alias("hash"), text.alias("same")).agg(pick(row, order).alias("row"))
    columns = [F.when(~F.col("row.missing"), F.col("same")).alias(c) if c == "text" else F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)]
    return best.select(*columns)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
