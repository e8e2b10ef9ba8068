"""Mixing sources to target weights by hash thresholds.

Sizes are summed by source and hash bucket (12 bits of the md5 of id and text), so what is shuffled is
at most 4096 rows for each source and map task. A running sum over a source's buckets finds the
bucket that its budget cuts; only that bucket's rows are read again, at 12 further bits, and the
last cut is made among the hashes of one bucket of 24 bits, rows of one hash folded to a count.
Documents are filtered by a join with one row per source: nothing is sorted and no source, however
large, meets in one task. Rows that repeat both id and text share their hash; where the budget cuts
such a run, the same refinement goes on over the rows' places in the input, first by partition.

A source whose target exceeds its size is taken whole as often as fits; the rest of its budget
takes a hash prefix of its documents once more (so the sets of two budgets are nested). A document
at the cut is taken if more than half of it lies below the budget. Sources are numbered and filled
by prefix sums over ranges, as they may be as many as hosts.

Defined results: null text has size 0; null is a source of its own, ordered last; rows that repeat
an id and a text are taken one by one; sources without words have target 0 and nothing of them is
taken; an empty table gives an empty mix; further columns, whatever their names, are kept by mix().
Rows are written once with their places, so that decision and mix see the same ones however the
input is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import prefix_sums, quoted, scratch, table, word_count, written

WEIGHTS = (5, 2, 1)
MOST = 3

ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS place, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, CAST(total - capped AS DOUBLE) / CAST(weights AS DOUBLE) AS level FROM o),
m AS (SELECT arg_min(level, place) FILTER (WHERE level * weight <= 3.0 * source_size) AS level FROM l),
t AS (SELECT l.source, source_size, least(m.level * weight, CAST(3 * source_size AS DOUBLE)) AS target FROM l CROSS JOIN m),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
r AS (SELECT *, target - CAST(whole AS DOUBLE) * CAST(source_size AS DOUBLE) AS rest FROM b),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS before FROM d)
SELECT c.doc_id, c.size, r.source_size, r.target,
       CAST(c.size * (r.whole + CASE WHEN 2 * c.before + c.size <= 2 * r.rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
"""


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size), one row per source, to (source, source_size, target).

    Filling by weight up to `most` times a source's size: if sources are ordered by
    most * size / weight, those that stop come first, and the level of the others follows from
    running sums.
    """
    name = F.col("source").asc_nulls_last()
    ranked = prefix_sums(sizes, [name], {"_turn": F.lit(1)})
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int")))
    order = [F.lit(float(most)) * F.col("source_size") / F.col("_w"), name]
    ranked = prefix_sums(ranked, order, {"_capped": most * F.col("source_size"), "_used": F.col("_w"), "_place": F.lit(1)})
    ranked = written(ranked, "mix-sources")
    whole = ranked.agg(F.sum("source_size").alias("_total"), F.sum("_w").alias("_all"))
    level = (F.col("_total") - F.col("_capped")).cast("double") / (F.col("_all") - F.col("_used")).cast("double")
    levels = ranked.crossJoin(F.broadcast(whole)).withColumn("_level", level)
    # the first that does not stop; further on, more would be held back than there is
    fits = levels.where(F.col("_level") * F.col("_w") <= F.lit(float(most)) * F.col("source_size"))
    first = fits.agg(F.min(F.struct("_place", "_level"))["_level"].alias("_level"))
    target = F.least(F.col("_level") * F.col("_w"), (most * F.col("source_size")).cast("double"))
    return ranked.crossJoin(F.broadcast(first)).select("source", "source_size", target.alias("target"))


def _digits(start: int, n: int):
    """n hexadecimal digits of the hash, from digit `start` on, as an integer."""
    return F.conv(F.substring("_h", start + 1, n), 16, 10).cast("int")


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, doc_id, size, _h, _o) to one row per source: what to take of it.

    Columns: source, source_size, target, whole (times it is taken whole) and the cut: documents
    whose (_h, _o) is at most (cut_h, cut_o) are taken once more. _h is a hash, _o a row's place.
    """
    hist = sized.groupBy("source", _digits(0, 3).alias("_b1")).agg(F.sum("size").alias("_n"))
    hist = written(hist, "mix-histogram")
    plan = targets(hist.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole").cast("double") * F.col("source_size").cast("double"))
    plan = written(plan, "mix-plan")

    def boundary(hist: DataFrame, plan: DataFrame, bucket: str) -> DataFrame:
        """The last bucket of each source that begins within its budget, and what lies before it."""
        running = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        at = hist.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        at = at.alias("a").join(plan.alias("p"), F.col("a.source").eqNullSafe(F.col("p.source")))
        at = at.where(F.col("_before") + F.col("base") <= F.col("rest"))
        return at.groupBy(F.col("p.source").alias("source")).agg(F.max(F.struct(bucket, (F.col("_before") + F.col("base")).alias("base"))).alias("m")).select("source", f"m.{bucket}", "m.base")

    first = boundary(hist, plan.withColumn("base", F.lit(0)), "_b1")
    first = written(plan.join(first, plan["source"].eqNullSafe(first["source"])).select(plan["source"], "rest", "_b1", "base"), "mix-cut")

    def inside(rows: DataFrame, cut: DataFrame, *keys: str) -> DataFrame:
        """Rows that a cut's keys name, with what else the cut tells."""
        same = F.col("r.source").eqNullSafe(F.col("c.source"))
        for k in keys:
            same &= F.col(f"r.{k}") == F.col(f"c.{k}")
        return rows.alias("r").join(cut.alias("c"), same).select("r.*", *[F.col(f"c.{x}") for x in cut.columns if x not in ("source", *keys)])

    # rows of one hash have one text, so one size: they are told by their number from here on
    edge = inside(sized.withColumn("_b1", _digits(0, 3)), first, "_b1").groupBy("source", "_h", "rest").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("m"))
    edge = written(edge.withColumn("_b2", _digits(3, 3)), "mix-edge")
    hist2 = edge.groupBy("source", "_b2").agg(F.sum(F.col("size") * F.col("m")).alias("_n"))
    second = boundary(hist2, first.select("source", "rest", "base"), "_b2")
    last = inside(edge, second, "_b2")
    running = Window.partitionBy("source").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_before", F.coalesce(F.sum(F.col("size") * F.col("m")).over(running), F.lit(0)) + F.col("base"))
    left = F.col("rest") - F.col("_before")
    # the j-th row of a hash is taken if 2 * before + size <= 2 * rest, before being (j - 1) * size more
    fit = F.when(F.col("size") == 0, F.when(left >= 0, F.col("m")).otherwise(0)).otherwise(F.floor((2 * left - F.col("size")) / (2 * F.col("size"))) + 1)
    last = last.withColumn("_fit", F.greatest(F.lit(0), F.least(F.col("m"), fit)).cast("long"))
    cut = last.groupBy("source").agg(F.max(F.when(F.col("_fit") > 0, F.struct("_h", "_fit", "m"))).alias("c"), F.min("_h").alias("least"))
    # nothing of the last bucket fits: cut before its first row
    cut = cut.select("source", F.coalesce("c._h", "least").alias("_h"), F.coalesce("c._fit", F.lit(0)).alias("_fit"), F.coalesce("c.m", F.lit(0)).alias("m"))
    cut = written(cut, "mix-cut")

    # a hash that is cut: the places of its rows, by partition, then within one
    runs = written(inside(sized, cut.where("_fit < m").drop("m"), "_h").select("source", "_o", F.shiftright("_o", 33).alias("_p"), "_fit"), "mix-run")
    parts = runs.groupBy("source", "_p", "_fit").count()
    parts = parts.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.where("_before < _fit and _fit <= _before + count").select("source", "_p", (F.col("_fit") - F.col("_before")).alias("_k"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("_o"))
    ends = inside(runs, parts, "_p").withColumn("_place", place).where("_place = _k").select("source", F.col("_o").alias("cut_o"))
    cut = cut.alias("a").join(ends.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    cut = cut.select("a.source", F.col("_h").alias("cut_h"), F.when(F.col("_fit") == 0, F.lit(-1)).otherwise(F.coalesce("cut_o", F.lit((1 << 63) - 1))).alias("cut_o"))
    out = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    return out.select("p.source", "source_size", "target", "whole", "cut_h", "cut_o")


def _sized(docs: DataFrame, *columns) -> DataFrame:
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    return docs.select("source", "doc_id", word_count(F.col("text")).alias("size"), F.md5(key.cast("binary")).alias("_h"), F.monotonically_increasing_id().alias("_o"), *columns)


def _taken(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """sized with source_size, target and copies: how often the mix takes a row."""
    below = (F.col("_h") < F.col("cut_h")) | ((F.col("_h") == F.col("cut_h")) & (F.col("_o") <= F.col("cut_o")))
    copies = F.col("whole") + F.when(below, 1).otherwise(0)
    out = sized.alias("d").join(cut.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    return out.select("d.*", "t.source_size", "t.target", copies.cast("long").alias("copies")).drop("_h", "_o")


def _decided(sized: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """sized, written so that its rows keep their places, and the cuts of its sources."""
    sized = written(sized, "mix-rows", stays=1)
    return sized, written(thresholds(sized, weights, most), "mix-thresholds", stays=1)


def assignments(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of docs: source, doc_id, size, source_size, target, copies, taken."""
    with scratch(docs.sparkSession):
        sized, cut = _decided(_sized(docs), weights, most)
    return _taken(sized, cut).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with the columns of docs."""
    row = F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    with scratch(docs.sparkSession):
        sized, cut = _decided(_sized(docs, row.alias("_row")), weights, most)
    out = _taken(sized, cut).where("copies > 0")
    out = out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return assignments(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
