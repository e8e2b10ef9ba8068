"""Connected components of (a, b) edges of longs, whatever their number.

Each round first contracts the edges of a task by union-find (a task holds at most `per_task`
edges, and as many tasks run as that needs), which leaves stars; if all edges are one task's, that
is the answer. Else a large-star and a small-star step follow, which join the stars of different
tasks, until nothing changes. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import written

PER_TASK = 2_000_000
EDGES = "u long, v long"


def _contract(batches):
    import numpy as np
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter(map(find, list(parent)), np.int64, len(parent))
    keep = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: each greater neighbour to the least one; small: each lesser."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """From edges (a, b) to (node, root): each node that an edge names, with the least of its component."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges = written(edges.distinct(), "edges")
    before = None
    while True:
        tasks = -(-max(1, edges.count()) // per_task)
        stars = written(edges.repartition(tasks, "v").mapInArrow(_contract, EDGES) if tasks > 1 else edges.coalesce(1).mapInArrow(_contract, EDGES), "stars")
        if tasks == 1:
            break
        stars = written(_star(_star(stars, True), False), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, edges = now, stars
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
