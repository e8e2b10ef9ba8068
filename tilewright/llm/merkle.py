"""A Merkle manifest of a dataset: one root, and for each row a proof that it belongs to it.

A row's leaf is the SHA-256 of its fields. Leaves of a group (a value of `lang`) ascend by id and form
a tree of fanout 8; the groups' roots, in order of the group, form another with the same rule. A node
is the SHA-256 of its children's hexadecimal digests; a last run may be shorter, even one child.

Rows are range-partitioned by group, id and leaf; a row's index in its group is its place in the
partition and the counts of the partitions before, so nothing larger than a count goes anywhere.
From there on rows travel as 32-byte digests in aligned blocks of 8^LEVELS indexes. In a task, a
block is a contiguous matrix of 64 hexadecimal bytes a row; a level is made by reshaping it to rows of
8 digests and hashing each. The blocks' tops are the indexes of the next round, so rounds are as many
as log(rows) to the base 8^LEVELS. On the way down each block gets the siblings above it (a few
hundred bytes a level, one row a block), and index arithmetic finds those inside it: the run of
index i at a level is i // 8, the siblings are its others. What is kept is hashed, never the proofs.

Defined results: a null field is "-"; a null id is before any other; rows that repeat an id ascend by
leaf; rows equal in all fields have equal leaves and a place each; a null group is one of its own and
comes first; a group with one row has its leaf as root, a table with one group that group's root; a proof
without siblings is the hash of nothing; rows with a null id are never tampered with; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import prefix_sums, scratch, table, written

FANOUT, LEVELS = 8, 4
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = """
WITH RECURSIVE crc AS (  -- the table of CRC-32, from its polynomial
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
f AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS i_, CAST(n_chars AS VARCHAR) AS n_,
         CASE WHEN doc_id IS NOT NULL AND mod(crc32_, 3) = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc32_
    FROM documents CROSS JOIN crc)),
e AS (
  SELECT doc_id, lang,
         CASE WHEN i_ IS NULL THEN '-' ELSE strlen(i_) || ':' || i_ END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_ IS NULL THEN '-' ELSE strlen(n_) || ':' || n_ END AS head, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body, CASE WHEN other IS NULL THEN '-' ELSE strlen(other) || ':' || other END AS other FROM f),
h AS (SELECT doc_id, lang, sha256(head || body) AS leaf, sha256(head || other) AS tampered FROM e),
l AS (
  SELECT doc_id, leaf, tampered, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h),
up AS (
  SELECT g, 0 AS level, i, n, leaf AS d FROM l
  UNION ALL
  SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY g, level, i // 8, n),
s AS (SELECT g, max_by(d, level) AS subroot, max(level) AS height FROM up WHERE n = 1 GROUP BY g),
top AS (
  SELECT 0 AS level, g AS i, (SELECT count(*) FROM s) AS n, subroot AS d FROM s
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 8, n),
r AS (SELECT max_by(d, level) AS root, max(level) AS height FROM top),
nodes AS (  -- both trees as one: levels of the upper one go on from each group's height
  SELECT g, level, i, d FROM up WHERE n > 1
  UNION ALL SELECT s.g, s.height + top.level, top.i, top.d FROM s CROSS JOIN top WHERE top.n > 1),
steps AS (
  SELECT l.g, l.i, l.tampered, k.level, CASE WHEN k.level < s.height THEN l.i // CAST(pow(8, k.level) AS BIGINT) ELSE l.g // CAST(pow(8, k.level - s.height) AS BIGINT) END AS own
  FROM l JOIN s USING (g) CROSS JOIN r CROSS JOIN range(40) k(level) WHERE k.level < s.height + r.height),
proofs AS (
  SELECT p.g, p.i, string_agg(x.d, '' ORDER BY p.level, x.i) FILTER (WHERE x.i <> p.own) AS sides
  FROM steps p JOIN nodes x ON x.g = p.g AND x.level = p.level AND x.i // 8 = p.own // 8 GROUP BY p.g, p.i),
fold AS (
  SELECT g, i, 0 AS level, tampered AS d FROM l
  UNION ALL
  SELECT f.g, f.i, f.level + 1, sha256(string_agg(CASE WHEN x.i = p.own THEN f.d ELSE x.d END, '' ORDER BY x.i))
  FROM fold f JOIN steps p ON p.g = f.g AND p.i = f.i AND p.level = f.level JOIN nodes x ON x.g = p.g AND x.level = p.level AND x.i // 8 = p.own // 8
  GROUP BY f.g, f.i, f.level),
ends AS (SELECT g, i, max_by(d, level) AS folded FROM fold GROUP BY g, i)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.sides, '')) AS proof_sha256, ends.folded AS folded_root, ends.folded = r.root AS verified
FROM l JOIN s USING (g) CROSS JOIN r LEFT JOIN proofs p ON p.g = l.g AND p.i = l.i JOIN ends ON ends.g = l.g AND ends.i = l.i
"""


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row, as 32 bytes; text: what to take for its text."""
    values = [F.col(c) if c != "text" or text is None else text for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*map(_field, values)).cast("binary"), 256))


def _hexed(digests) -> np.ndarray:
    """Digests of 32 bytes as a matrix of 64 hexadecimal bytes a row."""
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, HEX // 2)
    signs = np.frombuffer(b"0123456789abcdef", np.uint8)
    out = np.empty((len(raw), HEX), np.uint8)
    out[:, 0::2], out[:, 1::2] = signs[raw >> 4], signs[raw & 15]
    return out


def _level_up(nodes: np.ndarray) -> np.ndarray:
    """Hash each run of FANOUT rows."""
    whole = len(nodes) // FANOUT
    runs = [r.tobytes() for r in nodes[: whole * FANOUT].reshape(whole, FANOUT * HEX)]
    if len(nodes) % FANOUT:
        runs.append(nodes[whole * FANOUT :].tobytes())
    return _hexed([hashlib.sha256(r).digest() for r in runs])


def levels_of(nodes: np.ndarray, n: int, levels: int) -> list[np.ndarray]:
    """The matrices of a block from its indexes to its top; n: how many its whole sequence has."""
    out = [nodes]
    for _ in range(levels):
        if n <= 1:
            break
        out.append(_level_up(out[-1]))
        n = -(-n // FANOUT)
    return out


def _raised(nodes: DataFrame, levels: int) -> DataFrame:
    """From (seq, i, n, d) to the tops of aligned blocks, as (seq, i, n, d) of the next round."""
    size = FANOUT**levels

    def run(key, rows):
        import pyarrow as pa

        rows = rows.sort_by("i")
        n = rows.column("n")[0].as_py()
        top = levels_of(_hexed(rows.column("d").to_pylist()), n, levels)[-1]
        n = -(-n // size)
        return pa.table({"seq": [key[0].as_py()], "i": [key[1].as_py()], "n": [n], "d": [bytes.fromhex(top[0].tobytes().decode())]})

    blocks = nodes.select("seq", (F.col("i") / size).cast("long").alias("block"), "i", "n", "d")
    return blocks.groupBy("seq", "block").applyInArrow(run, "seq long, i long, n long, d binary")


def _lowered(nodes: DataFrame, above: DataFrame, levels: int, columns: str, leaves: bool) -> DataFrame:
    """Carry the siblings above each block (seq, i, path) down to its indexes.

    path is, level by level, the place in the run, the run's length and its digests (the own one too,
    which folding replaces). leaves: give the results of rows instead of paths.
    """
    size = FANOUT**levels

    def run(key, rows, up):
        import pyarrow as pa

        rows = rows.sort_by("i")
        n, first = rows.column("n")[0].as_py(), key[1].as_py() * size
        matrices = levels_of(_hexed(rows.column("d").to_pylist()), n, levels)
        above_it = _unpacked(up.column("path")[0].as_py())
        steps = []
        for i in range(rows.num_rows):
            mine = []
            for m in matrices[:-1]:
                mine.append((i % FANOUT, m[i // FANOUT * FANOUT : i // FANOUT * FANOUT + FANOUT].tobytes()))
                i //= FANOUT
            steps.append(mine)
        if not leaves:
            return pa.table({"seq": rows.column("seq"), "i": rows.column("i"), "path": pa.array([_packed(s + above_it) for s in steps], pa.binary())})
        tampered = rows.column("tampered").to_pylist()
        out = []
        for k, s in enumerate(steps):
            proof, d = hashlib.sha256(), (tampered[k] or rows.column("d")[k].as_py()).hex().encode()
            for at, digests in s + above_it:
                left, right = digests[: at * HEX], digests[at * HEX + HEX :]
                proof.update(left + right)
                d = hashlib.sha256(left + d + right).hexdigest().encode()
            out.append((proof.hexdigest(), d.decode()))
        proofs, folded = zip(*out, strict=True)
        leaf_hex = [x.as_py().hex() for x in rows.column("d")]
        subroot, root = up.column("subroot")[0].as_py().hex(), up.column("root")[0].as_py().hex()
        return pa.table({
            "doc_id": rows.column("doc_id"), "leaf": leaf_hex, "subroot": [subroot] * len(out), "root": [root] * len(out),
            "proof_sha256": list(proofs), "folded_root": list(folded), "verified": [f == root for f in folded],
        })

    blocks = nodes.withColumn("block", (F.col("i") / size).cast("long"))
    return blocks.groupBy("seq", "block").cogroup(above.withColumn("block", F.col("i")).groupBy("seq", "block")).applyInArrow(run, columns)


def _packed(steps: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([at, len(d) // HEX]) + bytes.fromhex(d.decode()) for at, d in steps)


def _unpacked(path: bytes) -> list[tuple[int, bytes]]:
    out, k = [], 0
    while k < len(path):
        end = k + 2 + path[k + 1] * HEX // 2
        out.append((path[k], path[k + 2 : end].hex().encode()))
        k = end
    return out


def _tops(nodes: DataFrame, most: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of nodes, and (seq, d) of the sequences' roots. most: the longest sequence."""
    rounds = [nodes]
    while True:
        rounds.append(written(_raised(rounds[-1], levels), "merkle-round"))
        most = -(-most // FANOUT**levels)
        if most <= 1:
            return rounds, rounds[-1].select("seq", "d")


def indexed(docs: DataFrame, tampered: Column) -> tuple[DataFrame, DataFrame]:
    """Leaves with their group's number and their index in it, and (lang, n, seq) of the groups."""
    changed = F.translate(F.col("text"), UPPER, LOWER)
    rows = docs.select(F.col("doc_id").cast("long"), "lang", leaf().alias("d"), F.when(tampered, leaf(changed)).alias("tampered"), F.monotonically_increasing_id().alias("_o"))
    rows = written(rows, "merkle-leaves")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("d").asc(), F.col("_o").asc()]  # equal rows may lie in any order
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_o")
    ranged = written(ranged.withColumn("_part", F.shiftright(at, 33)).withColumn("_place", at.bitwiseAND((1 << 33) - 1)), "merkle-ranged")
    counts = written(ranged.groupBy("lang", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")), "merkle-counts")
    groups = counts.groupBy("lang").agg(F.sum("_n").alias("n"))
    groups = written(prefix_sums(groups, [F.col("lang").asc_nulls_first()], {"seq": F.lit(1).cast("long")}), "merkle-groups")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("lang", "_part", (before - F.col("_first")).alias("_base"))
    base = base.alias("b").join(groups.alias("g"), F.col("b.lang").eqNullSafe(F.col("g.lang"))).select("g.seq", "g.n", "b.lang", "_part", "_base")
    same = F.col("r.lang").eqNullSafe(F.col("b.lang")) & (F.col("r._part") == F.col("b._part"))
    out = ranged.alias("r").join(base.alias("b"), same)
    return out.select("seq", (F.col("_place") + F.col("_base")).alias("i"), "n", "d", "doc_id", "tampered"), groups


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    folded_root is what the proof gives for the row as it is found: where `tampered` holds, with its
    text in lower case.
    """
    columns = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    with scratch(docs.sparkSession):
        leaves, groups = indexed(docs, F.lit(False) if tampered is None else tampered)
        leaves = written(leaves, "merkle-indexed", stays=1)
        sizes = groups.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("groups")).first()
        if not sizes["groups"]:
            return docs.sparkSession.createDataFrame([], columns)
        rounds, subroots = _tops(leaves.select("seq", "i", "n", "d"), sizes["most"], levels)
        upper = subroots.select(F.lit(0).cast("long").alias("seq"), F.col("seq").alias("i"), F.lit(sizes["groups"]).cast("long").alias("n"), "d")
        upper_rounds, root = _tops(written(upper, "merkle-subroots"), sizes["groups"], levels)
        path = root.select("seq", F.lit(0).cast("long").alias("i"), F.lit(b"").alias("path"))
        for r in reversed(upper_rounds[:-1]):
            path = written(_lowered(r, path, levels, "seq long, i long, path binary", False), "merkle-path")
        path = path.select(F.col("i").alias("seq"), F.lit(0).cast("long").alias("i"), "path")
        for r in reversed(rounds[1:-1]):
            path = written(_lowered(r, path, levels, "seq long, i long, path binary", False), "merkle-path")
        ends = subroots.withColumnRenamed("d", "subroot").crossJoin(F.broadcast(root.select(F.col("d").alias("root"))))  # one root
        above = written(path.join(ends, "seq"), "merkle-above", stays=1)
    return _lowered(leaves, above, levels, columns, True)


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered)
