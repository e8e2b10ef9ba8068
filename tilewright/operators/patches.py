"""Patches of a mosaic: overlays, offsets at full resolution, saved state.

Labels are found on a mosaic reduced SCALE times, offsets go to images of full size. corrected() brings the two
together block by block: a block gets its own cells. Where two labels meet, the border is moved to the
strongest step of colour near it, told from the mean profile of a whole run; a run may span blocks, so
each block gives its part of the sums, and what the runs moved comes back to blocks as overrides. No image
is ever whole in a task.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.session import stored

STATE = "version INT, clicks ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE, tol: DOUBLE>>"


def overlay(labels: DataFrame, label: int) -> DataFrame:
    """Pixels of a label, half white, with its outline: those that lack an equal neighbour on some side."""
    across, down = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")

    def same(w, f, c):
        return F.coalesce((f("label").over(w) == F.col("label")) & (F.abs(f(c).over(w) - F.col(c)) == 1), F.lit(False))

    inner = same(across, F.lag, "x") & same(across, F.lead, "x") & same(down, F.lag, "y") & same(down, F.lead, "y")
    t = labels.withColumn("outline", ~inner)
    return t.where(F.col("label") == label).select("y", "x", F.floor((F.col("r") + 255) / 2).cast("long").alias("r"), "outline")


def apply_offsets(pixels: DataFrame, labels: DataFrame, offsets: DataFrame, scale: int) -> DataFrame:
    """Add each label's offset (dr, dg, db) to its pixels; exact black stays. labels are at 1/scale."""
    t = pixels.withColumn("my", F.floor(F.col("y") / scale)).withColumn("mx", F.floor(F.col("x") / scale))
    t = t.join(labels, ["my", "mx"], "left").join(offsets, "label", "left")
    black = (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)
    new = lambda c: F.when(black, F.col(c)).otherwise(F.least(F.greatest(F.col(c) + F.coalesce(f"d{c}", F.lit(0)), F.lit(0)), F.lit(255)))
    return t.select("y", "x", *[new(c).alias(f"_{c}") for c in "rgb"]).select("y", "x", *[F.col(f"_{c}").alias(c) for c in "rgb"])


def clicks(state: Column) -> Column:
    """An array of clicks from saved JSON; null for text that is no state."""
    return F.from_json(state, STATE)["clicks"]


def state(clicks_: Column) -> Column:
    return F.to_json(F.struct(F.lit(1).alias("version"), clicks_.alias("clicks")))


#: Cells are SCALE pixels; how far a border may move, what is left out at a run's ends, its least length after that, the least step.
SCALE, REACH, TRIM, LEAST_RUN, LEAST_STEP = 16, 24, 8, 4, 4.0
ARM = 4


def border_runs(cells: DataFrame) -> DataFrame:
    """Where labels of cells (image, my, mx, label; 0 or none: terrain) meet.

    Rows: image, axis (x: a border between columns, y: between rows), at (the cell before it), from_ and to
    (cells along it, to not included), before and after (labels). A run ends where the pair of labels changes.
    """
    out = None
    for axis, along, across in (("x", "my", "mx"), ("y", "mx", "my")):
        here = cells.select("image", F.col(along).alias("k"), F.col(across).alias("at"), F.col("label").alias("before"))
        there = cells.select("image", F.col(along).alias("k"), (F.col(across) - 1).alias("at"), F.col("label").alias("after"))
        met = here.join(there, ["image", "k", "at"], "full").select("image", "k", "at", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
        met = met.where((F.col("before") != F.col("after")) & (F.col("at") >= 0))
        w = Window.partitionBy("image", "at", "before", "after").orderBy("k")
        met = met.withColumn("_g", F.col("k") - F.row_number().over(w))
        runs = met.groupBy("image", "at", "before", "after", "_g").agg(F.min("k").alias("from_"), (F.max("k") + 1).alias("to")).drop("_g").withColumn("axis", F.lit(axis))
        out = runs if out is None else out.unionByName(runs)
    return out.select("image", "axis", "at", "from_", "to", "before", "after")


def _strips(runs: DataFrame, side: int) -> DataFrame:
    """For each block that a run's strip of pixels touches the strip's part in the image: image, by, bx, and the run."""
    nominal = (F.col("at") + 1) * SCALE
    t = runs.withColumns({
        "a0": F.col("from_") * SCALE + TRIM, "a1": F.least(F.col("to") * SCALE, F.when(F.col("axis") == "x", F.col("height")).otherwise(F.col("width"))) - TRIM,
        "c0": F.greatest(nominal - REACH - ARM, F.lit(0)), "c1": F.least(nominal + REACH + ARM, F.when(F.col("axis") == "x", F.col("width")).otherwise(F.col("height"))),
    })
    t = t.where((F.col("a1") - F.col("a0") >= LEAST_RUN) & (F.col("c1") - F.col("c0") >= 4 * ARM))
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor((F.col(b) - 1) / side)))
    t = t.withColumn("_along", blocks("a0", "a1")).withColumn("_across", blocks("c0", "c1"))
    along_x = F.col("axis") == "x"
    return t.withColumns({"by": F.when(along_x, F.col("_along")).otherwise(F.col("_across")), "bx": F.when(along_x, F.col("_across")).otherwise(F.col("_along"))})


def moved(runs: DataFrame, blocks: DataFrame, side: int) -> DataFrame:
    """runs (of border_runs, with height and width of their image) with `to_px`: where the border goes, in pixels.

    blocks: image, by, bx, rows, cols, rgb; those of an image are side pixels square but for the last ones.
    """
    run = ["axis", "at", "from_", "to", "before", "after"]
    asked = _strips(runs, side).groupBy("image", "by", "bx").agg(F.collect_list(F.struct(*run, "a0", "a1", "c0", "c1")).alias("strips"))  # as many as a block has cells at most

    def sums(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a = np.frombuffer(r.rgb, np.uint8).reshape(r.rows, r.cols, 3)
                for s in r.strips:
                    p = a if s["axis"] == "x" else a.transpose(1, 0, 2)
                    u0, v0 = (r.by * side, r.bx * side) if s["axis"] == "x" else (r.bx * side, r.by * side)
                    rows = slice(max(s["a0"] - u0, 0), max(min(s["a1"] - u0, len(p)), 0))
                    first, last = max(s["c0"] - v0, 0), max(min(s["c1"] - v0, p.shape[1]), 0)
                    total = p[rows, first:last].astype(np.int64).sum(0)
                    n = max(rows.stop - rows.start, 0)
                    out += [(r.image, *[s[k] for k in run], v0 + c, n, *map(int, total[c - first])) for c in range(first, last) if n]
            yield type(pdf)(out, columns=["image", *run, "c", "n", "r", "g", "b"])

    kinds = dict(runs.dtypes)
    schema = ", ".join([f"image {kinds['image']}", *[f"{k} {kinds[k]}" for k in run]])
    parts = asked.join(blocks, ["image", "by", "bx"]).mapInPandas(sums, f"{schema}, c long, n long, r long, g long, b long")
    profile = parts.groupBy("image", *run, "c").agg(*[(F.sum(k) / F.sum("n")).alias(k) for k in "rgb"])

    def best(pdf):
        pdf = pdf.sort_values("c")
        c, v = pdf["c"].to_numpy(), pdf[["r", "g", "b"]].to_numpy()
        nominal, lo = (int(pdf["at"].iloc[0]) + 1) * SCALE, int(c[0])
        most, place = 0.0, nominal
        for k in range(max(nominal - REACH, lo + ARM), min(nominal + REACH, int(c[-1]) + 1 - ARM) + 1):
            step = float(np.linalg.norm(v[k - lo : k - lo + ARM].mean(0) - v[k - lo - ARM : k - lo].mean(0)))
            if step > most:
                most, place = step, k
        return pdf.iloc[:1][["image", *run]].assign(to_px=place if most >= LEAST_STEP else nominal)

    found = profile.groupBy("image", *run).applyInPandas(best, f"{schema}, to_px long")
    return runs.join(found, ["image", *run], "left").withColumn("to_px", F.coalesce("to_px", (F.col("at") + 1) * SCALE))


def corrected(blocks: DataFrame, cells: DataFrame, offsets: DataFrame, sizes: DataFrame, side: int) -> DataFrame:
    """Blocks (image, by, bx, rows, cols, rgb) with each label's offset (label, dr, dg, db) added; exact black stays.

    cells: image, my, mx, label (above 0). sizes: image, height, width. Only blocks that a label, or a border that
    was moved, reaches are changed; rows come back with `changed`, their changed pixels. side is a multiple of SCALE.
    """
    runs = moved(stored(border_runs(cells).join(sizes, "image"), "border-runs"), blocks, side)
    low, high = F.least((F.col("at") + 1) * SCALE, F.col("to_px")), F.greatest((F.col("at") + 1) * SCALE, F.col("to_px"))
    shifts = runs.withColumns({"c0": low, "c1": high, "a0": F.col("from_") * SCALE, "a1": F.col("to") * SCALE}).where("c0 < c1")
    shifts = shifts.withColumn("label", F.when(F.col("to_px") < (F.col("at") + 1) * SCALE, F.col("after")).otherwise(F.col("before")))
    spans = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor((F.col(b) - 1) / side)))
    shifts = shifts.withColumn("_along", spans("a0", "a1")).withColumn("_across", spans("c0", "c1"))
    x = F.col("axis") == "x"
    # borders between columns first, then those between rows; by their labels, place and beginning
    over = F.struct("axis", "before", "after", "at", "from_", "a0", "a1", "c0", "c1", "label")
    shifts = shifts.groupBy("image", F.when(x, F.col("_along")).otherwise(F.col("_across")).alias("by"), F.when(x, F.col("_across")).otherwise(F.col("_along")).alias("bx")).agg(F.sort_array(F.collect_list(over)).alias("over"))
    per = side // SCALE
    own = cells.groupBy("image", F.floor(F.col("my") / per).alias("by"), F.floor(F.col("mx") / per).alias("bx")).agg(F.collect_list(F.struct("my", "mx", "label")).alias("cells"))
    table = offsets.agg(F.map_from_entries(F.collect_list(F.struct("label", F.array("dr", "dg", "db")))).alias("offsets"))  # a row; labels are few, as clicks are
    t = blocks.join(own, ["image", "by", "bx"], "left").join(shifts, ["image", "by", "bx"], "left").crossJoin(F.broadcast(table))

    def run(batches):
        for pdf in batches:
            out, changed = [], []
            for r in pdf.itertuples():
                if r.cells is None and r.over is None:
                    out.append(r.rgb)
                    changed.append(0)
                    continue
                small = np.zeros((per, per), np.int64)
                for c in r.cells if r.cells is not None else ():
                    small[c["my"] - r.by * per, c["mx"] - r.bx * per] = c["label"]
                label = np.repeat(np.repeat(small, SCALE, 0), SCALE, 1)
                for o in r.over if r.over is not None else ():
                    at = label if o["axis"] == "x" else label.T
                    u0, v0 = (r.by * side, r.bx * side) if o["axis"] == "x" else (r.bx * side, r.by * side)
                    at[max(o["a0"] - u0, 0) : max(o["a1"] - u0, 0), max(o["c0"] - v0, 0) : max(o["c1"] - v0, 0)] = o["label"]
                label = label[: r.rows, : r.cols]
                steps = np.zeros((max(int(label.max()), *r.offsets, 0) + 1, 3), np.float32)
                for k, v in r.offsets.items():
                    steps[k] = v
                a = np.frombuffer(r.rgb, np.uint8).reshape(r.rows, r.cols, 3)
                new = np.clip(np.rint(a + steps[label]), 0, 255).astype(np.uint8)
                new[~a.any(2)] = 0
                out.append(new.tobytes())
                changed.append(int((new != a).any(2).sum()))
            yield pdf[["image", "by", "bx", "rows", "cols"]].assign(rgb=out, changed=changed)

    kind = dict(blocks.dtypes)
    return t.mapInPandas(run, f"image {kind['image']}, by long, bx long, rows int, cols int, rgb binary, changed long")
