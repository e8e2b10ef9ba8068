"""Colours: RGB 565, tone curves as look-up tables, correction of a pixel."""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.grid import col


def pack565(r, g, b) -> Column:
    sh = lambda c, n: F.shiftright(col(c).cast("int"), n)
    return (F.shiftleft(sh(r, 3), 11) + F.shiftleft(sh(g, 2), 5) + sh(b, 3)).cast("long")


def unpack565(v) -> tuple[Column, Column, Column]:
    v = col(v).cast("int")
    five = lambda x: (F.shiftleft(x, 3).bitwiseOR(F.shiftright(x, 2))).cast("long")
    six = lambda x: (F.shiftleft(x, 2).bitwiseOR(F.shiftright(x, 4))).cast("long")
    return five(F.shiftright(v, 11).bitwiseAND(31)), six(F.shiftright(v, 5).bitwiseAND(63)), five(v.bitwiseAND(31))


#: The measured tone curve, what is written for each source value. It is no gamma and falls in two places (after 208 and 225).
TONE = [
    0, 10, 11, 11, 12, 13, 13, 15, 18, 20, 22, 24, 24, 26, 27, 28,
    30, 30, 32, 35, 36, 38, 40, 42, 43, 44, 47, 48, 50, 52, 52, 55,
    56, 58, 60, 60, 63, 64, 65, 67, 69, 70, 72, 73, 75, 76, 77, 79,
    80, 81, 83, 85, 86, 87, 89, 89, 91, 93, 94, 95, 97, 97, 99, 101,
    102, 103, 104, 105, 107, 108, 109, 111, 112, 113, 113, 115, 117, 118, 119, 120,
    121, 121, 124, 125, 126, 127, 128, 129, 130, 131, 133, 134, 135, 136, 137, 138,
    139, 140, 141, 142, 143, 144, 145, 146, 147, 147, 149, 150, 151, 152, 153, 154,
    155, 156, 157, 158, 159, 160, 161, 162, 163, 164, 165, 165, 166, 167, 168, 169,
    170, 171, 172, 173, 173, 174, 176, 176, 177, 178, 179, 179, 180, 181, 183, 184,
    185, 185, 187, 187, 189, 189, 190, 191, 192, 193, 194, 194, 194, 196, 197, 197,
    197, 199, 200, 200, 200, 202, 202, 202, 203, 204, 205, 205, 206, 207, 207, 208,
    209, 209, 210, 211, 212, 212, 214, 214, 214, 216, 217, 217, 217, 218, 218, 219,
    220, 220, 221, 222, 222, 223, 223, 224, 225, 225, 226, 227, 227, 228, 228, 229,
    231, 230, 231, 232, 232, 233, 233, 234, 235, 235, 236, 237, 237, 237, 239, 239,
    240, 242, 241, 243, 243, 243, 243, 245, 245, 245, 247, 247, 247, 247, 247, 247,
    247, 247, 247, 247, 247, 247, 247, 247, 247, 247, 247, 247, 247, 247, 247, 247,
]


def curve() -> list[int]:
    """The tone curve of textures; what takes a curve takes any table of 256 entries."""
    return list(TONE)


def apply_curve(v, table: list[int]) -> Column:
    return F.element_at(F.lit(table), col(v).cast("int") + 1).cast("long")


def inverse_curve(table: list[int]) -> list[float]:
    """For each output the input, by linear interpolation between the entries of a table.

    Where a table falls, its running maximum is taken; where it stays, its last place is; outputs beyond
    the ends have the ends.
    """
    rising = list(itertools.accumulate(table, max))
    out = []
    for y in range(256):
        k = max(0, bisect.bisect_right(rising, y) - 1)
        out.append(float(k) if k == 255 or y <= rising[k] else k + (y - rising[k]) / (rising[k + 1] - rising[k]))
    return out


def corrected(v, scale, offset) -> Column:
    """clamp(v * scale + offset) with +0.5 truncation, in single precision."""
    x = col(v).cast("float") * col(scale).cast("float") + col(offset).cast("float")
    return F.least(F.greatest(x + F.lit(0.5).cast("float"), F.lit(0.0).cast("float")), F.lit(255.0).cast("float")).cast("int").cast("long")


def is_black(r, g, b, most: int = 4) -> Column:
    return (col(r) <= most) & (col(g) <= most) & (col(b) <= most)


def is_water(r, g, b, have=True) -> Column:
    return (F.greatest(col(r), col(g), col(b)) < 120) & (col(b) >= col(g) - 10) & (col(b) >= col(r)) & col(have)
