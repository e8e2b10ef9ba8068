"""An image as baseline JPEG, for tiles that are written beside fetched ones; numpy over one tile."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The example quantisation tables of the JPEG standard, for luminance and for colour, by rows.
LUMINANCE = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
COLOUR = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""
#: Red, green and blue to luminance and the two colour differences. Fixed values of the format.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
#: Places of a block by diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
DCT = np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]


def quantisation(quality: int) -> list[np.ndarray]:
    scale = 200 - 2 * quality if quality >= 50 else 5000 // quality
    return [np.clip((np.array(t.split(), int) * scale + 50) // 100, 1, 255) for t in (LUMINANCE, COLOUR)]


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths of a prefix code of at most 16 bits; one more symbol, the rarest, keeps the code of all ones free."""
    while True:
        heap = [(int(c), s, (s,)) for s, c in enumerate(counts) if c] + [(0, len(counts), (len(counts),))]
        heapq.heapify(heap)
        depth = {s: 0 for _, s, _ in heap}
        while len(heap) > 1:
            (a, i, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            for s in left + right:
                depth[s] += 1
            heapq.heappush(heap, (a + b, i, left + right))
        if max(depth.values()) <= 16:
            return depth
        counts = (counts + 1) // 2


def _table(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as it stands in the file, and codes and lengths by symbol."""
    depth = code_lengths(counts)
    order = sorted(depth, key=lambda s: (depth[s], s))
    codes, lengths = np.zeros(len(counts) + 1, np.int64), np.zeros(len(counts) + 1, np.int64)
    code, last = 0, depth[order[0]]
    for s in order:
        code <<= depth[s] - last
        codes[s], lengths[s], last = code, depth[s], depth[s]
        code += 1
    kept = [s for s in order if s < len(counts)]
    sizes = np.bincount([depth[s] for s in kept], minlength=17)[1:]
    return bytes(sizes.tolist()) + bytes(kept), codes, lengths


def coefficients(rgb: np.ndarray, quality: int) -> np.ndarray:
    """Quantised coefficients in zigzag order, (block, component, 64); edges are repeated up to whole blocks."""
    h, w = rgb.shape[:2]
    a = np.pad(rgb, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") @ TO_YCC.T - [128, 0, 0]
    a = a.reshape(a.shape[0] // 8, 8, a.shape[1] // 8, 8, 3).transpose(0, 2, 4, 1, 3)
    a = (DCT @ a @ DCT.T).reshape(-1, 3, 64)
    light, colour = quantisation(quality)
    return np.rint(a / np.stack([light, colour, colour])).astype(np.int64)[..., ZIGZAG]


def _tokens(c: np.ndarray):
    """Symbols of all blocks in the scan's order: (table, symbol, bits that follow, their number)."""
    c = c.copy()
    c[1:, :, 0] -= c[:-1, :, 0].copy()
    flat = c.reshape(-1, 64)
    part = np.arange(len(flat)) % 3 > 0
    block, place = np.nonzero(flat[:, 1:])
    place = place + 1
    before = np.where(np.diff(block, prepend=-1) != 0, 0, np.roll(place, 1))
    run = place - before - 1
    last = np.zeros(len(flat), int)
    np.maximum.at(last, block, place)
    long, ends = np.repeat(np.arange(len(block)), run // 16), np.flatnonzero(last < 63)
    size = lambda v: np.frexp(np.abs(v).astype(float))[1].astype(np.int64)
    dc, ac = flat[:, 0], flat[block, place]
    kinds = [  # block, place, order at the place, whether AC, symbol, value
        (np.arange(len(flat)), 0 * dc, 0, 0, size(dc), dc),
        (block[long], place[long], 0, 1, 0 * long + 0xF0, 0 * long),
        (block, place, 1, 1, run % 16 * 16 + size(ac), ac),
        (ends, 0 * ends + 64, 0, 1, 0 * ends, 0 * ends),
    ]
    at, where, order, is_ac, symbol, value = (np.concatenate([np.broadcast_to(k[i], len(k[0])) for k in kinds]) for i in range(6))
    by = np.lexsort((order, where, at))
    bits = size(value)
    follow = np.where(value < 0, value + (1 << bits) - 1, value)
    return (part[at] * 2 + is_ac)[by], symbol[by], follow[by], bits[by]


def jpeg(rgb: np.ndarray, quality: int = 90) -> bytes:
    """An RGB image as baseline JPEG, colours not thinned, with codes made for it."""
    h, w = rgb.shape[:2]
    table, symbol, follow, bits = _tokens(coefficients(rgb, quality))
    made = [_table(np.bincount(symbol[table == t], minlength=256)) for t in range(4)]
    code = np.stack([m[1] for m in made])[table, symbol]
    length = np.stack([m[2] for m in made])[table, symbol]
    word, size = code << bits | follow, length + bits
    token = np.repeat(np.arange(len(word)), size)
    place = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(token))
    stream = (word[token] >> place & 1).astype(np.uint8)
    scan = np.packbits(np.append(stream, np.ones(-len(stream) % 8, np.uint8))).tobytes().replace(b"\xff", b"\xff\x00")

    def segment(kind: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body

    tables = b"".join(bytes([k]) + bytes(q[ZIGZAG].tolist()) for k, q in enumerate(quantisation(quality)))
    codes = b"".join(bytes([t % 2 * 16 + t // 2]) + made[t][0] for t in range(4))
    frame = struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])
    start = bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])
    head = segment(0xE0, b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0]))
    return b"\xff\xd8" + head + segment(0xDB, tables) + segment(0xC0, frame) + segment(0xC4, codes) + segment(0xDA, start) + scan + b"\xff\xd9"
