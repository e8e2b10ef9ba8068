"""Media columns: baseline JPEG with bytes as quantised DCT coefficients, and its DC thumbnails.

A payload of n * 576 bytes becomes grey images of 8 x 8 blocks, 64 bytes in each as coefficients in
zigzag order (a byte b is b - 110, plus one from 0 on, so no coefficient is zero), quantisation
steps 1: nothing is lost. Nine blocks are a restart interval. An image has at most 65,528 rows; a
longer payload is a sequence of images.

The reader is a baseline decoder in numpy: it parses the markers, then decodes all restart intervals
of a scan side by side, one Huffman symbol of each at a time, with any number of components and
sampling factors (a scan without restarts is one interval). Luminance thumbnails take a pixel per
block from its DC coefficient.

Defined results: null text is the empty text; the smallest payload is one unit; rows that repeat an
id are rows each; extra columns are ignored; an empty table gives an empty result. Anything but
baseline or extended sequential 8-bit Huffman JPEG raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import slices, table

UNIT, BLOCKS = 576, 9
OFFSET = 110
MOST_UNITS = 65_528 // 24  # of an image three blocks wide
#: Huffman tables of the encoder: lengths of codes, and what they stand for.
DC_BITS, DC_VALUES = [0, 0, 0, 12], list(range(12))
AC_BITS, AC_VALUES = [0, 0, 0, 13], [*range(1, 11), 0xF0, 0x00, 0x11]


def zigzag(n: int = 8) -> np.ndarray:
    """Row-major places in zigzag order."""
    cells = sorted(((r, c) for r in range(n) for c in range(n)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([r * n + c for r, c in cells])


def codes(bits: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: value to (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(bits: list[int], values: list[int]) -> np.ndarray:
    """For each 16 bits ahead: length << 8 | value; 0 where no code fits."""
    table_ = np.zeros(1 << 16, np.int32)
    for value, (code, length) in codes(bits, values).items():
        table_[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | value
    return table_


def _code_arrays(bits, values):
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for v, (c, n) in codes(bits, values).items():
        code[v], length[v] = c, n
    return code, length


_DC, _AC = _code_arrays(DC_BITS, DC_VALUES), _code_arrays(AC_BITS, AC_VALUES)


def coefficients(payload: np.ndarray) -> np.ndarray:
    v = payload.astype(np.int64) - OFFSET
    return np.where(v >= 0, v + 1, v)


def scan_bytes(coefs: np.ndarray) -> list[bytes]:
    """Entropy-coded restart intervals, stuffed, for (intervals, blocks, 64) coefficients without zeros."""
    n = coefs.shape[0]
    v = coefs.copy()
    v[:, 1:, 0] -= coefs[:, :-1, 0]  # DC as differences within the interval
    flat = v.reshape(-1)
    size = np.zeros(len(flat), np.int64)
    magnitude = np.abs(flat)
    for k in range(11):
        size += magnitude >= 1 << k
    dc = np.zeros((v.shape[1], 64), bool)
    dc[:, 0] = True
    dc = np.tile(dc.reshape(-1), n)
    code = np.where(dc, _DC[0][size], _AC[0][size])
    length = np.where(dc, _DC[1][size], _AC[1][size]) + size
    word = code << size | np.where(flat < 0, flat + (1 << size) - 1, flat)
    per = length.reshape(n, -1)
    ends = np.cumsum(per, 1)
    total = -(-ends[:, -1] // 8)  # bytes of each interval; the rest of the last is ones
    first = np.concatenate([[0], np.cumsum(total)])
    at = (first[:-1, None] * 8 + ends - per).reshape(-1)
    # a word of up to 24 bits lies in four bytes from the one it begins in
    shifted = word << (32 - (at & 7) - length)
    out = np.zeros(int(first[-1]) + 4, np.uint8)
    byte = at >> 3
    for k in range(4):  # the bits of different words never meet, so a sum is an or
        part = (shifted >> (24 - 8 * k)) & 255
        out += np.bincount(byte + k, part, len(out)).astype(np.uint8)
    pad = (8 - ends[:, -1] % 8) % 8
    out[first[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    data = out[: int(first[-1])].tobytes()
    return [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _frame(units: int, intervals: list[bytes]) -> bytes:
    tables = _segment(0xDB, b"\x00" + b"\x01" * 64)
    for kind, bits, values in ((0x00, DC_BITS, DC_VALUES), (0x10, AC_BITS, AC_VALUES)):
        tables += _segment(0xC4, bytes([kind, *bits, *[0] * (16 - len(bits)), *values]))
    head = b"\xff\xd8" + tables + _segment(0xC0, struct.pack(">BHHB", 8, 24 * units, 24, 1) + b"\x01\x11\x00")
    head += _segment(0xDD, struct.pack(">H", BLOCKS)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    marked = [x + bytes([255, 0xD0 + k % 8]) for k, x in enumerate(intervals[:-1])]
    return head + b"".join(marked) + intervals[-1] + b"\xff\xd9"


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """JPEG bytes of payloads, each of a positive multiple of 576 bytes."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    intervals = scan_bytes(coefficients(data).reshape(-1, BLOCKS, 64))
    out, at = [], 0
    for p in payloads:
        units, images = len(p) // UNIT, []
        for a in range(0, units, MOST_UNITS):
            b = min(units, a + MOST_UNITS)
            images.append(_frame(b - a, intervals[at + a : at + b]))
        out.append(b"".join(images))
        at += units
    return out


@dataclass
class Image:
    """Markers of one image, and its scans' intervals (not yet decoded)."""

    width: int = 0
    height: int = 0
    components: list = None  # (id, h, v, quantisation table)
    quant: dict = None
    scan: list = None  # (component, dc bits and values, ac bits and values)
    restart: int = 0
    intervals: list = None


def parse(data: bytes) -> list[Image]:
    """The images of a JPEG sequence."""
    images, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG image")
        at += 2
        image, huff = Image(quant={}, intervals=[]), {}
        while True:
            if at + 2 > len(data) or data[at] != 255:
                raise ValueError("marker expected")
            marker = data[at + 1]
            at += 2
            if marker == 255:
                at -= 1
                continue
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at)[0]
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 64 * (1 + wide)
                    image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    bits = list(body[1:17])
                    n = sum(bits)
                    huff[body[0]] = (bits, list(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("8-bit samples only")
                image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("baseline only")
            elif marker == 0xDD:
                image.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                n = body[0]
                if n != len(image.components):
                    raise ValueError("one scan of all components only")
                image.scan = [(body[1 + 2 * k], huff[body[2 + 2 * k] >> 4], huff[0x10 | body[2 + 2 * k] & 15]) for k in range(n)]
                start = at
                while True:  # to the next marker that is neither stuffing nor a restart
                    k = data.find(b"\xff", at)
                    if k < 0 or k + 1 >= len(data):
                        raise ValueError("scan without an end")
                    if data[k + 1] == 0 or data[k + 1] == 255:
                        at = k + 1 + (data[k + 1] == 0)
                    elif 0xD0 <= data[k + 1] <= 0xD7:
                        image.intervals.append(data[start:k].replace(b"\xff\x00", b"\xff"))
                        start = at = k + 2
                    else:
                        image.intervals.append(data[start:k].replace(b"\xff\x00", b"\xff"))
                        at = k
                        break
        images.append(image)
    return images


def decode_intervals(intervals: list[bytes], blocks: np.ndarray, which: list[int], dc: list, ac: list) -> np.ndarray:
    """Coefficients (intervals, most blocks, 64) in zigzag order, DC resolved.

    blocks: of each interval; which: the component of each block of an MCU; dc, ac: lookup tables by
    component. All intervals advance together, one symbol each at a step.
    """
    lengths = np.array([len(x) for x in intervals])
    starts = np.concatenate([[0], np.cumsum(lengths + 8)])
    data = np.zeros(int(starts[-1]) + 8, np.uint8)
    joined = (b"\xff" * 8).join(intervals)
    data[: len(joined)] = np.frombuffer(joined, np.uint8)
    # 32 bits from each byte on
    wide = data.astype(np.int64)
    ahead = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    one = len(set(map(id, dc))) == 1 and len(set(map(id, ac))) == 1
    tables = np.concatenate([np.concatenate([d, a]) for d, a in zip(dc, ac, strict=True)]) if not one else np.concatenate([dc[0], ac[0]])
    n, most = len(intervals), int(blocks.max(initial=0))
    out = np.zeros(n * most * 64, np.int32)
    which_ = np.array(which)
    live = np.arange(n)
    bit, end = starts[:-1] * 8, (starts[:-1] + lengths) * 8
    base = live * most * 64
    k = np.zeros(n, np.int64)  # 64 * block + coefficient
    goal = blocks.astype(np.int64) * 64
    while len(live):
        place = k & 63
        is_ac = place > 0
        choice = is_ac.astype(np.int64) << 16
        if not one:
            choice += which_[(k >> 6) % len(which)] << 17
        word = ahead[bit >> 3]
        low = bit & 7
        entry = tables[choice + ((word >> (16 - low)) & 0xFFFF)]
        length, value = entry >> 8, entry & 255
        if not length.all():
            raise ValueError("no such Huffman code")
        run, size = value >> 4, value & 15
        after = bit + length
        ahead_ = ahead[after >> 3]
        raw = (ahead_ >> (32 - (after & 7) - size)) & ((1 << size) - 1)
        number = np.where(raw < (1 << size) >> 1, raw - (1 << size) + 1, raw)
        end_of_block = is_ac & (value == 0)
        skip = np.where(is_ac, run, 0)
        target = k + skip
        if (place + skip > 63).any():
            raise ValueError("run beyond its block")
        out[base + target] = np.where(end_of_block, 0, number)
        k = np.where(end_of_block, (k | 63) + 1, target + 1)
        bit = after + size
        if (bit > end).any():
            raise ValueError("interval too short")
        if (k == goal).any():
            on = k < goal
            live, bit, end, base, k, goal = live[on], bit[on], end[on], base[on], k[on], goal[on]
    out = out.reshape(n, most, 64)
    for c in set(which):
        mine = np.flatnonzero(which_[np.arange(most) % len(which)] == c)
        out[:, mine, 0] = np.cumsum(out[:, mine, 0], 1)
    return out


def layout(image: Image) -> tuple[list[int], int, int]:
    """The component of each block of an MCU, and MCUs across and down."""
    if len(image.components) == 1:
        return [0], -(-image.width // 8), -(-image.height // 8)
    h, v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    which = [k for k, c in enumerate(image.components) for _ in range(c[1] * c[2])]
    return which, -(-image.width // (8 * h)), -(-image.height // (8 * v))


def decode(images: list[Image]) -> list[np.ndarray]:
    """Of each image its coefficients (blocks in scan order, 64). Images with equal tables go together."""
    groups: dict = {}
    for k, image in enumerate(images):
        which, across, down = layout(image)
        key = (tuple(which), repr([s[1:] for s in image.scan]))
        groups.setdefault(key, []).append((k, len(which) * across * down, len(which) * image.restart))
    found: list = [None] * len(images)
    for (which, _), members in groups.items():
        tables: dict = {}
        dc, ac = ([tables.setdefault(repr(s[j]), lookup(*s[j])) for s in images[members[0][0]].scan] for j in (1, 2))
        intervals, blocks = [], []
        for k, total, restart in members:
            got = images[k].intervals
            each = [min(restart or total, total - a) for a in range(0, total, restart or total)]
            if len(got) != len(each):
                raise ValueError("intervals are missing")
            intervals += got
            blocks += each
        blocks = np.array(blocks)
        out = decode_intervals(intervals, blocks, list(which), dc, ac)
        at = 0
        for k, _total, _ in members:
            n = len(images[k].intervals)
            part, b = out[at : at + n], blocks[at : at + n]
            found[k] = part.reshape(-1, 64) if (b == out.shape[1]).all() else np.concatenate([x[:m] for x, m in zip(part, b, strict=True)])
            at += n
    return found


def thumbnail(image: Image, coefs: np.ndarray) -> np.ndarray:
    """One luminance pixel per block, from the DC coefficient alone."""
    which, across, down = layout(image)
    _, h, v, q = image.components[0]
    if len(image.components) == 1:
        h = v = 1
    first = coefs.reshape(down, across, len(which), 64)[:, :, : h * v, 0].reshape(down, across, v, h)
    dc = first.transpose(0, 2, 1, 3).reshape(down * v, across * h) * int(image.quant[q][0])
    pixels = np.clip((dc + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return pixels[: -(-image.height // 8), : -(-image.width // 8)]


def payload(coefs: np.ndarray) -> bytes:
    v = coefs.reshape(-1)
    return (np.where(v > 0, v - 1, v) + OFFSET).astype(np.uint8).tobytes()


def thumbnail_hash(pixels: np.ndarray) -> str:
    return f"{zlib.crc32(pixels.tobytes()):08x}"


def features(media: list[bytes]) -> list[tuple[bytes, str]]:
    """Read stored bytes: the payload, and width, height, images and thumbnail hashes as text."""
    parsed = [parse(m) for m in media]
    coefs = decode([i for p in parsed for i in p])
    out, at = [], 0
    for p in parsed:
        mine = coefs[at : at + len(p)]
        at += len(p)
        thumbs = ",".join(thumbnail_hash(thumbnail(i, c)) for i, c in zip(p, mine, strict=True))
        out.append((b"".join(map(payload, mine)), f"{p[0].width}x{sum(i.height for i in p)};images={len(p)};thumb={thumbs}"))
    return out


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Texts as JPEG bytes, read back: the columns of COLUMNS, and the bytes as `media` if asked for."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", 2 << 20):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            media = encode_all([pad(t) for t in texts])
            read = features(media)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            cols = [
                batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p, _ in read], pa.int64()),
                pa.array([sha(p) for p, _ in read], pa.string()), pa.array([zlib.crc32(p[-32:]) for p, _ in read], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()), pa.array([sha(m) for m in media], pa.string()), pa.array([f for _, f in read], pa.string()),
            ]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            if keep_media:
                cols, names = [*cols, pa.array(media, pa.binary())], [*names, "media"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, COLUMNS + (", media binary" if keep_media else ""))


def op8_jpeg(spark, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))
