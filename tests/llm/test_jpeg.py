import hashlib
import os
import struct
import time
import zlib

import numpy as np
import pytest

from tilewright.llm import jpeg


def test_zigzag():
    assert jpeg.zigzag().tolist()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert sorted(jpeg.zigzag().tolist()) == list(range(64))


@pytest.mark.parametrize("texts", [[b"", b"a", b"x" * 575, b"x" * 576, b"x" * 577], [bytes(range(256)) * 9, b"\xff" * 1200, b"\x00" * 700, os.urandom(5000)]])
def test_round_trip(texts):
    padded = [jpeg.pad(t) for t in texts]
    assert all(len(p) % 576 == 0 and len(p) for p in padded)
    media = jpeg.encode_all(padded)
    assert [p for p, _ in jpeg.features(media)] == padded


def test_long_payload_is_a_sequence():
    p = jpeg.pad(os.urandom(576 * (jpeg.MOST_UNITS + 3)))
    media = jpeg.encode_all([p])
    read, feature = jpeg.features(media)[0]
    assert read == p and "images=2" in feature


def reference_bits(values, tables, which):
    """Entropy-code blocks of coefficients with zeros, bit by bit, as the standard says."""
    bits, last = "", {}
    for b, block in enumerate(values):
        c = which[b % len(which)]
        dc, ac = tables[c]
        diff = block[0] - last.get(c, 0)
        last[c] = block[0]

        def put(table, symbol, v, size):
            code, n = table[symbol]
            raw = v if v >= 0 else v + (1 << size) - 1
            return f"{code:0{n}b}" + (f"{raw:0{size}b}" if size else "")

        s = abs(int(diff)).bit_length()
        bits += put(dc, s, int(diff), s)
        run = 0
        top = max([k for k in range(1, 64) if block[k]], default=0)
        for k in range(1, top + 1):
            if block[k] == 0:
                run += 1
                continue
            while run > 15:
                bits += put(ac, 0xF0, 0, 0)
                run -= 16
            s = abs(int(block[k])).bit_length()
            bits += put(ac, run << 4 | s, int(block[k]), s)
            run = 0
        if top < 63:
            bits += put(ac, 0, 0, 0)
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_general_scan(sampling):
    """Runs, ends of blocks, several components, sampling factors, no restarts."""
    rng = np.random.default_rng(3)
    n = len(sampling)
    values = [r << 4 | s for r in range(16) for s in range(1, 6)] + [0, 0xF0]
    bits_ac, bits_dc = [0] * 7 + [len(values)] + [0] * 8, [0] * 3 + [12] + [0] * 12
    which = [0] if n == 1 else [k for k, (h, v) in enumerate(sampling) for _ in range(h * v)]
    across, down = 3, 2
    width, height = (across * 8 * max(h for h, _ in sampling), down * 8 * max(v for _, v in sampling)) if n > 1 else (24, 16)
    blocks = len(which) * across * down
    coefs = np.where(rng.random((blocks, 64)) < 0.08, rng.integers(-15, 16, (blocks, 64)), 0)
    coefs[:, 0] = rng.integers(-100, 100, blocks)
    tables = [(jpeg.codes(bits_dc, list(range(12))), jpeg.codes(bits_ac, values))] * n
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\x00" + b"\x02" * 64)
    head += seg(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling)))
    head += seg(0xC4, bytes([0x00, *bits_dc, *range(12)])) + seg(0xC4, bytes([0x10, *bits_ac, *values]))
    head += seg(0xDA, bytes([n, *(x for k in range(n) for x in (k + 1, 0)), 0, 63, 0]))
    image = jpeg.parse(head + reference_bits(coefs, tables, which) + b"\xff\xd9")
    got = jpeg.decode(image)[0]
    assert (got == coefs).all()
    thumb = jpeg.thumbnail(image[0], got)
    assert thumb.shape == (-(-height // 8), -(-width // 8))
    h, v = sampling[0] if n > 1 else (1, 1)
    assert thumb[0, 0] == np.clip((2 * coefs[0, 0] + 4) // 8 + 128, 0, 255)
    if h * v == 4:
        assert thumb[1, 0] == np.clip((2 * coefs[2, 0] + 4) // 8 + 128, 0, 255)


def test_progressive_is_refused():
    with pytest.raises(ValueError):
        jpeg.parse(b"\xff\xd8" + jpeg._segment(0xC2, b"\x08\x00\x08\x00\x08\x01\x01\x11\x00") + b"\xff\xd9")


def test_query(spark, sf_dir):
    want = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    began = time.time()
    for r in jpeg.op8_jpeg(spark, sf_dir).collect():
        p = jpeg.pad(want[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(want[r["doc_id"]]), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-32:])
    assert time.time() - began < 120


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "a", 0), (2, "é" * 60000, 0)], "doc_id long, text string, media long")
    got = jpeg.stored(df, True).collect()
    assert got[0]["media_sha256"] == got[1]["media_sha256"] and got[0]["payload_bytes"] == 576
    assert [hashlib.sha256(r["media"]).hexdigest() for r in got] == [r["media_sha256"] for r in got]
    assert jpeg.stored(df.limit(0)).count() == 0
