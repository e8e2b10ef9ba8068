"""Binary containers: texture files, correction and target fields, node trees.

Spark reads them as `binaryFile` rows; the functions here parse and build the bytes. Payloads are
stored or, in textures, wrapped in a chunk that names a codec; such a payload is told of, not decoded. The
layout of the fields is this engine's.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

# Fixed values of the formats.
HEADER, MAGIC, VERSION = 0x100, 0x0000303A, 0x00000100
L8, DXT1 = 0, 10
TAILS = {DXT1: (0xFFFFFFFF, 0xFFFFFFFF), L8: (0x00FFFFFF, 0)}
CHUNK_HEADER, CHUNK_MAGIC, CHUNK_MAGIC_2, CHUNK_PARAMETERS = 0x40, 0xA810BEF4, 0x17F34DF32797945C, (21, 20)
BASIS_STORED, BASIS_CHUNKED = 0x12345671, 0x12345672
FIELD_MAGIC, TARGET_MAGIC = b"AWFX", b"AWFT"
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
NODE_HEADER = 0x20
TREE, LONG, INT, BLOB = (bytes.fromhex(x) for x in ("b5fe24c7b73cebb7", "bc628ed22a7082f3", "9e8caf8498703ec2", "9e76560202020202"))
TREE_ROOT = bytes.fromhex("c3e386cb206d5fec")
TREE_FIELDS = ("SizeUncompressed", "SizeCompressed", "ChecksumUncompressed", "ChecksumCompressed", "Compressed")


def chain_size(width: int, height: int, levels: int, kind: int) -> int:
    """Bytes of a mip chain: texels of an 8-bit one, blocks of 8 bytes of a BC1 one."""
    total = 0
    for k in range(levels):
        w, h = max(1, width >> k), max(1, height >> k)
        total += w * h if kind == L8 else -(-w // 4) * -(-h // 4) * 8
    return total


def texture_file(payload: bytes, size: int, kind: int, level: int, levels: int | None = None, plain: int | None = None) -> bytes:
    """A header of eleven 32-bit numbers, padded to 256 bytes, and the payload; plain: its size if it is a chunk."""
    levels = levels if levels is not None else size.bit_length()
    head = struct.pack("<11I", MAGIC, VERSION, level, len(payload), len(payload) if plain is None else plain, size, size, levels, kind, *TAILS[kind])
    return head.ljust(HEADER, b"\0") + payload


def chunk(coded: bytes, plain: int) -> bytes:
    """A compressed payload's chunk around what a codec has made of `plain` bytes."""
    head = struct.pack("<IIQQ16xQII8x", CHUNK_HEADER, CHUNK_MAGIC, plain, CHUNK_HEADER + len(coded), CHUNK_MAGIC_2, *CHUNK_PARAMETERS)
    return head + coded


def parse_texture(data: bytes) -> dict:
    """A texture's header, its payload, and whether that is stored; of a chunk also the codec's bytes and sizes."""
    magic, version, level, length, plain, width, height, levels, kind, *_ = struct.unpack_from("<11I", data.ljust(44, b"\0"))
    if magic != MAGIC:
        raise ValueError("no texture file")
    if len(data) < HEADER + length:
        raise ValueError("short payload")
    payload = data[HEADER : HEADER + length]
    out = {"version": version, "level": level, "width": width, "height": height, "levels": levels, "kind": kind, "plain": plain, "payload": payload}
    stored = length < CHUNK_HEADER or struct.unpack_from("<I", payload, 4)[0] != CHUNK_MAGIC
    if stored:
        return out | {"stored": True}
    start, _, inner, total = struct.unpack_from("<IIQQ", payload)
    return out | {"stored": False, "coded": payload[start:], "chunk_plain": inner, "chunk_total": total}


def field_file(w: float, e: float, n: float, s: float, scale: np.ndarray, offset: np.ndarray) -> bytes:
    """A correction field of size x size texels: a scale and three offsets each."""
    return FIELD_MAGIC + struct.pack("<II4d", 1, len(scale), w, e, n, s) + scale.astype("<f4").tobytes() + offset.astype("<f4").tobytes()


def parse_field(data: bytes) -> dict:
    if data[:4] != FIELD_MAGIC:
        raise ValueError("no correction field")
    version, size, w, e, n, s = struct.unpack_from("<II4d", data, 4)
    if version != 1 or not 2 <= size <= 16384:
        raise ValueError("bad version or size")
    if len(data) < 44 + 16 * size * size:
        raise ValueError("short data")
    scale = np.frombuffer(data, "<f4", size * size, 44).reshape(size, size)
    offset = np.frombuffer(data, "<f4", 3 * size * size, 44 + 4 * size * size).reshape(size, size, 3)
    return {"size": size, "w": w, "e": e, "n": n, "s": s, "scale": scale, "offset": offset}


def target_file(w: float, e: float, n: float, s: float, tone: np.ndarray) -> bytes:
    ny, nx = tone.shape[:2]
    return TARGET_MAGIC + struct.pack("<II4d", nx, ny, w, e, n, s) + tone.astype("<f4").tobytes()


def parse_targets(data: bytes) -> dict:
    if data[:4] != TARGET_MAGIC:
        raise ValueError("no target field")
    nx, ny, w, e, n, s = struct.unpack_from("<II4d", data, 4)
    return {"w": w, "e": e, "n": n, "s": s, "tone": np.frombuffer(data, "<f4", 3 * nx * ny, 44).reshape(ny, nx, 3)}


def fnv1a64(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return h


def name_hash(name: str) -> bytes:
    """The hash of a name and the NUL that closes it, as stored."""
    return struct.pack("<Q", fnv1a64(name.encode("ascii") + b"\0"))


def node(kind: bytes, name: bytes, value: bytes | list[bytes]) -> bytes:
    """A node: hashes of kind and name, its size with the header, then the size up to the next node or, of a tree,
    where its nodes begin; the value is padded to 8 bytes."""
    if isinstance(value, list):
        body = b"".join(value)
        return kind + name + struct.pack("<QQ", NODE_HEADER + len(body), NODE_HEADER) + body
    size = NODE_HEADER + len(value)
    return (kind + name + struct.pack("<QQ", size, size + -size % 8) + value).ljust(size + -size % 8, b"\0")


def tree_file(content: bytes, deflated: bool = True) -> bytes:
    """A tree of five fields around a payload: sizes and CRC-32 of the content and of what is stored."""
    if deflated:
        packer = zlib.compressobj(9, zlib.DEFLATED, -15)
        payload = packer.compress(content) + packer.flush()
    else:
        payload = content
    numbers = [(LONG, struct.pack("<Q", len(content))), (LONG, struct.pack("<Q", len(payload))), (INT, struct.pack("<I", zlib.crc32(content))), (INT, struct.pack("<I", zlib.crc32(payload))), (BLOB, payload)]
    fields = [node(kind, name_hash(name), value) for name, (kind, value) in zip(TREE_FIELDS, numbers, strict=True)]
    return node(TREE, TREE_ROOT, [node(TREE, name_hash("object"), fields)])


def walk(data: bytes, depth: int = 0, path: tuple[int, ...] = ()) -> list[dict]:
    """All nodes in order, parents first."""
    out, at, k = [], 0, 0
    while at + NODE_HEADER <= len(data):
        kind, name = data[at : at + 8], data[at + 8 : at + 16]
        size, second = struct.unpack_from("<QQ", data, at + 16)
        if size < NODE_HEADER or at + size > len(data):
            raise ValueError("broken node")
        tree = kind == TREE and second == NODE_HEADER
        value = data[at + NODE_HEADER : at + size]
        out.append({"kind": kind, "name": name, "depth": depth, "path": (*path, k), "value": None if tree else value})
        if tree:
            out += walk(value, depth + 1, (*path, k))
        at, k = at + size + -size % 8, k + 1
    return out


def tree_content(data: bytes) -> bytes:
    """The content of a tree of five fields; both checksums and sizes are held against it."""
    names = {name_hash(n): n for n in TREE_FIELDS}
    f = {names[n["name"]]: n["value"] for n in walk(data) if n["name"] in names}
    if set(f) != set(TREE_FIELDS):
        raise ValueError("fields are missing")
    payload = f["Compressed"]
    size, stored = (int.from_bytes(f[x][:8], "little") for x in TREE_FIELDS[:2])
    if len(payload) != stored or zlib.crc32(payload) != int.from_bytes(f["ChecksumCompressed"][:4], "little"):
        raise ValueError("broken payload")
    content = payload if f["ChecksumCompressed"] == f["ChecksumUncompressed"] else zlib.decompress(payload, -15)
    if len(content) != size or zlib.crc32(content) != int.from_bytes(f["ChecksumUncompressed"][:4], "little"):
        raise ValueError("broken content")
    return content


def nodes(files: DataFrame, content: str = "content") -> DataFrame:
    """Files (path, content) to their nodes: path, place, depth, kind, name (hashes as text), value."""

    def run(batches):
        for pdf in batches:
            rows = [(p, ".".join(map(str, n["path"])), n["depth"], n["kind"].hex(), n["name"].hex(), n["value"]) for p, c in zip(pdf["path"], pdf["content"], strict=True) for n in walk(c)]
            yield type(pdf)(rows, columns=["path", "place", "depth", "kind", "name", "value"])

    return files.selectExpr("path", f"{content} AS content").mapInPandas(run, "path string, place string, depth int, kind string, name string, value binary")


def texture_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """Header fields of texture files as columns, JVM-side: little-endian numbers from the first bytes."""
    from pyspark.sql import functions as F

    number = lambda k: F.conv(F.concat(*[F.hex(F.substring(content, 4 * k + 5 - i, 1)) for i in range(1, 5)]), 16, 10).cast("long")
    names = ["magic", "version", "level", "length", "plain", "width", "height", "levels", "kind"]
    return files.select("path", *[number(k).alias(n) for k, n in enumerate(names)])
