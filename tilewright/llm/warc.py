"""WARC bundles of independent Zstandard frames with a footer seek table.

Records are grouped into frames of about FRAME bytes. Frames are compressed on their own and follow
each other; a last, skippable frame holds the seek table in the public seekable format (for each
frame its compressed and its plain size, then their number, a descriptor and the magic number). So
any Zstandard reader can read a whole bundle, and one that knows the table can read a record from a
frame number and an offset in it: the index maps record identifiers to these.

Equal payloads are stored once. The digest and id of each page, not its html, are grouped; the page
with the largest id of a digest is the response, the others are revisits, without payload but with
the digest and length of it and a reference. What tasks write are bundles as rows (a Parquet table in
the shared folder), so a lost executor's part is written again and no half bundle is ever read.

Defined results: null html is the empty payload; payloads shorter than `least` are all responses; a
null page id is smaller than any other and records of null ids never refer to themselves; rows that
repeat the response's id and payload are all responses; null url is empty; line ends in a url are
percent-encoded; extra columns are ignored; an empty table gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import slices, table, written

FRAME, BUNDLE = 256 << 10, 32 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
LEVEL = 3
LEAST = 0


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, kind: str, digest: str, size: int, payload: bytes, refers_to=None) -> bytes:
    """A WARC/1.1 record; a revisit has an empty block."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the place after the record."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record without an end")
    return headers, data[start:stop], stop + 4


class BundleWriter:
    """Collects records into frames; close() gives the bundle's bytes."""

    def __init__(self, frame: int = FRAME, level: int = LEVEL):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frame, self.frames, self.sizes, self.held = frame, [], [], bytearray()
        self.places: list[tuple[int, int]] = []

    def add(self, data: bytes) -> None:
        self.places.append((len(self.frames), len(self.held)))
        self.held += data
        if len(self.held) >= self.frame:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            packed = self.compress(bytes(self.held))
            self.frames.append(packed)
            self.sizes.append((len(packed), len(self.held)))
            self.held.clear()

    def size(self) -> int:
        return sum(a for a, _ in self.sizes) + len(self.held)

    def close(self) -> bytes:
        self._flush()
        body = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body) + len(footer)) + body + footer


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of each frame, from the footer."""
    n, descriptor, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if descriptor & 0x80 else 8
    at, place, out = len(bundle) - 9 - n * entry, 0, []
    if struct.unpack_from("<II", bundle, at - 8) != (SKIPPABLE, n * entry + 9):
        raise ValueError("broken seek table")
    for k in range(n):
        packed, plain = struct.unpack_from("<II", bundle, at + k * entry)
        out.append((place, packed, plain))
        place += packed
    return out


def read_frame(bundle: bytes, number: int, frames=None) -> bytes:
    import zstandard

    place, packed, plain = (frames or seek_table(bundle))[number]
    return zstandard.ZstdDecompressor().decompress(bundle[place : place + packed], max_output_size=plain)


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: only its frame is decompressed."""
    return parse_record(read_frame(bundle, frame), offset)[:2]


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html and refers_to: the response's id where the row is a revisit."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2(_payload(F.col("html")), 256)))
    best = rows.groupBy("_digest").agg(F.max("page_id").alias("_best"))
    out = rows.join(best, "_digest")
    revisit = (F.octet_length(_payload(F.col("html"))) >= least) & F.col("_best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_best"))
    return out.select("page_id", "url", "html", F.when(revisit, F.col("_best")).alias("refers_to"))


def bundles(plan: DataFrame, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Write: rows (bundle_id, bundle, and the index: record_ids, frames, offsets)."""

    def run(batches):
        import uuid

        import pyarrow as pa

        writer, ids = BundleWriter(frame), []

        def told():
            data = writer.close()
            f, o = zip(*writer.places, strict=True)
            cols = [pa.array([uuid.uuid4().hex]), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([f], pa.list_(pa.int32())), pa.array([o], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["bundle_id", "bundle", "record_ids", "frames", "offsets"])

        for batch in slices(batches, "html"):
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                kind = "response" if refers_to is None else "revisit"
                writer.add(record(page_id, url, kind, base32_sha1(payload), len(payload), payload if refers_to is None else b"", refers_to))
                ids.append(page_id)
                if writer.size() >= bundle:
                    yield told()
                    writer, ids = BundleWriter(frame), []
        if ids:
            yield told()

    return plan.mapInArrow(run, "bundle_id string, bundle binary, record_ids array<long>, frames array<int>, offsets array<long>")


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def read_all(written_bundles: DataFrame) -> DataFrame:
    """Every record of bundles, frame by frame: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Records are found through the index and checked against it; a response's digest and length are
    taken from its payload and checked against its headers.
    """

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for bundle, ids, frames, offsets in zip(*(batch.column(c).to_pylist() for c in ("bundle", "record_ids", "frames", "offsets")), strict=True):
                rows, held, now, seek = [], b"", -1, seek_table(bundle)
                for page_id, f, o in zip(ids, frames, offsets, strict=True):
                    if f != now:
                        held, now = read_frame(bundle, f, seek), f
                    headers, block, _ = parse_record(held, o)
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                    if headers["WARC-Record-ID"] != f"<urn:page:{page_id}>":
                        raise ValueError("the index names another record")
                    if headers["WARC-Type"] == "response":
                        if (digest, size) != (base32_sha1(block), len(block)):
                            raise ValueError("payload and headers differ")
                    rows.append((page_id, size, digest, headers["WARC-Type"], _number(headers.get("WARC-Refers-To"))))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return written_bundles.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    return read_all(written(bundles(planned(table(spark, sf_dir, "pages"))), "warc-bundles"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS best FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         (CAST('0x' || substr(sha1(p.html), CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN g ON p.html = g.html
"""
