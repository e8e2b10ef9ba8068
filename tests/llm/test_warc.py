import base64
import hashlib

import pytest
import zstandard
from oracle import duck_rows, rounded

from tilewright.llm import warc
from tilewright.llm.common import written


def test_seek_and_stream():
    w = warc.BundleWriter(frame=100)
    records = [warc.record(k, f"http://x/{k}", "response", warc.base32_sha1(b"p" * k), k, b"p" * k) for k in range(40)]
    for r in records:
        w.add(r)
    bundle = w.close()
    assert len(warc.seek_table(bundle)) > 10
    for k in (39, 0, 17):
        headers, block = warc.read_record(bundle, *w.places[k])
        assert block == b"p" * k and headers["WARC-Target-URI"] == f"http://x/{k}"
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bundle) == b"".join(records)
    with pytest.raises(ValueError):
        warc.seek_table(bundle[:-1])


def test_against_sql(spark, sf_dir):
    names, want = duck_rows(warc.ORACLE_SQL, sf_dir)
    got = warc.op6_warc(spark, sf_dir)
    assert rounded(tuple(r) for r in got.select(*names).collect()) == rounded(want)
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in got.collect():
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html[r["page_id"]].encode()).digest()).decode()


def test_odd_rows(spark):
    rows = [(1, None, None, 0), (2, "u\r\nX: y", "", 0), (2, "u", "", 0), (None, "n", "same", 0), (None, "n", "same", 0), (3, "u", "same", 0), (None, "n", "own", 0), (4, "ü", "é" * 300000, 0), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, bundle long")
    got = warc.read_all(written(warc.bundles(warc.planned(df), 1000, 5000), "t")).collect()
    key = lambda r: (r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0)
    assert sorted(map(key, got)) == sorted([(1, 0, "revisit", 2), (2, 0, "response", 0), (2, 0, "response", 0), (0, 4, "revisit", 3), (0, 4, "revisit", 3), (3, 4, "response", 0), (0, 3, "response", 0), (4, 600000, "response", 0), (5, 33, "response", 0)])
    assert {r["record_type"] for r in warc.read_all(written(warc.bundles(warc.planned(df, 5)), "t")).collect() if r["payload_bytes"] < 5} == {"response"}
    assert warc.bundles(warc.planned(df.limit(0))).count() == 0
