"""Fetching tiles: what to fetch, what became of it, and a pluggable source.

A source is any callable from a URL and request headers to an answer (http, headers, content). One
for files and one for HTTP are here.
"""

from __future__ import annotations

import gzip
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.grid import col

Answer = tuple[int, dict, bytes | None]

# Headers of every request, and how often a source is asked again, in units of the set number of attempts.
HEADERS = {
    "Referer": "http://google.com/",
    "Accept-Language": "en-US,en;q=0.5",
    "Accept-Encoding": "gzip, deflate",
    "Accept": "application/json, text/javascript, */*; q=0.01",
}
RETRIES = {"US_USGS": 1, "ArcGIS": 3, "CH_Geoportal": 1, "HereWeGo": 3}
#: The answer header by which an image is said to stand for no tile. Fixed value.
NO_TILE = ("x-ve-tile-info", "no-tile")


def plan(wanted: DataFrame, images: DataFrame, metadata: DataFrame, key: list[str]) -> DataFrame:
    """skip where image and metadata are there, metadata where the image alone is, else fetch."""
    t = wanted.join(images.select(*key).distinct().withColumn("_i", F.lit(1)), key, "left").join(metadata.select(*key).distinct().withColumn("_m", F.lit(1)), key, "left")
    action = F.when(F.col("_i").isNotNull() & F.col("_m").isNotNull(), "skip").when(F.col("_i").isNotNull(), "metadata").otherwise("fetch")
    return t.select(*key, action.alias("action"))


def status(http, no_tile, is_image) -> Column:
    """What became of a request: saved, unavailable (may be filled), failed or not_image."""
    success = col(http).between(200, 299) | (col(http) == 304)
    return F.when(col(no_tile) | col(http).isin(404, 410), "unavailable").when(~success, "failed").when(~col(is_image), "not_image").otherwise("saved")


def sniff(content) -> Column:
    """The image format by its first bytes; null for anything else or fewer than twelve bytes."""
    head = lambda a, n: F.hex(F.substring(col(content), a, n))
    kind = (
        F.when(head(1, 3) == "FFD8FF", "jpeg").when(head(1, 8) == "89504E470D0A1A0A", "png").when(head(1, 4) == "47494638", "gif").when(head(1, 2) == "424D", "bmp")
        .when(head(1, 4).isin("49492A00", "4D4D002A"), "tiff").when((head(1, 4) == "52494646") & (head(9, 4) == "57454250"), "webp")
    )
    return F.when(F.octet_length(col(content)) >= 12, kind)


def request_headers(agent: str = "tilewright", extra: dict[str, str] | None = None) -> dict[str, str]:
    """Headers of a request; those of a source are added, and a referrer in either spelling takes the place of the usual one."""
    out = {"User-Agent": agent, **HEADERS}
    for name, value in (extra or {}).items():
        out["Referer" if name.lower() in ("referer", "referrer") else name] = value
    return out


def fetched(requests: DataFrame, source: Callable[[str, dict], Answer], retries: int = 10, wait: float = 0.0, agent: str = "tilewright", extra: dict[str, dict] | None = None) -> DataFrame:
    """requests (url, and source if it matters) with http, no_tile, attempts and content, unzipped.

    Sources named in RETRIES are asked again after `wait` seconds while they answer neither success nor
    304; a source that raises OSError is reported as -1. `extra` has headers by source. A task works through its own requests one after
    another, so the number of partitions is the number of requests at once.
    """

    def ask(url: str, headers: dict) -> Answer:
        try:
            return source(url, headers)
        except OSError:
            return -1, {}, None

    def run(batches):
        for batch in batches:
            rows = []
            for url, name in zip(batch["url"], batch["source"], strict=True):
                headers = request_headers(agent, (extra or {}).get(name))
                http, told, content = ask(url, headers)
                asked = 1
                while not (200 <= http <= 299 or http == 304) and asked <= retries * RETRIES.get(name, 0):
                    time.sleep(wait)
                    http, told, content = ask(url, headers)
                    asked += 1
                told = {k.lower(): v for k, v in told.items()}
                if content is not None and told.get("content-encoding") == "gzip":
                    content = gzip.decompress(content)
                rows.append((url, name, http, told.get(NO_TILE[0]) == NO_TILE[1], asked, content))
            yield type(batch)(rows, columns=["url", "source", "http", "no_tile", "attempts", "content"])

    name = F.col("source").cast("string") if "source" in requests.columns else F.lit(None).cast("string")
    return requests.select("url", name.alias("source")).mapInPandas(run, "url string, source string, http int, no_tile boolean, attempts int, content binary")


def file_source(url: str, headers: dict) -> Answer:
    """A source for file:// URLs."""
    try:
        with open(url.removeprefix("file://"), "rb") as f:
            return 200, {}, f.read()
    except FileNotFoundError:
        return 404, {}, None


def http_source(url: str, headers: dict, timeout: float = 60.0) -> Answer:
    """A source for http:// and https:// URLs; what is not an answer raises OSError."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except HTTPError as e:
        return e.code, dict(e.headers), None
