"""Web crawl: guarded fetches in Arrow batches, and rounds of them over a frontier.

A page that is not answered with 200, whose address is not public or that is too long has an error and
no content. Rounds are tables in the shared folder, so a round that is lost is all that runs again; the
frontier of a round is what the pages before link to, less all that was asked for.
"""

from __future__ import annotations

import socket
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import network
from ..functions.text import url_host
from . import html
from .shared import shared_dir

Get = Callable[[str], tuple[int, str, bytes]]
PAGE = "url string, status int, mime string, text string, links array<string>, error string"
MAX_BYTES = 10 << 20


def http_get(url: str) -> tuple[int, str, bytes]:
    """(status, MIME type, body up to one byte more than is allowed)."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "rankweave"}), timeout=20) as answer:
            return answer.status, answer.headers.get_content_type(), answer.read(MAX_BYTES + 1)
    except urllib.error.HTTPError as e:
        return e.code, "", b""


def addresses(host: str) -> list[str]:
    return sorted({info[4][0] for info in socket.getaddrinfo(host, None)})


def content_text(mime: str, body: bytes) -> str | None:
    """Text of a body by its type: HTML as Markdown, PDF where the optional reader is installed (else none), the rest as it is."""
    if "html" in mime:
        return html.convert(body.decode("utf-8", "replace"))[0]
    if "pdf" in mime:
        try:
            return html.pdf_text(body)[0]
        except ImportError:
            return None
    return body.decode("utf-8", "replace")


def fetched(urls: DataFrame, get: Get = http_get, resolve: Callable[[str], Sequence[str]] = addresses) -> DataFrame:
    """urls (url) -> url, status, mime, text, links, error."""

    def one(url: str) -> dict:
        out = {"url": url, "status": None, "mime": None, "text": None, "links": [], "error": None}
        try:
            found = resolve(urlsplit(url).hostname or "")
            if not found or any(network.is_blocked(ip) for ip in found):
                return out | {"error": "blocked address"}
            status, mime, body = get(url)
        except (OSError, ValueError) as e:
            return out | {"error": str(e) or type(e).__name__}
        out |= {"status": status, "mime": mime}
        if status != 200:
            return out | {"error": f"status {status}"}
        if len(body) > MAX_BYTES:
            return out | {"error": "too long"}
        links = html.resolve(html.convert(body.decode("utf-8", "replace"))[1], url) if "html" in mime else []
        return out | {"text": content_text(mime, body), "links": links}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("url", pa.string()), ("status", pa.int32()), ("mime", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string())), ("error", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([one(u) for u in batch.column("url").slice(at, 64).to_pylist()], schema)

    return urls.select("url").mapInArrow(run, PAGE)


def admitted(urls: DataFrame, allowed: Sequence[str] = (), blocked: Sequence[str] = ()) -> DataFrame:
    """urls whose host is not blocked and, where any are allowed, is one of them; what has no host goes."""
    host = url_host(F.col("url"))
    keep: Column = host.isNotNull() & ~host.isin(list(blocked))
    return urls.where(keep & host.isin(list(allowed)) if allowed else keep)


def crawl(seeds: DataFrame, get: Get = http_get, resolve: Callable[[str], Sequence[str]] = addresses, rounds: int = 3, most: int = 1000, allowed: Sequence[str] = (), blocked: Sequence[str] = ()) -> DataFrame:
    """seeds (url) -> the pages of all rounds with the number of their round; `most` pages are asked for in all,
    those of a round in the order of their urls."""
    spark = seeds.sparkSession
    root = f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}"
    clean = lambda rows: admitted(rows.select(F.regexp_replace("url", "#.*$", "").alias("url")).distinct(), allowed, blocked)
    todo, left, done = clean(seeds).orderBy("url").limit(most), most, []
    for n in range(rounds):
        path = f"{root}/{n}"
        fetched(todo.repartition("url"), get, resolve).withColumn("round", F.lit(n)).write.parquet(path)
        done.append(path)
        pages = spark.read.schema(f"{PAGE}, round int").parquet(*done)
        left = most - pages.count()
        found = spark.read.schema(f"{PAGE}, round int").parquet(path).select(F.explode("links").alias("url"))
        todo = clean(found).join(pages.select("url"), "url", "left_anti").orderBy("url").limit(left)
        if left <= 0 or todo.isEmpty():
            break
    return spark.read.schema(f"{PAGE}, round int").parquet(*done)
