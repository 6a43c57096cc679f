"""Embedders: an interface, a deterministic one by hashing, and one for a service with the common HTTP shape.

Every distinct text is embedded once: texts are grouped by a digest, embedded in Arrow batches, and
the vectors joined back. A hashing embedder is a plain expression and needs neither Python nor join.
"""

from __future__ import annotations

import hashlib
import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(ABC):
    """Embeds batches of texts; `expression` may stand in for it inside the JVM."""

    dimension: int
    batch: int = 256

    @abstractmethod
    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def expression(self, text: Column) -> Column | None:
        return None


class HashEmbedder(Embedder):
    """Component i is the sum of four uniform numbers, made from the digest of i and the text, less two;
    near to normal. Vectors have length one. The same text always has the same vector, on any machine."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_batch(self, texts):
        out = []
        for text in texts:
            raw = []
            for i in range(self.dimension):
                digest = hashlib.md5(f"{i}:{text}".encode()).hexdigest()
                raw.append(sum(int(digest[a : a + 8], 16) for a in (0, 8, 16, 24)) / 4294967296.0 - 2.0)
            size = math.sqrt(math.fsum(x * x for x in raw))
            out.append([x / size if size else 0.0 for x in raw])
        return out

    def expression(self, text: Column) -> Column:
        def component(i: Column) -> Column:
            digest = F.md5(F.concat(i.cast("string"), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
            parts = [F.conv(F.substring(digest, a, 8), 16, 10).cast("long") for a in (1, 9, 17, 25)]
            return sum(parts[1:], parts[0]) / F.lit(4294967296.0) - F.lit(2.0)

        raw = F.transform(F.sequence(F.lit(0), F.lit(self.dimension - 1)), component)
        return F.element_at(F.transform(F.array(raw), _normalised), 1)


def _normalised(v: Column) -> Column:
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0)))


class HttpEmbedder(Embedder):
    """A service that takes {"model", "input"} and answers {"data": [{"index", "embedding"}]}; retried as connectors are."""

    def __init__(self, url: str, model: str, dimension: int, key: str | None = None, batch: int = 256, post: Callable[[str, dict, dict], tuple[int, dict]] | None = None):
        self.url, self.model, self.dimension, self.key, self.batch, self.post = url, model, dimension, key, batch, post

    def embed_batch(self, texts):
        from ..sources.connectors import with_retry

        head = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            part = list(texts[at : at + self.batch])
            body = with_retry(lambda part=part: (self.post or _post)(self.url, {"model": self.model, "input": part}, head))
            found = [d["embedding"] for d in sorted(body["data"], key=lambda d: d["index"])]
            if len(found) != len(part) or any(len(v) != self.dimension for v in found):
                raise ValueError("the embedding service gave another number or length of vectors")
            out += found
        return out


def _post(url: str, body: dict, head: dict) -> tuple[int, dict]:
    import json
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **head})
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            return answer.status, json.loads(answer.read())
    except urllib.error.HTTPError as e:
        return e.code, {}


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", into: str = "vector") -> DataFrame:
    """rows with the vector of `text`; a null text counts as empty."""
    fast = embedder.expression(F.col(text))
    if fast is not None:
        return rows.withColumn(into, fast.cast("array<float>"))
    keyed = rows.withColumn("__digest", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, embedder.batch):
                part = batch.slice(at, embedder.batch)
                vectors = embedder.embed_batch(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("__digest"), pa.array(vectors, pa.list_(pa.float32()))], ["__digest", "__vector"])

    distinct = keyed.groupBy("__digest").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("__text"))
    vectors = distinct.mapInArrow(run, "__digest string, __vector array<float>")
    return keyed.join(vectors, "__digest").withColumn(into, F.col("__vector")).drop("__digest", "__vector")
