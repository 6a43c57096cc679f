"""Approximate search: inverted lists, binary codes, product quantisation, k-means.

Centroids, codebooks and the queries of a batch are model tables: the driver holds at most MODEL_ROWS
of them and hands them to the tasks; more are refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors as V

MODEL_ROWS = 10_000


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors of one length as rows; shorter ones end in zeros, longer ones are cut."""
    found = [v[:dimension] for v in column.to_pylist()]
    out = np.zeros((len(found), dimension))
    for i, v in enumerate(found):
        out[i, : len(v)] = v
    return out


def route(corpus: DataFrame, rate: int) -> DataFrame:
    """corpus (id, vector) -> id, centroid_id, is_centroid. Every `rate`-th id, or else the first, is a centroid;
    any other row goes to the nearest (cosine distance, then id). Up to MODEL_ROWS centroids are held by each
    task and compared by one matrix product a batch; with more the rate is too low for the table, an error."""
    marked = corpus.withColumn("is_centroid", F.col("id") % rate == 0)
    if marked.where("is_centroid").isEmpty():
        first = corpus.agg(F.min("id")).first()[0]
        marked = corpus.withColumn("is_centroid", F.col("id") == first)
    centroids = marked.where("is_centroid").select("id", "vector").orderBy("id").limit(MODEL_ROWS + 1).collect()
    if len(centroids) > MODEL_ROWS:
        raise ValueError(f"more than {MODEL_ROWS} centroids: raise the rate")
    own = marked.where("is_centroid").select("id", F.col("id").alias("centroid_id"), "is_centroid")
    if not centroids:
        return own
    names = [r["id"] for r in centroids]
    dimension = max(len(r["vector"]) for r in centroids)
    model = _unit(_matrix(pa.array([r["vector"] for r in centroids]), dimension))
    kind = corpus.schema["id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                far = np.round(1 - _unit(_matrix(part.column("vector"), dimension)) @ model.T, 6)
                nearest = [names[i] for i in far.argmin(axis=1)]  # the first, so the smallest id, of equal ones
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(nearest, arrow), pa.array([False] * len(nearest))], ["id", "centroid_id", "is_centroid"])

    leaves = marked.where("NOT is_centroid").select("id", "vector")
    return leaves.mapInArrow(run, f"id {kind.simpleString()}, centroid_id {kind.simpleString()}, is_centroid boolean").unionByName(own)


def batch_knn(corpus: DataFrame, queries: DataFrame, k: int, most: int = MODEL_ROWS) -> DataFrame:
    """corpus (id, vector), queries (query_id, vector) -> (query_id, id, score, rank): the k nearest by cosine of
    every query, exactly. The queries, `most` at the most, are held by each task; a task compares them with its
    rows block by block and hands on k rows a query."""
    asked = queries.select("query_id", "vector").orderBy("query_id").limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} queries: ask in parts")
    kinds = [corpus.schema["id"].dataType, queries.schema["query_id"].dataType]
    dimension = max((len(r["vector"]) for r in asked), default=1)
    model = _unit(_matrix(pa.array([r["vector"] for r in asked], pa.list_(pa.float64())), dimension))
    names = [r["query_id"] for r in asked]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, object]]] = [[] for _ in names]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column("id").to_pylist()
                scores = np.round(model @ _unit(_matrix(part.column("vector"), dimension)).T, 6)
                for q, row in enumerate(scores):
                    cut = np.partition(row, max(len(row) - k, 0))[max(len(row) - k, 0)]
                    held[q] = sorted(held[q] + [(-row[i], ids[i]) for i in np.flatnonzero(row >= cut).tolist()])[:k]
        rows = [(names[q], i, -s) for q, found in enumerate(held) for s, i in found]
        types = [to_arrow_type(kinds[1]), to_arrow_type(kinds[0]), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), types, strict=True)], ["query_id", "id", "score"])

    found = corpus.select("id", "vector").mapInArrow(run, f"query_id {kinds[1].simpleString()}, id {kinds[0].simpleString()}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def bbq_search(corpus: DataFrame, vector: Sequence[float], k: int, oversample: int = 3, ef: int = 50) -> DataFrame:
    """Nearest sign codes first, then exact cosine over max(ef, oversample * k) of them."""
    n = len(vector)
    code = V.binary_quantize(V.literal(vector), n)
    coarse = corpus.withColumn("hamming", V.hamming(V.binary_quantize(F.col("vector"), n), code)).orderBy("hamming", "id").limit(max(ef, oversample * k))
    exact = coarse.withColumn("score", F.round(V.cosine(F.col("vector"), V.literal(vector)), 6))
    return exact.orderBy(F.col("score").desc(), "id").limit(k).select("id", "hamming", "score")


def kmeans(corpus: DataFrame, k: int, seed: int = 42, iterations: int = 25) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = corpus.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=k, seed=seed, maxIter=iterations).fit(rows).clusterCenters())


def _nearest(v: Column, centers: np.ndarray) -> Column:
    options = [F.struct(F.round(V.l2_squared(v, V.literal(c)), 6).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centers)]
    return F.array_min(F.array(*options))


def assign(corpus: DataFrame, centers: np.ndarray) -> DataFrame:
    """id, cluster, distance (L2 squared to the nearest center)."""
    best = _nearest(F.col("vector"), centers)
    return corpus.select("id", best.alias("b")).select("id", F.col("b.c").alias("cluster"), F.col("b.d").alias("distance"))


def lloyd(corpus: DataFrame, centers: np.ndarray) -> DataFrame:
    """One step: cluster, n, inertia and the mean of each dimension."""
    own = corpus.select("vector", _nearest(F.col("vector"), centers).alias("b"))
    wide = [F.avg(F.get("vector", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(centers.shape[1])]
    return own.groupBy(F.col("b.c").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum("b.d").alias("inertia"), *wide)


def _squares(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centers.T + (centers * centers).sum(axis=1)


def _lloyd(rows: np.ndarray, k: int, rng: np.random.Generator, iterations: int) -> np.ndarray:
    """k centers: seeds drawn with a chance in proportion to the squared distance from the nearest one, then means."""
    centers = rows[rng.integers(len(rows))][None]
    near = _squares(rows, centers)[:, 0]
    for _ in range(k - 1):
        weight = np.maximum(near, 0) + 1e-12
        centers = np.concatenate((centers, rows[rng.choice(len(rows), p=weight / weight.sum())][None]))
        near = np.minimum(near, _squares(rows, centers[-1:])[:, 0])
    for _ in range(iterations):
        own = _squares(rows, centers).argmin(axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        fresh = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        if np.allclose(fresh, centers):
            break
        centers = fresh
    return centers


class ProductQuantizer:
    """M codebooks of `ksub` words each."""

    def __init__(self, codebooks: np.ndarray):
        self.codebooks = codebooks  # (m, ksub, sub)

    @classmethod
    def train(cls, corpus: DataFrame, dimension: int, m: int, ksub: int, sample: int = 20_000, iterations: int = 25) -> ProductQuantizer:
        """K-means per sub-space on at most `sample` rows (the smallest hashes of id), which the driver holds."""
        if dimension % m or not 1 <= ksub <= 256:
            raise ValueError("dimension must divide by m, and ksub lie in 1..256")
        rows = corpus.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        if len(rows) < ksub:
            raise ValueError("fewer vectors than code words")
        data = _matrix(pa.array([r["vector"] for r in rows]), dimension).reshape(len(rows), m, -1)
        return cls(np.stack([_lloyd(data[:, j], ksub, np.random.default_rng(j + 1), iterations) for j in range(m)]))

    def encoded(self, corpus: DataFrame) -> DataFrame:
        """corpus (id, vector) -> id, codes: the nearest word of each sub-space, the first of equal ones."""
        books, kind = self.codebooks, corpus.schema["id"].dataType

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _matrix(batch.column("vector"), books.shape[0] * books.shape[2]).reshape(batch.num_rows, len(books), -1)
                codes = np.stack([_squares(rows[:, j], book).argmin(axis=1) for j, book in enumerate(books)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes.tolist(), pa.list_(pa.int16()))], ["id", "codes"])

        return corpus.select("id", "vector").mapInArrow(run, f"id {kind.simpleString()}, codes array<smallint>")

    def decode(self, codes: Column) -> Column:
        books = [F.array(*[V.literal(word) for word in book]) for book in self.codebooks]
        return F.flatten(F.array(*[F.get(book, F.get(codes, F.lit(j)).cast("int")) for j, book in enumerate(books)]))

    def adc(self, codes: Column, vector: Sequence[float]) -> Column:
        """Sum of M table look-ups: the L2 squared distance from vector to the decoded row."""
        sub = self.codebooks.shape[2]
        parts = np.asarray(vector, float).reshape(-1, sub)
        tables = ((self.codebooks - parts[:, None, :]) ** 2).sum(axis=2)
        return sum((F.get(V.literal(t), F.get(codes, F.lit(j)).cast("int")) for j, t in enumerate(tables)), F.lit(0.0))

    def search(self, coded: DataFrame, vector: Sequence[float], k: int) -> DataFrame:
        return coded.withColumn("distance", F.round(self.adc(F.col("codes"), vector), 6)).orderBy("distance", "id").limit(k)
