"""Quality classifier: a convolutional network over bytes, in numpy.

The UTF-8 bytes of the whole text are covered by overlapping chunks of CHUNK bytes, one every HOP.
Learned filters of WIDTH bytes slide over each chunk in steps of STEP; the largest response of a
filter in a chunk, cut at zero, is the chunk's feature (max pooling). The means and the maxima of
the chunk features over the document go through one logistic unit to a probability.

The windows of a chunk are those that begin in it; the last one reaches into what follows.
A filter is byte embedding times weights, so scoring looks up one table of WIDTH x 256 x FILTERS.
The network is fitted on the driver with Adam on a bounded sample of labelled rows: of the SAMPLE
smallest hashes of doc_id, those that fit, one after the other, into SAMPLE_BYTES of text. Their texts
are read whole, as all texts are in scoring. It takes EPOCHS rounds, more of a small sample, so that there
are STEPS steps of BATCH rows at least. A long text is scored PIECE bytes at a time.

Defined cases: a null text is empty; an empty text is one chunk of padding and gets a score like
any other. Labels that are null are ignored; several labels of a document count as the largest, of
several texts of a labelled document the smallest is fitted on. Without labels, or with one class
only, the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import giving_back, slices
from .storage import Scratch

CHUNK, HOP, SEGMENT = 512, 384, 128
WIDTH, STEP, FILTERS, DIMENSION = 8, 4, 16, 6
SAMPLE, SAMPLE_BYTES, EPOCHS, STEPS, BATCH = 2400, 16 << 20, 12, 600, 48
PIECE = SEGMENT << 11
REACH = WIDTH - STEP  # how far the last window of a chunk reaches past it
THRESHOLD = 0.3
FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _padded(text: str | None) -> np.ndarray:
    """Bytes with zeros up to whole segments that end a chunk."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    chunks = 1 + max(0, -(-(len(raw) - CHUNK) // HOP))
    out = np.zeros(CHUNK + HOP * (chunks - 1), np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


@dataclass
class Network:
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        return cls(rng.normal(0, 0.5, (256, DIMENSION)), rng.normal(0, 0.3, (WIDTH, DIMENSION, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), np.zeros(1))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.weights, self.bias, self.out, self.shift]

    def table(self) -> np.ndarray:
        return (self.embedding @ self.weights).astype(np.float32)


def _pooled(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each SEGMENT of a padded byte array (the last windows reach past its end into zeros)."""
    longer = np.concatenate((data, np.zeros(WIDTH, np.uint8)))
    out = np.empty((len(data) // SEGMENT, FILTERS), np.float32)
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        total = table[0][longer[a:b:STEP]]
        for p in range(1, WIDTH):
            total += table[p][longer[a + p : b + p : STEP]]
        out[a // SEGMENT : b // SEGMENT] = total.reshape(-1, SEGMENT // STEP, FILTERS).max(axis=1)
    return out


def score_texts(net: Network, texts: list[str | None], block: int = 1 << 20) -> np.ndarray:
    table, scores = net.table(), np.empty(len(texts))
    bias = net.bias.astype(np.float32)
    held: list[np.ndarray] = []
    first = size = 0

    def flush(upto: int) -> None:
        # Documents lie end to end; the windows on a seam reach into the next one, so each is followed by padding.
        spaced = np.concatenate([x for d in held for x in (d, np.zeros(SEGMENT, np.uint8))])
        pooled = _pooled(table, spaced)
        at = 0
        for i, d in zip(range(first, upto), held, strict=True):
            n = len(d) // SEGMENT
            seg = pooled[at : at + n]
            at += n + 1
            wide, hop = CHUNK // SEGMENT, HOP // SEGMENT
            chunk = seg[: n - wide + 1 : hop]
            for k in range(1, wide):
                chunk = np.maximum(chunk, seg[k : n - wide + 1 + k : hop])
            chunk = np.maximum(chunk + bias, 0)
            z = net.out @ np.concatenate((chunk.mean(axis=0), chunk.max(axis=0))) + net.shift[0]
            scores[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for i, t in enumerate(texts):
        d = _padded(t)
        if held and size + len(d) > block:
            flush(i)
            held, first, size = [], i, 0
        held.append(d)
        size += len(d)
    if held:
        flush(len(texts))
    return scores


def fit(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int | None = None) -> Network:
    """Adam on the logistic loss; the gradient runs through the winning windows only."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    net.shift[0] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        if len(labels) == 0:
            net.shift[0] = 0.0
        return net
    data = []
    for t in texts:
        whole = np.concatenate((_padded(t), np.zeros(REACH, np.uint8)))
        data.append(np.lib.stride_tricks.sliding_window_view(whole, CHUNK + REACH)[::HOP])
    epochs = epochs or max(EPOCHS, -(-STEPS // -(-len(data) // BATCH)))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for p, g, (m, v) in zip(net.parameters(), _gradient(net, [data[i] for i in pick], labels[pick]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _winners(table: np.ndarray, chunks: np.ndarray, piece: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of the largest response of each filter in each chunk."""
    where, top = np.empty((len(chunks), FILTERS), np.int64), np.empty((len(chunks), FILTERS))
    for a in range(0, len(chunks), piece):
        part = chunks[a : a + piece]
        total = table[0][part[:, 0:CHUNK:STEP]]
        for p in range(1, WIDTH):
            total += table[p][part[:, p : p + CHUNK : STEP]]
        where[a : a + piece] = total.argmax(axis=1)
        top[a : a + piece] = total.max(axis=1)
    return where, top


def _gradient(net: Network, docs: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    counts = np.array([len(d) for d in docs])
    chunks, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), counts)
    where, top = _winners(net.table(), chunks)
    top = top + net.bias
    pooled = np.maximum(top, 0)
    first = np.cumsum(counts) - counts
    mean = np.add.reduceat(pooled, first) / counts[:, None]
    best = np.maximum.reduceat(pooled, first)
    features = np.concatenate((mean, best), axis=1)
    p = 1 / (1 + np.exp(-np.clip(features @ net.out + net.shift[0], -30, 30)))
    error = (p - labels) / len(docs)
    back = error[:, None] * net.out
    g = back[owner, :FILTERS] / counts[owner, None]
    g = g + back[owner, FILTERS:] * (pooled == best[owner])
    g = g * (top > 0)
    d_table = np.zeros((WIDTH, 256, FILTERS))
    rows, columns = np.arange(len(chunks))[:, None], np.broadcast_to(np.arange(FILTERS), g.shape)
    for q in range(WIDTH):
        cell = chunks[rows, where * STEP + q].astype(np.int64) * FILTERS + columns
        d_table[q] = np.bincount(cell.ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    d_weights = np.einsum("bd,wbf->wdf", net.embedding, d_table)
    d_embedding = np.einsum("wbf,wdf->bd", d_table, net.weights)
    return [d_embedding, d_weights, g.sum(axis=0), features.T @ error + 1e-4 * net.out, np.array([error.sum()])]


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most `most` documents and `most_bytes` bytes outside the held-out fold."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    with Scratch(docs.sparkSession, "sample") as s:
        rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
        rows = s.saved(rows, "rows")
        left, chosen = most_bytes, []
        for r in rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
            if r["size"] <= left:
                left -= r["size"]
                chosen.append(r["doc_id"])
        rows = sorted(rows.where(F.col("doc_id").isin(chosen)).collect(), key=lambda r: r["doc_id"])
    return [r["text"] or "" for r in rows], np.array([float(r["quality"] > 0) for r in rows])


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of docs with score (the probability of label 1) as the last."""
    columns = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = score_texts(net, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*columns, "__rw_score"])

    return docs.mapInArrow(giving_back(run), T.StructType([*docs.schema.fields, T.StructField("__rw_score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    net = fit(*labelled_sample(docs, labels, sample))
    scored = score_documents(docs.select("doc_id", "text"), net)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("__rw_score").alias("score"), (F.col("__rw_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns."""
    net = fit(*labelled_sample(docs, labels, sample))
    return score_documents(docs, net).where(F.col("__rw_score") >= threshold).select(*docs.columns)
