"""Vectorised hashing of words in batches of texts, and batches of bounded memory."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def symbols(n: int, seed: int) -> np.ndarray:
    """n fixed random uint64, one for each symbol."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _MULT + np.uint64(seed))


def hash_runs(units: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of non-empty runs that lie end to end in units: each symbol is hashed together
    with its place in the run, and the hashes are added, so no structure of the runs cancels out."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        each = (np.arange(len(units)) - np.repeat(starts, lengths)).astype(np.uint64)
        each *= _MULT
        each += units
        each += np.uint64(seed)
        return mix(np.add.reduceat(mix(each), starts) + lengths.astype(np.uint64))


def blocks(texts: list, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` units; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `limit` bytes of a string column; a longer text is a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
        if not batch.num_rows:
            yield batch


def give_back() -> None:
    """Return freed memory to the system, so that an idle Python worker does not hold on to what its last task used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def giving_back(run):
    """A function over batches that gives its memory back at the end of the task."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
