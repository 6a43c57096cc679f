"""Bounded-space online packing of tokenised documents.

Each partition streams its documents. A document's ids (and a final 0) are cut into full windows
of SIZE ids and a rest. The rest goes to the fullest of at most OPEN open windows that has room
for it (best fit). If none has, the fullest window is emitted: a gap of over SLACK ids is first
filled from the front of the rest, so hardly any padding is left. Windows that are still open at
the end of a partition are leftovers; they are saved with everything else and merged in groups of
a bounded number of windows by best fit, largest piece first, without cutting.

Tokenising: texts are split into the words of the byte-level BPE by array operations, and only
words not met lately are encoded by the tokenizer. Texts above SEGMENT code points are cut first at
places where a word begins in any case. Segments with a code point beyond the basic plane, with one
that not all versions of Unicode class alike, or with the string of an added token such as
<|endoftext|> (which the tokenizer turns into the id of that token) go through the tokenizer whole.

Defined cases: a null or empty text is the single id 0. Repeated rows are packed one by one. An
empty table gives no pieces. The result depends on the order of the input rows only.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrays import giving_back, mix, slices
from .storage import saved

SIZE = 1024
OPEN = 32
SLACK = 8
MERGE = 64
BLOCK, SEGMENT = 2_000_000, 250_000
# The code points of the basic plane that are white space to the tokenizer.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ID = attrgetter("id")
_SEAM = re.compile(r"[A-Za-z0-9](?=[ \n])")
_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane: 1 letter, 2 digit, 3 white space, 0 other; and whether all
    versions of Unicode since 3.2 agree on it (below 0x250 they do), so that every library splits alike."""
    now = [unicodedata.category(chr(c)) for c in range(1 << 16)]
    old = [unicodedata.ucd_3_2_0.category(chr(c)) for c in range(1 << 16)]
    kind = np.array([1 if k[0] == "L" else 2 if k[0] == "N" else 0 for k in now], np.int8)
    kind[WHITE_SPACE] = 3
    settled = np.array([c < 0x250 or (a == b and a not in ("Cn", "Cs", "Co")) for c, (a, b) in enumerate(zip(now, old, strict=True))])
    return kind, settled


def segments(text: str, limit: int = SEGMENT) -> Iterator[str]:
    """The text cut before single blanks or line ends that follow a letter or digit, where a word begins
    whatever comes before or after. A stretch without such a place stays whole."""
    at = 0
    while len(text) - at > limit:
        cut = _SEAM.search(text, at + limit - 1)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


class BatchTokenizer:
    """Ids of many texts at once, equal to those of tokenizers.Tokenizer.encode.

    Texts are split by array operations; equal words are found by hash and then compared, and a text in
    which two words share a hash goes through the library. At most `keep` words are remembered with
    their ids."""

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.added = [token.content for token in self.slow.get_added_tokens_decoder().values()]
        letters = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
        # The alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on.
        others = iter(range(256, 512))
        self.alphabet = np.array([c if c in set(letters) else next(others) for c in range(256)], "<u2")
        self.keep = keep
        self._forget()
        self.kind, self.settled = _kinds()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, int, str, np.ndarray]] = []  # text, place in it, segment, code points
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                for (i, at, _, _), ids in zip(held, self._block("".join(h[2] for h in held), [h[3] for h in held]), strict=True):
                    parts[i][at] = ids
            held.clear()
            size = 0

        for i, t in enumerate(texts):
            for segment in segments(t) if t else ():
                units = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)
                if int(units.max()) < 1 << 16 and self.settled[units].all() and not any(x in segment for x in self.added):
                    held.append((i, len(parts[i]), segment, units))
                    parts[i].append(units)
                    size += len(units)
                    if size >= BLOCK:
                        flush()
                else:
                    parts[i].append(self._library(segment))
        flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def _hash(self, parts: list[np.ndarray]) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(parts[0] + mix(parts[1] + mix(parts[2])))

    def _names(self, spelt: str, octets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Three numbers for each word that equal words share and no others: its first 16 bytes and its length,
        or, of a longer word, the number of its string among those met in the block, and 17."""
        lengths = ends - starts
        wide = np.concatenate((octets, np.zeros(16, np.uint8)))
        eight = np.lib.stride_tricks.sliding_window_view(wide, 8)
        low = eight[starts].view("<u8").ravel() & _MASKS[np.minimum(lengths, 8)]
        high = np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(lengths > 8)
        high[more] = eight[starts[more] + 8].view("<u8").ravel() & _MASKS[np.minimum(lengths[more] - 8, 8)]
        long = np.flatnonzero(lengths > 16)
        if len(long):
            seen: dict[str, int] = {}
            low[long] = [seen.setdefault(spelt[i:j], len(seen)) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            high[long] = 0
        return [low, high, np.minimum(lengths, 17).astype(np.uint64)]

    def _block(self, text: str, raw: list[np.ndarray]) -> list[np.ndarray]:
        data = np.concatenate(raw)
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        starts = self._word_starts(data, bounds)
        # The text in the alphabet of the model, a letter for each byte, and where the words lie in it.
        octets = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        spelt = self.alphabet[octets].tobytes().decode("utf-16-le")
        if len(octets) == len(data):
            edges = np.append(starts, len(data))
        else:
            wide = np.cumsum((data >= 0x80).astype(np.int8) + (data >= 0x800), dtype=np.int64)
            edges = np.append(starts + np.where(starts > 0, wide[starts - 1], 0), len(octets))
        parts = self._names(spelt, octets, edges[:-1], edges[1:])
        codes, names = pd.factorize(self._hash(parts))
        first = np.empty(len(names), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        same = np.logical_and.reduce([p[first][codes] == p for p in parts])
        at, sizes = self._look_up([spelt[i:j] for i, j in zip(edges[first].tolist(), edges[first + 1].tolist(), strict=True)])
        each = sizes[codes]
        total = np.concatenate(([0], np.cumsum(each)))
        index = np.repeat(at[codes] - total[:-1], each) + np.arange(total[-1])
        flat = self.flat[index]
        cuts = total[np.searchsorted(starts, bounds)]
        out = [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.unique(np.searchsorted(bounds, starts[~same], side="right") - 1).tolist():
            out[i] = self._library(text[bounds[i] : bounds[i + 1]])
        return out

    def _forget(self) -> None:
        """Words met so far, in the alphabet of the model, and where the ids of each lie in one flat array."""
        self.words: dict[str, int] = {}
        self.at, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) + len(words) > self.keep:
            self._forget()
        known, encode = self.words, self.slow.model.tokenize
        place = list(map(known.get, words))
        fresh = [w for w, n in zip(words, place, strict=True) if n is None]
        if fresh:
            tokens = list(map(encode, fresh))
            numbers = iter(range(len(known), len(known) + len(fresh)))
            place = [next(numbers) if n is None else n for n in place]
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, np.fromiter(map(_ID, chain.from_iterable(tokens)), np.uint32, int(sizes.sum()))))
        place = np.array(place, np.int64)
        return self.at[place], self.sizes[place]

    def _word_starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the words of the byte-level BPE begin: a run of letters, digits or other signs with
        one space before it; white space short of that; a short contraction after no space."""
        kind = self.kind[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[bounds] = True
        begin = begin[:-1]
        run = begin.copy()
        run[1:] |= kind[1:] != kind[:-1]
        word = run.copy()
        after = np.flatnonzero(run & (kind != 3) & ~begin)
        after = after[kind[after - 1] == 3]
        word[after - 1] = True
        word[after[data[after - 1] == 32]] = False
        marks = np.flatnonzero((data == 39) & run)
        marks = marks[begin[marks] | (data[marks - 1] != 32)]
        last = bounds[np.searchsorted(bounds, marks, side="right")]
        for m, end in zip(marks.tolist(), last.tolist(), strict=True):
            tail = "".join(map(chr, data[m + 1 : min(m + 3, end)]))
            size = 1 if tail[:1] in tuple("stmd") else 2 if tail in ("re", "ve", "ll") else 0
            if size:
                word[m + 1] = False
                if m + 1 + size < end and kind[m + 1 + size] == 1:
                    word[m + 1 + size] = True
        return np.flatnonzero(word)


class _Windows:
    """Open windows in order of fill; each is (fill, serial, pieces)."""

    def __init__(self, size: int, open_windows: int, slack: int):
        self.size, self.most, self.slack = size, open_windows, slack
        self.open: list[tuple[int, int, list]] = []
        self.serial = 0

    def add(self, piece: tuple, length: int) -> None:
        at = bisect_right(self.open, (self.size - length, 1 << 62, [])) - 1
        fill, serial, held = self.open.pop(at) if at >= 0 else (0, self._next(), [])
        insort(self.open, (fill + length, serial, [*held, (piece, fill, length)] if not held else held + [(piece, fill, length)]))

    def fits(self, length: int) -> bool:
        return len(self.open) < self.most or self.open[0][0] + length <= self.size

    def gap(self) -> int:
        return self.size - self.open[-1][0]

    def pop(self) -> tuple[int, list]:
        _, serial, held = self.open.pop()
        return serial, held

    def _next(self) -> int:
        self.serial += 1
        return self.serial


def _pack_partition(path: str, size: int, open_windows: int, slack: int, id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokenizer = BatchTokenizer(path)
        windows = _Windows(size, open_windows, slack)
        out: list[tuple] = []

        def emit(serial: int, held: list, is_open: bool) -> None:
            name = (part << 36) | serial
            out.extend((*piece, name, offset, part if is_open else -1) for piece, offset, _ in held)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            types = [id_type] + [pa.int64()] * 6 + [pa.int32()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return batch

        for batch in slices(batches, "text"):
            names = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for name, ids in zip(names, tokenizer(texts), strict=True):
                ids = np.append(ids, 0).astype("<u4")
                start, total = 0, len(ids)

                def cut(length: int, name=name, ids=ids, total=total) -> tuple:
                    return (name, start, length, zlib.crc32(ids[start : start + length]), total)  # noqa: B023

                while total - start >= size:
                    emit(windows._next(), [(cut(size), 0, size)], False)
                    start += size
                while total > start:
                    if not windows.fits(total - start):
                        gap = windows.gap()
                        if gap > slack:
                            windows.open[-1][2].append((cut(gap), size - gap, gap))
                            start += gap
                        emit(*windows.pop(), False)
                        continue
                    windows.add(cut(total - start), total - start)
                    start = total
            yield flush()
        for _ in range(len(windows.open)):
            emit(*windows.pop(), True)
        yield flush()

    return giving_back(run)


def _merge(size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        windows = _Windows(size, 1 << 30, 0)
        for i, length in enumerate(rows["length"].tolist()):
            windows.add((i,), length)
        sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for _, serial, held in windows.open:
            for (i,), at, _ in held:
                sequence[i], offset[i] = (1 << 62) | (int(key[0]) << 36) | serial, at
        return rows.assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, open_windows: int = OPEN, slack: int = SLACK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType
    id_type, arrow = kind.simpleString(), to_arrow_type(kind)
    run = _pack_partition(path or default_tokenizer(), size, open_windows, slack, arrow)
    pieces = saved(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {_SCHEMA}"), "pieces")
    left = pieces.where("part >= 0").withColumn("group", F.expr(f"part div {MERGE}"))
    merged = left.groupBy("group").applyInPandas(_merge(size), left.schema)
    return pieces.where("part < 0").drop("part").unionByName(merged.drop("part", "group"))
