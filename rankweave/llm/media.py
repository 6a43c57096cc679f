"""Media columns: content-addressed payloads in tar shards.

A payload of 8-bit samples becomes a greyscale PNG image, WIDTH samples a row, which is lossless.
Images are appended to tar shards in the shared folder, each under the SHA-256 of its bytes, and
once in a shard however many rows have it; a row carries digest, shard, offset and length.
When a shard is closed, metadata columns are filled from range reads of the first 33 bytes of each
image (signature and IHDR); features come from reading the stored image back in full.

A shard belongs to one attempt of one task and has a random name, so a task that runs again writes
new shards and rows never point into a file that another attempt has left. Memory is bounded by
one batch of texts and the index of one shard, which is closed at SHARD_BYTES.

Defined cases: a null text is empty; an empty text is WIDTH spaces. Equal texts give equal images,
digests and features. Repeated rows share one stored image in a shard. An empty table writes none.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .arrays import giving_back, slices
from .storage import shared_dir

WIDTH = 192
SHARD_BYTES = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" "), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", head[16:25])


def from_png(image: bytes) -> bytes:
    width, height, _ = read_header(image[:HEADER])
    at, body = HEADER, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            body.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature_of(payload: bytes, width: int, height: int) -> str:
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    total, levels = counts.sum(), np.arange(256)
    mean = float((counts * levels).sum() / total)
    spread = float(np.sqrt((counts * (levels - mean) ** 2).sum() / total))
    bands = counts.reshape(8, 32).sum(axis=1)
    return f"png:{width}x{height};mean={mean:.4f};std={spread:.4f};distinct={int((counts > 0).sum())};bands={'/'.join(map(str, bands.tolist()))}"


class Shard:
    """One tar file of images, written once and then read by ranges."""

    def __init__(self, store: fs.FileSystem, folder: str):
        self.store, self.path = store, f"{folder}/{uuid.uuid4().hex}.tar"
        self.out, self.size = store.open_output_stream(self.path), 0
        self.index: dict[bytes, tuple[int, int, str]] = {}
        self.rows: list[tuple] = []

    def add(self, row: tuple, payload: bytes) -> None:
        key = hashlib.sha256(payload).digest()
        if key not in self.index:
            image = to_png(payload)
            digest = hashlib.sha256(image).hexdigest()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            for part in (info.tobuf(tarfile.USTAR_FORMAT), image, b"\0" * (-len(image) % 512)):
                self.out.write(part)
            self.index[key] = (self.size + 512, len(image), digest)
            self.size += 512 + len(image) + -len(image) % 512
        self.rows.append((*row, *self.index[key]))

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()

    def read(self) -> Iterator[tuple]:
        with self.store.open_input_file(self.path) as file:
            known: dict[int, tuple] = {}
            for doc_id, n_bytes, offset, length, digest in self.rows:
                if offset not in known:
                    width, height, depth = read_header(file.read_at(HEADER, offset))
                    image = file.read_at(length, offset)
                    payload = from_png(image)
                    if hashlib.sha256(image).hexdigest() != digest:
                        raise OSError(f"{self.path}: stored bytes at {offset} are damaged")
                    known[offset] = (width, height, depth, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature_of(payload, width, height))
                width, height, depth, size, sha, tail, feature = known[offset]
                yield doc_id, n_bytes, size, sha, tail, length, digest, feature, self.path, offset, width, height, depth


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height", "depth"]
_TYPES = ["long", "long", "long", "string", "long", "long", "string", "string", "string", "long", "int", "int", "int"]
_ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
    types = [id_type, *(_ARROW[t] for t in _TYPES[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)


def store_media(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document with the digest, place and header fields of its stored image."""
    root = folder or f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    root = root if "://" in root else f"file://{root}"
    kind = docs.schema["doc_id"].dataType
    id_name, id_type = kind.simpleString(), to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(root)
        store.create_dir(path, recursive=True)
        shard = None
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                shard = shard or Shard(store, path)
                payload, n_bytes = payload_of(text)
                shard.add((doc_id, n_bytes), payload)
                if shard.size >= shard_bytes:
                    shard.close()
                    yield _batch(list(shard.read()), id_type)
                    shard = None
        if shard:
            shard.close()
            yield _batch(list(shard.read()), id_type)

    schema = ", ".join(f"`{n}` {t}" for n, t in zip(NAMES, [id_name, *_TYPES[1:]], strict=True))
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), schema)
