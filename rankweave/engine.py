"""The engine: ingest records into collections of chunks, search them, keep them.

A record (url, content, metadata, crawled_at, collection_id) goes through the steps of one plan: its
tenant is stamped, its MIME type routed, its text cut into chunks, hooks applied before and after the
cut and before the index, chunks embedded, and all old chunks of its (collection, url) replaced by the
new ones. A stream does the same batch by batch; what cannot be read goes to a table of its own after a
number of tries. Searches read an index of one version of the chunks, built by refresh().
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from threading import Event

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, fusion, lifecycle, search
from .operators.embed import Embedder, HashEmbedder, embedded
from .operators.index import SearchIndex
from .operators.versions import VersionedTable
from .sources import html
from .sources.shared import delete
from .streaming import ingest

CHUNKS = "collection_id string, url string, chunk_idx int, id long, text string, vector array<float>, metadata map<string,string>, tenant string, crawled_at long, ingested_at long, ttl string"
Hook = Callable[[Column], Column]


@dataclass
class Config:
    root: str
    embedder: Embedder = field(default_factory=HashEmbedder)
    chunker: str = "fixed"  # or "semantic", "syntax"
    max_tokens: int = 200
    threshold: float = 0.75
    rate: int = 50
    default_ttl: float = 0.0
    hooks: Mapping[str, Sequence[Hook]] = field(default_factory=dict)  # before_chunk, before_embed, before_index
    cache_rows: int = 10_000
    cache_seconds: float = 300.0


class ResultCache:
    """Least recently used results with a time to live; emptied by every change."""

    def __init__(self, most: int, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.rows: OrderedDict = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key):
        at, value = self.rows.get(key, (None, None))
        if at is None or self.clock() - at > self.seconds:
            self.rows.pop(key, None)
            self.misses += 1
            return None
        self.rows.move_to_end(key)
        self.hits += 1
        return value

    def put(self, key, value) -> None:
        self.rows[key] = (self.clock(), value)
        self.rows.move_to_end(key)
        while len(self.rows) > self.most:
            self.rows.popitem(last=False)


def chunked(records: DataFrame, config: Config) -> DataFrame:
    """records (…, text) -> a row per chunk with chunk_idx and text; a record without text has none."""
    keys = [c for c in records.columns if c != "text"]
    if config.chunker == "syntax":
        pieces = chunking.python_chunks(F.col("text"))
    elif config.chunker == "fixed":
        pieces = chunking.fixed_pieces(F.col("text"), config.max_tokens)
    else:
        told = records.withColumn("doc", F.xxhash64("collection_id", "url"))
        lines = told.select("doc", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "sentence"))
        cut = chunking.semantic_chunks(embedded(lines, config.embedder, "sentence"), config.threshold)
        return told.drop("text").join(cut.select("doc", F.col("chunk").cast("int").alias("chunk_idx"), "text"), "doc").drop("doc")
    return records.select(*keys, F.posexplode(pieces).alias("chunk_idx", "text"))


def to_chunks(records: DataFrame, config: Config, now: int, tenant: str | None = None) -> DataFrame:
    """Parsed records -> rows of the chunk table. The tenant given wins over what the record says."""
    given = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    mime = F.coalesce(F.try_element_at(given, F.lit("mime_type")), F.lit(""))
    text = html.route_by_mime(mime, F.col("content"))
    text = chunking.apply_hooks(text, config.hooks.get("before_chunk", ()))
    meta = stamped(given, tenant).alias("metadata")
    rows = records.select("collection_id", "url", "crawled_at", meta, text.alias("text"))
    # Of records that repeat a url in one batch the last one crawled counts.
    rows = lifecycle.latest(rows, ["collection_id", "url"], [F.col("crawled_at").desc_nulls_last(), F.xxhash64("text")])
    rows = chunked(rows, config).withColumn("text", chunking.apply_hooks(F.col("text"), config.hooks.get("before_embed", ())))
    rows = embedded(rows, config.embedder).withColumn("text", chunking.apply_hooks(F.col("text"), config.hooks.get("before_index", ())))
    rows = chunking.with_chunk_columns(rows)
    owner, ttl = F.coalesce(F.try_element_at("metadata", F.lit("_tenant")), F.lit("")), F.try_element_at("metadata", F.lit("_ttl"))
    return rows.withColumns({"tenant": owner, "ttl": ttl, "ingested_at": F.lit(now).cast("long")})


def stamped(metadata: Column, tenant: str | None) -> Column:
    """The caller's tenant overwrites whatever the metadata claims."""
    if not tenant:
        return metadata
    rest = F.map_filter(metadata, lambda k, _: k != "_tenant")
    return F.map_concat(rest, F.create_map(F.lit("_tenant"), F.lit(tenant)))


class Engine:
    def __init__(self, spark: SparkSession, config: Config, clock: Callable[[], float] = time.time):
        self.spark, self.config, self.clock = spark, config, clock
        self.chunks = VersionedTable(spark, f"{config.root}/chunks", CHUNKS, ["collection_id", "url"])
        self.catalog = lifecycle.Catalog.load(spark, f"{config.root}/catalog")
        self.cache = ResultCache(config.cache_rows, config.cache_seconds)
        self._index: tuple[int, SearchIndex] | None = None

    # Ingest

    def ingest(self, records: DataFrame, tenant: str | None = None, batch: tuple[str, int] | None = None) -> dict:
        """records (url, content, metadata, crawled_at, collection_id), each one readable."""
        rows = to_chunks(records, self.config, int(self.clock()), tenant)
        # Every url that came is replaced, also one that is left without a chunk.
        out = self.chunks.replace(records.select("collection_id", "url"), rows, batch)
        self.cache.rows.clear()
        return out

    def ingest_raw(self, raw: DataFrame, tenant: str | None = None, batch: tuple[str, int] | None = None, tries: int = 3) -> None:
        """raw (value): JSON records. What is unreadable after `tries` readings goes to the dead-letter table."""
        good, bad = ingest.split_poison(ingest.parse(raw))
        path = f"{self.config.root}/dead" + (f"/{batch[0]}-{batch[1]}" if batch else f"/{int(self.clock() * 1000)}")
        bad.withColumn("tries", F.lit(tries)).write.mode("overwrite").json(path)
        self.ingest(good, tenant, batch)

    def stream(self, stream: DataFrame, checkpoint: str, name: str = "stream", tenant: str | None = None, continuous: str | None = None):
        """stream (value). A batch that runs again after a failure changes nothing twice. continuous: a trigger
        interval; without one the stream ends when all that is there is read."""

        def take(rows: DataFrame, number: int) -> None:
            rows = rows.select("value").persist()
            self.ingest_raw(rows, tenant, (name, number))
            rows.unpersist()

        writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name)
        return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()

    def delete_ids(self, ids: DataFrame, filters: Mapping[str, str] | None = None) -> int:
        """Chunks with these ids go (with filters, only those that match); returns how many there were."""
        return self._rewrite(lambda rows: rows.join(ids.select("id"), "id", "left_semi"), filters)

    def delete_where(self, filters: Mapping[str, str]) -> int:
        if not filters:
            raise ValueError("filters must not be empty")
        return self._rewrite(lambda rows: rows, filters)

    def sweep(self) -> int:
        """Expired chunks go; returns how many."""
        now = F.lit(int(self.clock()))
        return self._rewrite(lambda rows: rows.where(lifecycle.expired(now, self.config.default_ttl)), None)

    def _rewrite(self, doomed: Callable[[DataFrame], DataFrame], filters: Mapping[str, str] | None) -> int:
        rows = self.chunks.read()
        for k, v in (filters or {}).items():
            rows = rows.where((F.col(k) if k in ("tenant", "collection_id", "url") else F.try_element_at("metadata", F.lit(k))).eqNullSafe(F.lit(v)))
        gone = doomed(rows).select("collection_id", "url", "chunk_idx").persist()
        n = gone.count()
        if n:
            pages = gone.select("collection_id", "url").distinct()
            kept = self.chunks.read().join(pages, ["collection_id", "url"], "left_semi").join(gone, ["collection_id", "url", "chunk_idx"], "left_anti")
            self.chunks.replace(pages, kept)
            self.cache.rows.clear()
        gone.unpersist()
        return n

    # Search

    def refresh(self) -> SearchIndex:
        """The index of the newest version of the chunks; an older one is deleted."""
        version = self.chunks.manifest()["version"]
        if self._index and self._index[0] == version:
            return self._index[1]
        root = f"{self.config.root}/index-{version}"
        if SearchIndex.exists(self.spark, root):
            index = SearchIndex(self.spark, root)
        else:
            corpus = self.chunks.read().select(F.xxhash64("collection_id", "url", "chunk_idx").alias("id"), F.col("id").alias("chunk_id"), "collection_id", "tenant", "url", "chunk_idx", "text", "vector")
            index = SearchIndex.build(corpus, root, self.config.rate)
        if self._index:
            delete(self.spark, self._index[1].root)
        self._index = (version, index)
        return index

    def search(self, text: str, k: int | None = None, tenant: str | None = None, collections: Sequence[str] | None = None, filters: Mapping[str, str] | None = None, offset: int = 0, page: int = 0) -> dict:
        """{"total", "results"}: the best k, then the page of them. Unknown collections are passed over, none left
        is an error; of several the best of each are joined by rank."""
        k = search.clamp_k(k)
        names = None
        if collections is not None:
            names = sorted({c for c in collections if c in {r["id"] for r in self.catalog.list(tenant or "")}})
            if not names:
                raise KeyError("no such collection")
        key = (text, k, tenant, tuple(names or ()), tuple(sorted((filters or {}).items())), self.chunks.manifest()["version"])
        rows = self.cache.get(key)
        if rows is None:
            index, vector = self.refresh(), self.config.embedder.embed(text)
            allowed = {**(filters or {}), **({"tenant": tenant} if tenant else {})}  # the tenant cannot be overridden
            if names and len(names) == 1:
                allowed["collection_id"] = names[0]
            scored = index.candidates(text, vector, allowed, ["collection_id"])
            if names and len(names) > 1:
                top = search.collections_merged(scored.where(F.col("collection_id").isin(names)), k, "collection_id").orderBy("position")
            else:
                top = fusion.best(scored, k).orderBy(F.col("fused").desc(), "id")
            rows = [r.asDict() for r in top.collect()]
            self.cache.put(key, rows)
        start = max(0, offset)
        return {"total": len(rows), "results": rows[start : start + page] if page > 0 else rows[start:]}

    def search_alias(self, text: str, alias: str, k: int | None = None, filters: Mapping[str, str] | None = None) -> list[dict]:
        """Alias -> collections as shards, with its filters under the caller's; the best k of each shard are merged by
        the sum of their rank contributions."""
        shards, allowed = self.catalog.resolve_alias(alias, filters)
        scored = self.refresh().candidates(text, self.config.embedder.embed(text), allowed, ["collection_id"])
        lists = fusion.best(scored.where(F.col("collection_id").isin(shards)), search.clamp_k(k), "collection_id")
        merged = search.shard_merge(lists.select("id", F.col("position").alias("rank"), "bm25"), search.clamp_k(k))
        return [r.asDict() for r in merged.collect()]

    def sweep_until(self, stopped: Event, seconds: float = 600.0) -> int:
        """Sweep now and then every so many seconds, until told to stop; returns how many chunks went."""
        n = self.sweep()
        while not stopped.wait(seconds):
            n += self.sweep()
        return n

    def rag(self, text: str, k: int | None = None, tenant: str | None = None) -> dict:
        """{"context", "citations"}: numbered texts of the best k."""
        found = self.search(text, search.clamp_k(k, 5, None), tenant)["results"]
        if not found:
            return {"context": "", "citations": []}
        texts = {r["id"]: r["text"] for r in self.refresh().table("texts").where(F.col("id").isin([r["id"] for r in found])).collect()}
        cited = [(n, r["id"], texts.get(r["id"])) for n, r in enumerate(found, 1)]
        return {"context": "\n\n".join(f"[{n}] {t}" for n, _, t in cited if t is not None), "citations": cited}

    def stats(self) -> dict:
        row = self.chunks.read().agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("collection_id", "url").alias("documents"), F.countDistinct("collection_id").alias("collections")).first()
        return {**row.asDict(), "version": self.chunks.manifest()["version"], "cache_hits": self.cache.hits, "cache_misses": self.cache.misses}
