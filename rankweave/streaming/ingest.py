"""Streaming ingest: parse, skip poison, dedup, rate limit, upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORD = "url string, content string, metadata map<string,string>, crawled_at bigint, collection_id string"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def kafka_source(stream, servers: str, topic: str, per_trigger: int = 50_000) -> DataFrame:
    """stream is spark.readStream. The checkpoint keeps the offsets; maxOffsetsPerTrigger holds back pressure."""
    return stream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger)}).load()


def parse(raw: DataFrame) -> DataFrame:
    """raw (value) -> record columns and `error`, null where the record is good."""
    rec = F.from_json(F.col("value").cast("string"), RECORD)
    out = raw.withColumn("r", rec)
    error = F.when(F.col("r").isNull() | F.col("r.url").isNull(), F.lit("undecodable")).when(F.coalesce(F.length("r.content"), F.lit(0)) == 0, F.lit("empty"))
    collection = F.coalesce(F.try_element_at("r.metadata", F.lit("_collection_id")), "r.collection_id", F.lit("_default"))
    return out.select("value", "r.url", "r.content", "r.metadata", "r.crawled_at", collection.alias("collection_id"), error.alias("error"))


def split_poison(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.where("error IS NULL").drop("error", "value"), parsed.where("error IS NOT NULL").select("value", "error")


def idempotent(events: DataFrame, key: str, ts: str, window: str = "24 hours") -> DataFrame:
    """On a stream: the first event of a key within the window of the watermark."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])


def first_by_key(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The batch form: one row per key, the first in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def idempotent_batch(events: DataFrame, key: str, ts: str, row_id: str, life: float = 86400.0) -> DataFrame:
    """The batch form: an event is new if no new one of its key came within `life` seconds before it. One sorted
    pass; a key holds one time."""
    return rate_limited_batch(events, key, ts, 1, life, row_id).where("admitted").drop("admitted")


def acks(parsed: DataFrame, key: str, order: str) -> DataFrame:
    """parsed records -> the same with status: ERROR what is unreadable, SKIPPED what repeats a key, else OK."""
    keyed = F.col("error").isNull() & F.col(key).isNotNull()
    turn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    told = parsed.where(keyed).withColumn("status", F.when(turn > 1, "SKIPPED").otherwise("OK"))
    return told.unionByName(parsed.where(~keyed).withColumn("status", F.when(F.col("error").isNotNull(), "ERROR").otherwise("OK")))


def dead_workers(beats: DataFrame, worker: str, ts: str, now: Column, silence: float = 9.0) -> DataFrame:
    """Workers whose last beat is more than `silence` seconds before now."""
    last = beats.groupBy(worker).agg(F.max(ts).alias("last_seen"))
    return last.where((_micros(now) - _micros(F.col("last_seen"))) / F.lit(1e6) > silence)


def requeued(assigned: DataFrame, acked: DataFrame, dead: DataFrame, worker: str) -> DataFrame:
    """assigned (worker, url) that dead workers had not acknowledged: they go back to the frontier, once each."""
    return assigned.join(dead.select(worker), worker, "left_semi").join(acked.select(worker, "url"), [worker, "url"], "left_anti").select("url").distinct()


def to_topic(records: DataFrame, servers: str, topic: str) -> None:
    """records (url, …) as JSON to a Kafka topic, keyed by url, so that a url keeps its partition and its order."""
    rows = records.select(F.col("url").alias("key"), F.to_json(F.struct(*records.columns)).alias("value"))
    rows.write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}).save()


class Progress(StreamingQueryListener):
    """Rows, rates and lag of streams by name, as each batch ends."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event):
        self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event):
        p = event.progress
        name = p.name or str(p.id)
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        lags = [int(float(s.metrics["maxOffsetsBehindLatest"])) for s in p.sources if "maxOffsetsBehindLatest" in (s.metrics or {})]
        self.last[name] = {"batch": p.batchId, "rows_per_second": p.processedRowsPerSecond, "lag": max(lags, default=0)}

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def heartbeat_gaps(beats: DataFrame, worker: str, ts: str, silence: float = 9.0) -> DataFrame:
    """worker, ts, gap_seconds of every beat that came after more than `silence` seconds."""
    before = F.lag(ts).over(Window.partitionBy(worker).orderBy(ts))
    gap = (_micros(F.col(ts)) - _micros(before)) / F.lit(1e6)
    return beats.select(worker, ts, F.round(gap, 3).alias("gap_seconds")).where(F.col("gap_seconds") > silence)


def admit(times: list[float], held: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Sliding window: an event at t is admitted if fewer than `limit` admitted ones lie in (t - window, t]; a denied one is not recorded."""
    out, live = [], list(held)
    for t in times:
        live = [x for x in live if x > t - window]
        out.append(len(live) < limit)
        if out[-1]:
            live.append(t)
    return out, live


def rate_limited(events: DataFrame, domain: str, ts: str, limit: int, window: float, row_id: str) -> DataFrame:
    """On a stream: (row_id, domain, admitted), with the admitted times of each domain (at most `limit`) as state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["__t", row_id], kind="stable")
        flags, live = admit(rows["__t"].tolist(), list(state.get[0]) if state.exists else [], limit, window)
        state.update((live,))
        yield pd.DataFrame({row_id: rows[row_id], domain: key[0], "admitted": flags})

    kinds = dict(events.dtypes)
    timed = events.select(row_id, domain, (_micros(F.col(ts)) / F.lit(1e6)).alias("__t"))
    return timed.groupBy(domain).applyInPandasWithState(run, f"{row_id} {kinds[row_id]}, {domain} {kinds[domain]}, admitted boolean", "live array<double>", "append", GroupStateTimeout.NoTimeout)


def rate_limited_batch(events: DataFrame, domain: str, ts: str, limit: int, window: float, row_id: str) -> DataFrame:
    """The batch form: each domain streams through one sorted pass; only `limit` times are held for it."""
    kinds = dict(events.dtypes)
    timed = events.select(row_id, domain, (_micros(F.col(ts)) / F.lit(1e6)).alias("__t")).repartition(domain).sortWithinPartitions(domain, "__t", row_id)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, live = None, []
        for rows in frames:
            flags = []
            for d, t in zip(rows[domain], rows["__t"], strict=True):
                if d != key:
                    key, live = d, []
                ok, live = admit([t], live, limit, window)
                flags += ok
            yield pd.DataFrame({row_id: rows[row_id], domain: rows[domain], "admitted": flags})

    return timed.mapInPandas(run, f"{row_id} {kinds[row_id]}, {domain} {kinds[domain]}, admitted boolean")


def frontier(urls: DataFrame, seen: DataFrame, order: str, most: int) -> DataFrame:
    """New urls, one each, in order, up to the limit of pages of a crawl."""
    return first_by_key(urls, "url", order).join(seen.select("url"), "url", "left_anti").orderBy(order, "url").limit(most)


def assigned(frontier_rows: DataFrame, workers: Sequence[str], order: str, poll: int = 10) -> DataFrame:
    """The first urls of a frontier dealt to workers in turn, `poll` to each at most: one poll of every worker."""
    turn = F.row_number().over(Window.orderBy(order, "url")) - 1
    names = F.array(*[F.lit(w) for w in workers])
    rows = frontier_rows.orderBy(order, "url").limit(poll * len(workers))  # as many as the workers take
    return rows.withColumn("worker", F.element_at(names, (turn % len(workers) + 1).cast("int")))


def start(stream: DataFrame, checkpoint: str, write_good: Callable[[DataFrame, int], None], write_bad: Callable[[DataFrame, int], None]):
    """Run to the end of what is there. Writers get (rows, batch id) and must be idempotent by it."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        good, bad = split_poison(parse(rows))
        write_good(good, batch_id)
        write_bad(bad, batch_id)
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
