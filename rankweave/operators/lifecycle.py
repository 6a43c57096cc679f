"""Upsert, delete, expiry, compaction, snapshots, aliases and collections."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import exists
from .ann import route

MAX_COLLECTIONS = 100
DEFAULT_COLLECTION = "_default"


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")


def upsert(corpus: DataFrame, changes: DataFrame, key: str = "id", order: Sequence[Column] = ()) -> DataFrame:
    """Changes replace rows of their key. Of changes that repeat a key the last in `order` (columns, the largest
    last) counts; rows that are equal in it, or all where none is given, are told apart by their content."""
    content = F.xxhash64(*[c for c, kind in changes.dtypes if "map<" not in kind])
    last = latest(changes, [key], [*[c.desc() for c in order], content.desc()])
    return corpus.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def apply_changes(corpus: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """changes carry `action` (upsert or delete), emitted_at and, to break ties of it, `arrival` where there is one;
    the last change of a key counts, deletes take effect. Changes that tie in both are ordered by content, a delete last."""
    arrival = [F.col("arrival").desc()] if "arrival" in changes.columns else []
    content = F.xxhash64(*[c for c, kind in changes.dtypes if "map<" not in kind])
    last = latest(changes, [key], [F.col("emitted_at").desc(), *arrival, F.col("action"), content.desc()])
    return corpus.join(last.select(key), key, "left_anti").unionByName(last.where("action <> 'delete'").drop("action", "emitted_at", "arrival"), allowMissingColumns=True)


def replace_by_url(corpus: DataFrame, chunks: DataFrame) -> DataFrame:
    """All old chunks of a url go before its new ones come."""
    return corpus.join(chunks.select("url").distinct(), "url", "left_anti").unionByName(chunks, allowMissingColumns=True)


def _matches(filters: Mapping[str, str]) -> Column:
    if not filters:
        raise ValueError("filters must not be empty")
    out = F.lit(True)
    for k, v in filters.items():
        out = out & F.col(k).eqNullSafe(F.lit(v))
    return out


def delete_ids(corpus: DataFrame, ids: DataFrame, filters: Mapping[str, str] | None = None) -> DataFrame:
    """Rows whose id is listed go; with filters, only those that match them."""
    doomed = corpus.where(_matches(filters)).select("id").join(ids, "id", "left_semi") if filters else ids
    return corpus.join(doomed, "id", "left_anti")


def delete_where(corpus: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    return corpus.where(~_matches(filters))


def expired(now: Column, default_ttl: float = 0) -> Column:
    """An explicit `ttl` with `ingested_at` counts; the default on `crawled_at` counts as well (either expires a row). Times are unix seconds."""
    own = now > F.col("ingested_at") + T.duration_seconds(F.col("ttl"))
    base = (now > F.col("crawled_at") + F.lit(default_ttl)) if default_ttl > 0 else F.lit(False)
    return F.coalesce(own, F.lit(False)) | F.coalesce(base, F.lit(False))


def sweep(corpus: DataFrame, now: Column, default_ttl: float = 0) -> DataFrame:
    return corpus.where(~expired(now, default_ttl))


def compact(corpus: DataFrame, rate: int) -> DataFrame:
    """Route the live rows anew."""
    return route(corpus, rate)


class Snapshots:
    """Versioned Parquet folders with a manifest; the newest manifest is the current version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def save(self, corpus: DataFrame, partition: str = "shard_id") -> dict:
        version = uuid.uuid4().hex
        path = f"{self.root}/v-{version}"
        corpus.write.partitionBy(partition).parquet(path)
        counts = {str(r[0]): r[1] for r in self.spark.read.parquet(path).groupBy(partition).count().collect()}
        manifest = {"version": version, "path": path, "shards": sorted(counts), "doc_count": sum(counts.values())}
        row = self.spark.range(1).select(F.lit(json.dumps(manifest)).alias("value"), F.current_timestamp().alias("at"))
        row.write.mode("append").parquet(f"{self.root}/manifests")  # the pointer moves only when all data is there
        return manifest

    def current(self) -> dict:
        row = self.spark.read.parquet(f"{self.root}/manifests").orderBy(F.col("at").desc()).first()
        return json.loads(row["value"])

    def load(self) -> DataFrame:
        return self.spark.read.parquet(self.current()["path"])


def alias_filters(alias: Mapping[str, str], user: Mapping[str, str]) -> dict[str, str]:
    """The caller's filters win over the alias's."""
    return {**alias, **user}


def valid_collection(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9._-]{1,64}", name)) and name not in (".", "..")


class Catalog:
    """Collections with owner, status and connectors, and aliases: a small state that the driver keeps and stores."""

    MOVES = {("active", "paused"), ("paused", "active"), ("active", "deleting"), ("paused", "deleting"), ("error", "active"), ("active", "error")}

    def __init__(self, rows: Sequence[dict] = ()):
        self.rows = {r["id"]: dict(r) for r in rows if r["status"] != "deleting"}
        self.rows.setdefault(DEFAULT_COLLECTION, {"id": DEFAULT_COLLECTION, "tenant": "", "status": "active", "config": {}, "connectors": []})
        self.aliases: dict[str, dict] = {}

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Catalog:
        """The newest stored state; collections that were being deleted are gone."""
        if not exists(spark, root):
            return cls()
        row = spark.read.schema("at long, body string").json(root).orderBy(F.col("at").desc()).first()
        state = json.loads(row["body"])
        out = cls(state["collections"])
        out.aliases = state["aliases"]
        return out

    def store(self, spark: SparkSession, root: str) -> None:
        last = spark.read.schema("at long, body string").json(root).agg(F.max("at")).first()[0] if exists(spark, root) else None
        body = json.dumps({"collections": list(self.rows.values()), "aliases": self.aliases}, sort_keys=True)
        spark.range(1).select(F.lit((last or 0) + 1).cast("long").alias("at"), F.lit(body).alias("body")).coalesce(1).write.mode("append").json(root)

    def set_alias(self, name: str, shards: Sequence[str], filters: Mapping[str, str] | None = None) -> dict:
        """Create an alias, or swap what it points to in one step."""
        if not valid_collection(name) or not shards:
            raise ValueError("an alias needs a valid name and shards")
        self.aliases[name] = {"shards": list(shards), "filters": dict(filters or {})}
        return self.aliases[name]

    def resolve_alias(self, name: str, user: Mapping[str, str] | None = None) -> tuple[list[str], dict[str, str]]:
        """Shards of an alias, and its filters under those of the caller."""
        found = self.aliases[name]
        return list(found["shards"]), alias_filters(found["filters"], user or {})

    def delete_alias(self, name: str) -> None:
        del self.aliases[name]

    def create(self, name: str, tenant: str = "", config: dict | None = None) -> dict:
        if not valid_collection(name):
            raise ValueError(f"not a collection id: {name!r}")
        if name in self.rows:
            raise ValueError(f"{name} exists")
        if len(self.rows) >= MAX_COLLECTIONS:
            raise ValueError("too many collections")
        self.rows[name] = {"id": name, "tenant": tenant, "status": "active", "config": config or {}, "connectors": []}
        return self.rows[name]

    def get(self, name: str, tenant: str = "") -> dict:
        row = self.rows.get(name)
        if not row or (tenant and row["tenant"] != tenant):
            raise KeyError(name)  # a foreign collection looks like none
        return row

    def list(self, tenant: str = "") -> list[dict]:
        return [r for _, r in sorted(self.rows.items()) if not tenant or r["tenant"] == tenant]

    def update(self, name: str, tenant: str = "", status: str | None = None, config: dict | None = None) -> dict:
        row = self.get(name, tenant)
        if status and status != row["status"]:
            if (row["status"], status) not in self.MOVES:
                raise ValueError(f"{row['status']} cannot become {status}")
            row["status"] = status
        row["config"] |= config or {}
        return row

    def delete(self, name: str, tenant: str = "") -> None:
        if name == DEFAULT_COLLECTION:
            raise ValueError("the default collection stays")
        self.get(name, tenant)
        del self.rows[name]

    def bind(self, name: str, connector: str) -> None:
        if connector not in self.get(name)["connectors"]:
            self.rows[name]["connectors"].append(connector)

    def unbind(self, name: str, connector: str) -> None:
        self.get(name)["connectors"].remove(connector)

    def resolved(self, name: str, defaults: Mapping) -> dict:
        """Zero and empty values inherit the global ones."""
        return {**defaults, **{k: v for k, v in self.get(name)["config"].items() if v}}


def replay(commands: DataFrame) -> DataFrame:
    """commands (version, kind, key, value, deleted) -> the live value of each (kind, key): the latest command wins."""
    return latest(commands, ["kind", "key"], [F.col("version").desc()]).where("NOT deleted").select("kind", "key", "value", "version")
