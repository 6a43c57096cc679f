"""A table of Parquet files whose rows can be replaced, deleted and snapshotted.

Rows lie in buckets by a hash of their key. A change rewrites the buckets it touches into a new
folder; then one small manifest, a JSON file with the folder of each bucket, is written under the
next version. A reader sees one whole version, a change that fails leaves nothing behind that is read,
and a change that is repeated under the same batch number is skipped. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import delete, exists


class Damaged(OSError):
    """A manifest whose checksum does not hold."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, key: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root, list(key), buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> dict:
        """The newest manifest: version, folder of each bucket, batches taken in. Its checksum is verified."""
        if not exists(self.spark, f"{self.root}/manifests"):
            return {"version": 0, "paths": {}, "batches": {}}
        row = self.spark.read.schema("version long, crc long, body string").json(f"{self.root}/manifests").orderBy(F.col("version").desc()).first()
        if zlib.crc32((row["body"] or "").encode()) != row["crc"]:
            raise Damaged(f"{self.root}: the manifest of version {row['version']} is damaged")
        return json.loads(row["body"])

    def _commit(self, manifest: dict) -> None:
        body = json.dumps(manifest, sort_keys=True)
        row = self.spark.range(1).select(F.lit(manifest["version"]).cast("long").alias("version"), F.lit(zlib.crc32(body.encode())).cast("long").alias("crc"), F.lit(body).alias("body"))
        row.coalesce(1).write.mode("append").json(f"{self.root}/manifests")

    def read(self, manifest: dict | None = None, only: Sequence[int] | None = None) -> DataFrame:
        paths = (manifest or self.manifest())["paths"]
        found = [p for b, p in sorted(paths.items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def replace(self, gone: DataFrame | None, rows: DataFrame | None, batch: tuple[str, int] | None = None) -> dict:
        """Rows whose key is in `gone` (the key columns) go, `rows` come. (stream, number) of a batch that was
        taken in before leaves all as it is."""
        now = self.manifest()
        if batch and now["batches"].get(batch[0], -1) >= batch[1]:
            return now
        rows = rows if rows is not None else self.spark.createDataFrame([], self.schema)
        rows = rows.select([F.col(f.name).cast(f.dataType) for f in self.schema.fields]).withColumn("__bucket", self._bucket())
        keys = gone.select(*self.key).distinct() if gone is not None else None
        touched = rows.select("__bucket")
        if keys is not None:
            touched = touched.union(keys.select(self._bucket().alias("__bucket")))
        touched = sorted(r[0] for r in touched.distinct().collect())  # as many as there are buckets
        if touched:
            old = self.read(now, touched).withColumn("__bucket", self._bucket())
            if keys is not None:
                old = old.join(keys.withColumnsRenamed({k: f"__{k}" for k in self.key}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.key], "left_anti")
            path = f"{self.root}/data/{uuid.uuid4().hex}"
            old.unionByName(rows).repartition("__bucket").write.partitionBy("__bucket").parquet(path)
            held = {b for b in touched if exists(self.spark, f"{path}/__bucket={b}")}
            now["paths"] = {b: p for b, p in now["paths"].items() if int(b) not in touched} | {str(b): f"{path}/__bucket={b}" for b in held}
        now["version"] += 1
        if batch:
            now["batches"][batch[0]] = batch[1]
        self._commit(now)
        return now

    def vacuum(self) -> int:
        """Delete the folders that the newest version does not read; returns how many."""
        if not exists(self.spark, f"{self.root}/data"):
            return 0
        live = {p.rsplit("/", 2)[1] for p in self.manifest()["paths"].values()}
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        store = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        dead = [s.getPath().toString() for s in store.listStatus(target) if s.getPath().getName() not in live]
        for p in dead:
            delete(self.spark, p)
        return len(dead)

    def snapshot(self, name: str) -> dict:
        """Keep the present version under a name."""
        now = self.manifest()
        copy = f"{self.root}/snapshots/{name}"
        self.read(now).withColumn("__bucket", self._bucket()).write.partitionBy("__bucket").parquet(f"{copy}/data")
        kept = {b: f"{copy}/data/__bucket={b}" for b in now["paths"]}
        body = json.dumps(now | {"paths": kept}, sort_keys=True)
        self.spark.range(1).select(F.lit(zlib.crc32(body.encode())).cast("long").alias("crc"), F.lit(body).alias("body")).coalesce(1).write.json(f"{copy}/manifest")
        return now

    def restore(self, name: str) -> dict:
        """Make a snapshot the newest version, once its checksum holds."""
        row = self.spark.read.schema("crc long, body string").json(f"{self.root}/snapshots/{name}/manifest").first()
        if zlib.crc32((row["body"] or "").encode()) != row["crc"]:
            raise Damaged(f"snapshot {name} is damaged")
        now = json.loads(row["body"]) | {"version": self.manifest()["version"] + 1}
        self._commit(now)
        return now
