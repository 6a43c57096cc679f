"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
from collections import OrderedDict

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a session in one process (tests) gets
    a temporary one; on a cluster, whose machines do not share such a folder, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rankweave-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    target, store = _path(spark, path)
    store.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, store = _path(spark, path)
    return store.exists(target)


class ObjectStore:
    """Named objects below a folder of any file system that Spark reaches, with a local cache of the last used, bounded by bytes."""

    def __init__(self, spark: SparkSession, root: str, cache_bytes: int = 64 << 20):
        self.spark, self.root, self.most = spark, root.rstrip("/"), cache_bytes
        self.cache: OrderedDict[str, bytes] = OrderedDict()

    def _at(self, name: str):
        if not name or name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"not a name of an object: {name!r}")
        return _path(self.spark, f"{self.root}/{name}")

    def _keep(self, name: str, body: bytes) -> None:
        self.cache.pop(name, None)
        if len(body) <= self.most:
            self.cache[name] = body
        while sum(map(len, self.cache.values())) > self.most:
            self.cache.popitem(last=False)

    def put(self, name: str, body: bytes) -> None:
        target, store = self._at(name)
        out = store.create(target, True)
        try:
            out.write(bytearray(body))
        finally:
            out.close()
        self._keep(name, body)

    def get(self, name: str) -> bytes:
        if name not in self.cache:
            target, store = self._at(name)
            if not store.exists(target):
                raise FileNotFoundError(name)
            stream = store.open(target)
            try:
                body = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
            self._keep(name, body)
            return body
        self.cache.move_to_end(name)
        return self.cache[name]

    def list(self, prefix: str = "") -> list[str]:
        base, store = _path(self.spark, self.root)
        if not store.exists(base):
            return []
        found, files = [], store.listFiles(base, True)
        start = len(store.getFileStatus(base).getPath().toString()) + 1
        while files.hasNext():
            name = files.next().getPath().toString()[start:]
            if name.startswith(prefix):
                found.append(name)
        return sorted(found)

    def delete(self, name: str) -> None:
        target, store = self._at(name)
        store.delete(target, False)
        self.cache.pop(name, None)
