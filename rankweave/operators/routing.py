"""Consistent hashing of keys to nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a32

VNODES = 256
SLICES = 256


def ring(spark: SparkSession, nodes: Sequence[str], vnodes: int = VNODES) -> DataFrame:
    """(low, high, node): a key hash h belongs to the node with low < h <= high; the last arc wraps to the first point."""
    names = F.array(*[F.lit(n) for n in nodes])
    points = spark.range(1).select(F.explode(names).alias("node")).select("node", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
    points = points.select(fnv1a32(F.concat("node", F.lit("#"), F.col("v").cast("string"))).alias("high"), "node").groupBy("high").agg(F.min("node").alias("node"))
    ordered = Window.orderBy("high")
    arcs = points.select(F.coalesce(F.lag("high").over(ordered), F.lit(-1)).alias("low"), "high", "node", F.first("node").over(ordered).alias("first"), F.lead("high").over(ordered).isNull().alias("last"))
    wrap = arcs.where("last").select(F.col("high").alias("low"), F.lit(4294967295).cast("long").alias("high"), F.col("first").alias("node"))
    return arcs.select("low", "high", "node").unionByName(wrap).where("low < high")


def assign(keys: DataFrame, column: str, arcs: DataFrame) -> DataFrame:
    """keys with key_hash and node. Arcs (nodes x vnodes + 1 rows) are cut by the top byte of the hash, so the
    as-of lookup is an equi-join with a few arcs per slice."""
    width = (1 << 32) // SLICES
    cut = arcs.withColumn("slice", F.explode(F.sequence(F.floor((F.col("low") + 1) / width), F.floor(F.col("high") / width))))
    hashed = keys.withColumn("key_hash", fnv1a32(F.col(column))).withColumn("slice", F.floor(F.col("key_hash") / width))
    found = hashed.join(F.broadcast(cut), "slice")
    return found.where((F.col("key_hash") > F.col("low")) & (F.col("key_hash") <= F.col("high"))).select(*keys.columns, "key_hash", "node")


def replicas(nodes: Sequence[str], key_hash: int, arcs: Sequence[tuple[int, int, str]], n: int) -> list[str]:
    """The first n distinct nodes clockwise from a hash; arcs are the rows of `ring` on the driver."""
    order = sorted(arcs)
    start = next((i for i, (low, high, _) in enumerate(order) if low < key_hash <= high), 0)
    out: list[str] = []
    for low, high, node in order[start:] + order[:start]:
        if node not in out:
            out.append(node)
        if len(out) == min(n, len(nodes)):
            break
    return out


def addresses(shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """shards (shard_id, replicas), nodes (node, address) -> shard_id, node, address of each shard's primary, its
    first replica; shards without one, or whose primary is unknown, are left out. Both tables are a cluster's size."""
    primary = shards.select("shard_id", F.get("replicas", F.lit(0)).alias("node")).where("node IS NOT NULL")
    return primary.join(nodes, "node").select("shard_id", "node", "address")


def build_shards(corpus: DataFrame, nodes: Sequence[str], path: str, key: str = "id") -> DataFrame:
    """Write the corpus by shard_id and return (shard_id, n)."""
    keyed = corpus.withColumn("__key", F.col(key).cast("string"))
    placed = assign(keyed, "__key", ring(corpus.sparkSession, nodes)).drop("__key", "key_hash").withColumnRenamed("node", "shard_id")
    placed.write.mode("overwrite").partitionBy("shard_id").parquet(path)
    return corpus.sparkSession.read.parquet(path).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
