"""Intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, shared_dir

BROADCAST_BYTES = 16 << 20


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: the lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Saved tables that are deleted at the end of a with block, but for those that were kept.

    with Scratch(spark, "near") as s:
        a = s.saved(df, "a")             # goes at the end
        b = s.saved(a.join(...), "b", keep=True)   # stays, for the frame that is returned
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def saved(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        self.n += 1
        path = f"{self.root}-kept/{self.n}-{name}" if keep else f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        delete(self.spark, self.root)
        if error[0]:
            delete(self.spark, f"{self.root}-kept")


def sent_if_small(df: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast if its values measure at most BROADCAST_BYTES; else as it
    is, for a join by shuffle. Columns are strings, binaries or at most 8 bytes wide."""
    wide = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = sum(wide, F.count(F.lit(1)) * 8 * len(df.columns))
    return F.broadcast(df) if df.agg(size.alias("size")).first()["size"] <= BROADCAST_BYTES else df
