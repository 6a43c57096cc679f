"""Exact dedup by a heavy-hitter split.

1. Every row gets the SHA-256 of its text, lower-cased in A-Z only.
2. Misra-Gries counters (DataFrame.freqItems, at most 1/support of them) name every digest that
   can hold more than `support` of all rows. They may also name rare ones, so an exact partial
   aggregate verifies the count and finds the winner of each, a single row.
3. The verified winners, at most 1/support rows, are broadcast. A losing row of a heavy digest is
   settled where it lies and never shuffled.
4. All other rows, whose digests hold less than `support` of the rows each, are shuffled by digest.

Defined cases: a null text counts as empty, so null and empty texts are copies. The row with the
largest doc_id stays; a null doc_id is smaller than any other. Rows that repeat both doc_id and
text leave exactly one of them. Empty tables give empty results. Other columns are untouched.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

SUPPORT = 0.001


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def heavy_winners(digests: DataFrame, best: Column, support: float = SUPPORT) -> DataFrame:
    """(digest, hot_best, hot_n) of the digests with more than one row among the Misra-Gries candidates."""
    candidates = digests.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    heavy = digests.join(F.broadcast(candidates), "digest", "left_semi")
    return heavy.groupBy("digest").agg(F.max(best).alias("hot_best"), F.count(F.lit(1)).alias("hot_n")).where("hot_n > 1")


def dedup_report(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    uid = F.monotonically_increasing_id().alias("uid")  # the saved table gives every row its own
    digests = saved(docs.select("doc_id", uid, digest(F.col("text")).alias("digest")), "digests")
    tagged = digests.join(F.broadcast(heavy_winners(digests, F.struct("doc_id", "uid"), support)), "digest", "left")
    settled = F.col("hot_n").isNotNull() & (F.col("uid") != F.col("hot_best.uid"))
    losers = tagged.where(settled).select(
        "doc_id", F.col("hot_best.doc_id").alias("keep_id"), F.col("hot_n").alias("group_size"), F.lit(False).alias("kept"), F.col("digest").alias("text_sha256")
    )
    group = Window.partitionBy("digest")
    rest = tagged.where(~settled).select(
        "doc_id",
        F.max("doc_id").over(group).alias("keep_id"),
        F.coalesce("hot_n", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())) == 1).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return losers.unionByName(rest)


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns. The filter on the rank is taken in each task
    before the shuffle as well, so of rows that repeat doc_id and text one a task is moved."""
    digests = saved(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    winners = heavy_winners(digests, F.col("doc_id"), support).withColumnsRenamed({"digest": "__rw_digest", "hot_best": "__rw_keep", "hot_n": "__rw_n"})
    rows = docs.withColumn("__rw_digest", digest(F.col("text"))).join(F.broadcast(winners), "__rw_digest", "left")
    rows = rows.where(F.col("__rw_n").isNull() | F.col("doc_id").eqNullSafe(F.col("__rw_keep")))
    first = Window.partitionBy("__rw_digest").orderBy(F.col("doc_id").desc_nulls_last())
    return rows.withColumn("__rw_rank", F.row_number().over(first)).where("__rw_rank = 1").select(*docs.columns)
