"""Retrieval metrics over judged, ranked rows (query_id, rank, relevant, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(judged: DataFrame, k: int = 10) -> DataFrame:
    """One row per query: recall, precision, mrr, ndcg, ap. K is clipped to the number of results; the ideal
    order of nDCG is that of the same results. All are 0 where undefined."""
    query = Window.partitionBy("query_id")
    rows = judged.withColumn("n", F.count(F.lit(1)).over(query)).withColumn("hits", F.sum(F.col("relevant").cast("long")).over(query.orderBy("rank")))
    rows = rows.withColumn("ideal", F.row_number().over(query.orderBy(F.col("grade").desc(), "rank")))
    gain, top = F.pow(F.lit(2.0), "grade") - 1, F.col("rank") <= k
    relevant = F.col("relevant").cast("long")
    out = rows.groupBy("query_id").agg(
        F.sum(F.when(top, relevant).otherwise(0)).alias("found"),
        F.sum(relevant).alias("all"),
        F.least(F.lit(k), F.max("n")).alias("cut"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(F.when(top, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1)).otherwise(0.0)).alias("idcg"),
        F.sum(F.when(F.col("relevant"), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return out.select(
        "query_id",
        ratio(F.col("found").cast("double"), F.col("all")).alias("recall"),
        ratio(F.col("found").cast("double"), F.col("cut")).alias("precision"),
        ratio(F.lit(1.0), F.col("first")).alias("mrr"),
        ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"),
        ratio(F.col("precisions"), F.col("all")).alias("ap"),
    )


def report(per_query: DataFrame) -> DataFrame:
    names = ["recall", "precision", "mrr", "ndcg", "ap"]
    return per_query.agg(*[F.round(F.avg(n), 6).alias(n if n != "ap" else "map") for n in names], F.count(F.lit(1)).alias("queries"))
