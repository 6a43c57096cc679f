"""Search: BM25, filters, exact nearest neighbours, rank fusion, citations.

A corpus is a DataFrame with id, text, vector and any metadata columns. Scoring is a projection:
term counts of the few query terms are taken inside each row, one small aggregate gives the corpus
statistics, and top-k is TakeOrdered. Nothing is exploded and no row is shuffled before ranking.
Ranks go by scores rounded to 6 places, then id, so they do not depend on the order of sums.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from . import fusion
from .fusion import RRF

K1, B = 1.2, 0.75
DEFAULT_K, MAX_K = 10, 1000


def clamp_k(k: int | None, default: int = DEFAULT_K, most: int | None = MAX_K) -> int:
    k = default if not k or k <= 0 else k
    return min(k, most) if most else k


def filtered(corpus: DataFrame, filters: Mapping[str, str] | None) -> DataFrame:
    """Conjunction of exact matches; on real columns these reach the Parquet scan."""
    for key, value in (filters or {}).items():
        corpus = corpus.where(F.col(key) == F.lit(value))
    return corpus


def tenant_scoped(corpus: DataFrame, tenant: str | None, column: str = "tenant") -> DataFrame:
    """The caller's filters cannot override this one: it is applied to the corpus before any query."""
    return corpus if not tenant else corpus.where(F.col(column) == tenant)


def query_terms(text: str) -> list[str]:
    """Lower-cased runs of letters and decimal digits, as tokens() splits texts, each once."""
    runs, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            word += c
        elif word:
            runs.append(word)
            word = ""
    return list(dict.fromkeys(runs))


def _equals(word: str):
    return lambda token: token == word


def bm25(corpus: DataFrame, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """corpus with `bm25`, rounded to 6 places; 0 where no term matches. idf = ln(1 + (N - df + .5) / (df + .5))."""
    terms = query_terms(text)
    rows = corpus.withColumn("__tokens", T.tokens(F.col("text")))
    tf = [F.size(F.filter("__tokens", _equals(w))) for w in terms]
    rows = rows.select(*corpus.columns, F.size("__tokens").alias("__len"), *[c.alias(f"__tf{i}") for i, c in enumerate(tf)])
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("__len").alias("len"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)) if stats["n"] else 0.0
        f = F.col(f"__tf{i}").cast("double")
        score = score + F.lit(idf) * f / (f + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("__len") / F.lit(float(stats["len"] or 1))))
    return rows.select(*corpus.columns, F.round(score, 6).alias("bm25"))


def text_search(corpus: DataFrame, text: str, filters: Mapping[str, str] | None = None, k: int = DEFAULT_K, offset: int = 0) -> DataFrame:
    """Match with OR semantics. With filters the text only scores; alone it must match; without either all match."""
    scored = bm25(corpus, text) if query_terms(text) else corpus.withColumn("bm25", F.lit(0.0))
    if query_terms(text) and not filters:
        scored = scored.where("bm25 > 0")
    return filtered(scored, filters).orderBy(F.col("bm25").desc(), "id").offset(offset).limit(k)


def knn(corpus: DataFrame, vector: Sequence[float], k: int = DEFAULT_K, metric: str = "cosine") -> DataFrame:
    expression, ascending = V.METRICS[metric]
    scored = corpus.withColumn("score", F.round(expression(F.col("vector"), V.literal(vector)), 6))
    return scored.orderBy(F.col("score").asc() if ascending else F.col("score").desc(), "id").limit(k)


def _rank(*order: Column | str) -> Column:
    return F.row_number().over(Window.orderBy(*order)).cast("long")


def rrf(scored: DataFrame, k: int, partition: Sequence[str] = ()) -> DataFrame:
    """Fuse ranks by bm25 and by cosine, over all rows or within each value of one column; the best k."""
    return fusion.best(scored, k, *partition)


def candidates(corpus: DataFrame, text: str, vector: Sequence[float], filters: Mapping[str, str] | None = None) -> DataFrame:
    scored = filtered(bm25(corpus, text), filters)
    return scored.withColumn("cosine", F.round(V.cosine(F.col("vector"), V.literal(vector)), 6))


def hybrid_search(corpus: DataFrame, text: str, vector: Sequence[float], filters: Mapping[str, str] | None = None, k: int = DEFAULT_K, rerank=None, depth: int = 50) -> DataFrame:
    """id, bm25, cosine, exact ranks and fused score of the top k of a corpus without an index. rerank: see reranked."""
    scored = candidates(corpus, text, vector, filters)
    if not rerank:
        return fusion.best(scored, k)
    return reranked(fusion.best(scored, max(k, depth)).join(corpus.select("id", "text"), "id"), rerank, k)


def reranked(top: DataFrame, rerank: Callable[[list[str]], Sequence[int]], k: int) -> DataFrame:
    """top (with text and fused) in the order that rerank(texts) gives as a permutation of their numbers.
    An error, or an answer that is no permutation, leaves the order as it was."""
    rows = top.orderBy(F.col("fused").desc(), "id").collect()  # as many as the depth of the rerank
    try:
        order = list(rerank([r["text"] or "" for r in rows]))
    except Exception:  # the ranking must not fail with the service
        order = []
    if sorted(order) != list(range(len(rows))):
        order = list(range(len(rows)))
    out = [(*rows[i], n) for n, i in enumerate(order[:k], 1)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in top.schema.fields)
    return top.sparkSession.createDataFrame(out, f"{kinds}, position int").drop("text")


def page(top: DataFrame, offset: int, size: int) -> DataFrame:
    """Pagination within the top k; a size of 0 means the rest."""
    out = top.orderBy(F.col("fused").desc(), "id").offset(max(0, offset))
    return out.limit(size) if size > 0 else out


def collection_search(corpus: DataFrame, text: str, vector: Sequence[float], k: int, column: str = "collection") -> DataFrame:
    """Top k of each collection, joined into one list whose score is 1 / (60 + position)."""
    return collections_merged(candidates(corpus, text, vector), k, column)


def collections_merged(scored: DataFrame, k: int, column: str) -> DataFrame:
    best = fusion.best(scored, k, column)
    spot = Window.orderBy(F.col("fused").desc(), column, "id")
    merged = best.withColumn("position", F.row_number().over(spot).cast("long")).where(F.col("position") <= k)
    return merged.select("id", column, "position", F.round(F.lit(1.0) / (RRF + F.col("position")), 9).alias("score"))


def shard_merge(lists: DataFrame, k: int) -> DataFrame:
    """lists (shard_id, id, rank, bm25): contributions summed by id, the best bm25 kept."""
    merged = lists.groupBy("id").agg(F.round(F.sum(F.lit(1.0) / (RRF + F.col("rank"))), 9).alias("fused"), F.max("bm25").alias("bm25"))
    return merged.orderBy(F.col("fused").desc(), "id").limit(k)


def rag(corpus: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citations, context): context numbers the texts by rank; a missing text is skipped, its number is kept."""
    cited = top.withColumn("rn", _rank(F.col("fused").desc(), "id"))
    cited = cited.join(corpus.select("id", "text"), "id", "left")
    entry = F.concat(F.lit("["), F.col("rn").cast("string"), F.lit("] "), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("rn", entry.alias("t")))))
    context = cited.agg(F.array_join(F.transform(ordered, lambda e: e["t"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("n_citations"))
    return cited, context
