"""A search index that is built once and read by every query.

Tables below one folder, each laid out so that a query reads only what it needs:

* cards      id, metadata, length: one slim row a document, with its vector, norm, sign code and list;
             partitioned by list bucket and sorted by centroid, so a probe reads few row groups
* postings   (term, id, tf, length), partitioned by a hash bucket of the term and sorted by term
* dictionary (term, df, freq, bytes), sorted by term
* texts      (id, text), sorted by id
* suggest    (tenant, term, weight), sorted by term, where titles are given
* manifest   one JSON row, written last: an index without it does not exist

Search scores the postings of the query's terms only. Ranks for fusion are counted, not sorted
(see fusion). Every table is plain Parquet.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import vectors as V
from ..sources.shared import exists
from . import ann, fusion, lexicon
from .search import DEFAULT_K, K1, B, filtered, query_terms

TERM_BUCKETS = 32
LIST_BUCKETS = 8
LEAST_PROBES, MOST_PROBES = 5, 100


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def probe_count(centroids: int) -> int:
    """A tenth of the lists, 5 at least and 100 at most."""
    return min(max(centroids // 10, LEAST_PROBES), MOST_PROBES)


class SearchIndex:
    """Reads and writes an index. Metadata are the columns of the corpus other than id, text and vector."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        row = spark.read.json(f"{root}/manifest").first()
        self.manifest = json.loads(row["manifest"])

    @classmethod
    def exists(cls, spark: SparkSession, root: str) -> bool:
        return exists(spark, f"{root}/manifest/_SUCCESS")

    @classmethod
    def build(cls, corpus: DataFrame, root: str, rate: int = 50, titles: DataFrame | None = None) -> SearchIndex:
        """corpus: id, text, vector (may be null), metadata. titles: tenant, title, text for suggestions."""
        spark, schemas = corpus.sparkSession, {}

        def write(rows: DataFrame, name: str, *partitions: str) -> DataFrame:
            rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{root}/{name}")
            schemas[name] = json.loads(rows.schema.json())
            return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

        texts = write(corpus.select("id", "text").repartitionByRange("id").sortWithinPartitions("id"), "texts")
        words = texts.select("id", T.tokens(F.col("text")).alias("tokens"))
        told = words.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
        posted = told.groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", _bucket(F.col("term"), TERM_BUCKETS))
        postings = write(posted.repartition("bucket").sortWithinPartitions("bucket", "term"), "postings", "bucket")
        terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("freq")).withColumn("bytes", F.octet_length("term"))
        write(terms.repartitionByRange("term").sortWithinPartitions("term"), "dictionary")
        vectors = corpus.where("vector IS NOT NULL").select("id", "vector")
        cards = corpus.drop("text").join(words.select("id", F.size("tokens").alias("length")), "id")
        first = vectors.select(F.size("vector").alias("n")).first()
        if first:
            code = F.when(F.col("vector").isNotNull(), V.binary_quantize(F.col("vector"), first["n"]))
            cards = cards.join(ann.route(vectors, rate), "id", "left").withColumn("code", code)
        else:
            cards = cards.withColumns({"centroid_id": F.lit(None).cast(corpus.schema["id"].dataType), "is_centroid": F.lit(False), "code": F.lit(None).cast("array<bigint>")})
        cards = cards.withColumn("list_bucket", _bucket(F.col("centroid_id"), LIST_BUCKETS))
        stored = write(cards.repartition("list_bucket").sortWithinPartitions("list_bucket", "centroid_id", "id"), "cards", "list_bucket")
        row = stored.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("length"), F.count_if("is_centroid").alias("lists"), F.max(F.size("vector")).alias("dimension")).first()
        if titles is not None:
            write(lexicon.suggest_dictionary(titles).repartitionByRange("term").sortWithinPartitions("term"), "suggest")
        manifest = {"n": row["n"], "length": row["length"], "lists": row["lists"], "dimension": row["dimension"], "rate": rate, "schemas": schemas}
        spark.range(1).select(F.lit(json.dumps(manifest)).alias("manifest")).write.mode("overwrite").json(f"{root}/manifest")
        return cls(spark, root)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(self.manifest["schemas"][name])).parquet(f"{self.root}/{name}")

    def warm_up(self) -> int:
        """Read what every search reads, and keep it: the slim cards and the dictionary."""
        return sum(t.persist().count() for t in (self.table("cards").drop("vector", "code"), self.table("dictionary")))

    # Scores

    def _postings(self, terms: Sequence[str]) -> DataFrame:
        buckets = self.spark.range(1).select(*[_bucket(F.lit(t), TERM_BUCKETS) for t in terms]).first()
        return self.table("postings").where(F.col("bucket").isin(sorted(set(buckets))) & F.col("term").isin(list(terms)))

    def _saturated(self, df: Column) -> Column:
        n, mean = self.manifest["n"], float(self.manifest["length"] or 1)
        idf = F.ln(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
        tf = F.col("tf").cast("double")
        return idf * tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(mean)))

    def bm25(self, text: str) -> DataFrame:
        """(id, bm25) of the documents that hold a term of the text, rounded to 6 places."""
        terms = query_terms(text)
        if not terms:
            return self.table("cards").where(F.lit(False)).select("id", F.lit(0.0).alias("bm25"))
        known = {r["term"]: r["df"] for r in self.table("dictionary").where(F.col("term").isin(terms)).select("term", "df").collect()}
        if not known:
            return self.table("cards").where(F.lit(False)).select("id", F.lit(0.0).alias("bm25"))
        df = F.coalesce(*[F.when(F.col("term") == t, F.lit(float(n))) for t, n in known.items()])
        scores = self._postings(list(known)).select("id", self._saturated(df).alias("s"))
        return scores.groupBy("id").agg(F.round(F.sum("s"), 6).alias("bm25"))

    def candidates(self, text: str, vector: Sequence[float] | None, filters: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """(id, keep, bm25, cosine) of every document that the filters allow."""
        cosine = V.cosine(F.col("vector"), V.literal(vector)) if vector else F.lit(0.0)
        cards = filtered(self.table("cards"), filters).select("id", *keep, F.round(cosine, 6).alias("cosine"))
        return cards.join(self.bm25(text), "id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))

    # Searches

    def text_search(self, text: str, filters: Mapping[str, str] | None = None, k: int = DEFAULT_K, offset: int = 0, keep: Sequence[str] = ()) -> DataFrame:
        """Match with OR semantics. With filters the text only scores; alone it must match; without either all match."""
        if query_terms(text) and not filters:
            top = self.bm25(text).where("bm25 > 0").orderBy(F.col("bm25").desc(), "id").offset(offset).limit(k)
            return top.join(self.table("cards").select("id", *keep), "id") if keep else top
        return self.candidates(text, None, filters, keep).drop("cosine").orderBy(F.col("bm25").desc(), "id").offset(offset).limit(k)

    def hybrid(self, text: str, vector: Sequence[float], filters: Mapping[str, str] | None = None, k: int = DEFAULT_K, rerank=None, depth: int = 50) -> DataFrame:
        """id, bm25, cosine, lex_rank, sem_rank, fused of the best k. rerank: see search.reranked."""
        from .search import reranked

        scored = self.candidates(text, vector, filters)
        if not rerank:
            return fusion.best(scored, k)
        return reranked(self.with_text(fusion.best(scored, max(k, depth))), rerank, k)

    def with_text(self, top: DataFrame) -> DataFrame:
        """A few rows with their texts; the ids reach the scan."""
        ids = [r["id"] for r in top.select("id").collect()]
        return top.join(self.table("texts").where(F.col("id").isin(ids)), "id", "left") if ids else top.withColumn("text", F.lit(None).cast("string"))

    def ivf(self, vector: Sequence[float], k: int = DEFAULT_K, n_probe: int | None = None) -> DataFrame:
        """(id, centroid_id, score): exact scores over the lists of the nearest centroids."""
        n_probe = n_probe or probe_count(self.manifest["lists"])
        near = F.round(V.cosine_distance(F.col("vector"), V.literal(vector)), 6)
        probes = self.table("cards").where("is_centroid").select("centroid_id", "list_bucket", near.alias("d")).orderBy("d", "centroid_id").limit(n_probe).collect()
        ids, buckets = [r["centroid_id"] for r in probes], sorted({r["list_bucket"] for r in probes})
        lists = self.table("cards").where(F.col("list_bucket").isin(buckets) & F.col("centroid_id").isin(ids))
        scored = lists.select("id", "centroid_id", F.round(V.cosine(F.col("vector"), V.literal(vector)), 6).alias("score"))
        return scored.orderBy(F.col("score").desc(), "id").limit(k)

    def bbq(self, vector: Sequence[float], k: int = DEFAULT_K, oversample: int = 3, ef: int = 50) -> DataFrame:
        """(id, hamming, score): nearest stored sign codes, then the vectors of those alone."""
        hamming = V.hamming(F.col("code"), V.binary_quantize(V.literal(vector), len(vector)))
        coarse = self.table("cards").where("code IS NOT NULL").select("id", "list_bucket", hamming.alias("hamming")).orderBy("hamming", "id").limit(max(ef, oversample * k)).collect()
        if not coarse:
            return self.table("cards").where(F.lit(False)).select("id", F.lit(0).alias("hamming"), F.lit(0.0).alias("score"))
        distance = F.create_map(*[F.lit(x) for r in coarse for x in (r["id"], r["hamming"])])
        rows = self.table("cards").where(F.col("list_bucket").isin(sorted({r["list_bucket"] for r in coarse})) & F.col("id").isin([r["id"] for r in coarse]))
        exact = rows.select("id", distance[F.col("id")].alias("hamming"), F.round(V.cosine(F.col("vector"), V.literal(vector)), 6).alias("score"))
        return exact.orderBy(F.col("score").desc(), "id").limit(k)

    def bbq_share(self, vector: Sequence[float], k: int = DEFAULT_K, share: float = 0.3) -> DataFrame:
        """(id, hamming, score): exact cosine over all rows up to the sign distance within which `share` of the
        rows lie. The distance comes from a count of each distance, so no rows are gathered and the depth grows
        with the table; a share of 0.3 finds nine of the ten nearest on vectors without structure."""
        hamming = V.hamming(F.col("code"), V.binary_quantize(V.literal(vector), len(vector)))
        coded = self.table("cards").where("code IS NOT NULL")
        counts = coded.groupBy(hamming.alias("hamming")).agg(F.count(F.lit(1)).alias("n")).orderBy("hamming").collect()  # a row for each distance
        left, cut = math.ceil(share * sum(r["n"] for r in counts)), 0
        for r in counts:
            if left <= 0:
                break
            left, cut = left - r["n"], r["hamming"]
        near = coded.select("id", "vector", hamming.alias("hamming")).where(F.col("hamming") <= cut)
        exact = near.select("id", "hamming", F.round(V.cosine(F.col("vector"), V.literal(vector)), 6).alias("score"))
        return exact.orderBy(F.col("score").desc(), "id").limit(k)

    def suggest(self, prefix: str, tenant: str | None = None, n: int = 10) -> DataFrame:
        """The prefix reaches the scan, whose row groups are sorted by term."""
        return lexicon.suggest(self.table("suggest"), prefix, tenant, n)

    def spelling(self) -> DataFrame:
        return self.table("dictionary").where("bytes >= 2").select("term", "freq")

    # Batches of queries

    def text_batch(self, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
        """queries (query_id, text) -> (query_id, id, bm25, rank): the best k of each query in one plan."""
        asked = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
        asked = asked.join(self.table("dictionary").select("term", "df"), "term").withColumn("bucket", _bucket(F.col("term"), TERM_BUCKETS))
        scores = asked.join(self.table("postings"), ["bucket", "term"]).select("query_id", "id", self._saturated(F.col("df").cast("double")).alias("s"))
        scored = scores.groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("bm25"))
        return _first(scored, "bm25", k)

    def vector_batch(self, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
        """queries (query_id, vector), bounded -> (query_id, id, score, rank): exact cosine, the best k of each query."""
        return ann.batch_knn(self.table("cards").where("vector IS NOT NULL").select("id", "vector"), queries, k)


def _first(scored: DataFrame, score: str, k: int) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(score).desc(), "id")).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
