"""Facets, suggestions and spelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def facets(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, value, n of the non-empty values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(F.explode(pairs).alias("p")).select("p.field", "p.value").where("value <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def suggest_dictionary(docs: DataFrame) -> DataFrame:
    """docs (tenant, title, text) -> tenant, term, weight. Title words weigh 10, title bigrams 5, words of the text 1; lengths in bytes."""
    title, body = T.tokens(F.col("title")), T.tokens(F.col("text"))
    long = lambda words, n: F.filter(words, lambda w: F.octet_length(w) >= n)
    pairs = F.when(F.size(title) > 1, F.zip_with(F.slice(title, F.lit(1), F.size(title) - 1), F.slice(title, F.lit(2), F.size(title) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    weighed = lambda words, w: F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(w).cast("long").alias("w")))
    terms = F.concat(weighed(long(title, 2), 10), weighed(long(body, 3), 1), weighed(pairs, 5))
    return docs.select("tenant", F.explode(terms).alias("t")).groupBy("tenant", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("weight"))


def map_facets(rows: DataFrame, fields: Sequence[str], column: str = "metadata") -> DataFrame:
    """field, value, n of the non-empty values of these keys of a map."""
    pairs = rows.select(F.explode(F.map_filter(column, lambda k, v: k.isin(list(fields)) & (v != ""))).alias("field", "value"))
    return pairs.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def suggest(dictionary: DataFrame, prefix: str, tenant: str | None = None, n: int = 10) -> DataFrame:
    """A tenant sees its own terms only; without one all tenants are summed. At most 50, ten where none are asked for."""
    n = min(n, 50) if n > 0 else 10
    rows = dictionary.where(F.col("tenant") == tenant) if tenant else dictionary
    found = rows.where(F.col("term").startswith(prefix.lower())).groupBy("term").agg(F.sum("weight").alias("weight"))
    return found.orderBy(F.col("weight").desc(), "term").limit(n)


def spell_dictionary(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(T.tokens(F.col("text"))).alias("term")).where(F.octet_length("term") >= 2).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def spell_candidates(words: DataFrame, dictionary: DataFrame, within: int = 2) -> DataFrame:
    """words (pos, word) -> pos, word, correction. Known words stay; else the nearest term, then the most frequent.
    Dictionary and words meet on byte length, so only terms of a similar length are compared."""
    sized = dictionary.withColumn("bytes", F.octet_length("term"))
    asked = words.withColumn("bytes", F.explode(F.sequence(F.octet_length("word") - within, F.octet_length("word") + within)))
    near = asked.join(sized, "bytes").withColumn("distance", T.byte_levenshtein(F.col("word"), F.col("term"))).where(F.col("distance") <= within)
    best = Window.partitionBy("pos", "word").orderBy("distance", F.col("freq").desc(), "term")
    picked = near.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("pos", "word", F.col("term").alias("correction"))
    return words.join(picked, ["pos", "word"], "left").select("pos", "word", F.coalesce("correction", F.lit("")).alias("correction"))


def spell_suggest(corrected: DataFrame) -> DataFrame:
    """One row: the corrected words joined by a space."""
    return corrected.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "correction"))), lambda s: s["correction"]), " ").alias("suggestion"))
