"""Incremental reads of relational tables and object stores."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_IDENTIFIER = re.compile(r"[A-Za-z_]\w{0,63}", re.A)
_SALESFORCE = re.compile(r"[A-Za-z]\w{0,79}(?:__c|__r)?(?:\.[A-Za-z]\w{0,79})*", re.A)


def identifier(name: str, salesforce: bool = False) -> str:
    if not (_SALESFORCE if salesforce else _IDENTIFIER).fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def read_table(spark: SparkSession, url: str, table: str, columns: Sequence[str], cursor: str | None = None, since: str | None = None, quote: str = '"', **options: str) -> DataFrame:
    """JDBC scan of the given columns (options such as partitionColumn, lowerBound, upperBound and numPartitions
    spread it over tasks); the cursor predicate is pushed down."""
    rows = spark.read.format("jdbc").options(**jdbc_options(url, table, quote, **options)).load().select(*[identifier(c) for c in columns])
    return rows.where(F.col(identifier(cursor)) > F.lit(since)) if cursor and since else rows


def jdbc_options(url: str, table: str, quote: str = '"', **options: str) -> dict[str, str]:
    """Options of a JDBC scan; MySQL quotes names by backticks. Bounds go together."""
    quote = "`" if url.startswith("jdbc:mysql:") else quote
    bounds = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
    if bounds & set(options) and not bounds <= set(options):
        raise ValueError(f"give all of {', '.join(sorted(bounds))}")
    return {"url": url, "dbtable": f"{quote}{identifier(table)}{quote}", "fetchsize": "10000", **options}


def records(rows: DataFrame, key: str, content: Sequence[str], cursor: str, since: Column | None = None, url: str | None = None, scheme: str = "sql", table: str = "t") -> DataFrame:
    """rows -> id, content, url, emitted_at: non-empty columns joined by a blank line; {id} in the template is replaced."""
    rows = rows.where(F.col(cursor) > since) if since is not None else rows
    ident = F.col(key).cast("string")
    link = F.replace(F.lit(url), F.lit("{id}"), ident) if url else F.concat(F.lit(f"{scheme}://{table}/"), ident)
    text = F.concat_ws("\n\n", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in content])
    return rows.select(ident.alias("id"), text.alias("content"), link.alias("url"), F.col(cursor).alias("emitted_at"))


def last_cursor(rows: DataFrame, cursor: str, numeric: bool = False) -> DataFrame:
    """One row: the largest cursor, by number where asked."""
    c = F.col(cursor)
    return rows.agg((F.max(c.cast("bigint")).cast("string") if numeric else F.max(c)).alias("cursor"))


# MIME types by extension.
MIME = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "json": "application/json", "csv": "text/csv", "xml": "application/xml", "pdf": "application/pdf"}


def mime_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def read_objects(spark: SparkSession, path: str, extensions: Sequence[str] = (), since: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Objects below a prefix with their MIME type; filters on path and length are taken before contents are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if since:
        reader = reader.option("modifiedAfter", since)
    rows = reader.load(path)
    if extensions:
        rows = rows.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    if max_bytes:
        rows = rows.where(F.col("length") <= max_bytes)
    return rows.withColumn("mime_type", mime_of(F.col("path")))
