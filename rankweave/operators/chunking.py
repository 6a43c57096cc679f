"""Chunks: by meaning, by size, by syntax; ids, metadata and hooks."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions import vectors as V

TEXTS = ArrayType(StringType())

#: Abbreviations after which a full stop does not end a sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs etc e.g i.e u.s u.k inc ltd co corp no fig al approx dept est gen rep sen rev jan feb mar apr jun jul aug sep sept oct nov dec".split())
_END = re.compile(r"[.!?]+[\"')\]]*\s+")


def split_sentences(text: str) -> list[str]:
    out, start = [], 0
    for m in _END.finditer(text):
        before = text[start : m.start()].rsplit(None, 1)
        last = before[-1].lower().lstrip("(\"'") if before else ""
        following = text[m.end() : m.end() + 1]
        if m[0].lstrip()[0] == "." and (last in ABBREVIATIONS or re.fullmatch(r"([a-z]\.)*[a-z]", last) or following.islower()):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    rest = text[start:].strip()
    return [s for s in [*out, rest] if s]


@F.pandas_udf(TEXTS)
def sentences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: split_sentences(t or ""))


def semantic_chunks(rows: DataFrame, threshold: float = 0.75) -> DataFrame:
    """rows (doc, pos, sentence, vector) -> doc, chunk, text, n. A cosine to the sentence before under the threshold
    begins a new chunk; sentences of a chunk are joined by a space."""
    order = Window.partitionBy("doc").orderBy("pos")
    step = rows.withColumn("before", F.lag("vector").over(order))
    near = F.round(V.cosine(F.col("vector"), F.col("before")), 6)
    cut = F.when(F.col("before").isNotNull() & (near < threshold), 1).otherwise(0)
    step = step.withColumn("cut", cut)
    step = step.withColumn("chunk", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("pos", "sentence")))
    return step.groupBy("doc", "chunk").agg(F.array_join(F.transform(parts, lambda p: p["sentence"]), " ").alias("text"), F.count(F.lit(1)).alias("n"))


def fixed_pieces(text: Column, max_tokens: int) -> Column:
    """Runs of max_tokens blank-separated words; none of a text without words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def cut(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(max_tokens))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(max_tokens)), " "))

    return F.element_at(F.transform(F.array(words), cut), 1)  # the words are split once


def fixed_chunks(docs: DataFrame, max_tokens: int) -> DataFrame:
    """docs (doc, text) -> doc, chunk, text."""
    return docs.select("doc", F.posexplode(fixed_pieces(F.col("text"), max_tokens)).alias("chunk", "text"))


def syntax_chunks(source: str, language: str = "python") -> list[str]:
    """Outermost functions, methods' classes and classes; nothing inside them."""
    if language == "python":
        try:
            tree = ast.parse(source)
        except SyntaxError:
            return []
        return [s for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and (s := ast.get_source_segment(source, n))]
    out = []
    for m in re.finditer(r"(?m)^(?:func\b|type\s+\w+\s+(?:struct|interface)\b|(?:public |private |static )*(?:class|function)\b)[^{\n]*\{", source):
        if out and m.start() < out[-1][1]:
            continue
        depth = 0
        for i in range(m.end() - 1, len(source)):
            depth += {"{": 1, "}": -1}.get(source[i], 0)
            if depth == 0:
                out.append((m.start(), i + 1))
                break
    return [source[a:b] for a, b in out]


@F.pandas_udf(TEXTS)
def python_chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: syntax_chunks(t or ""))


def with_chunk_columns(chunks: DataFrame) -> DataFrame:
    """chunks (url, chunk_idx, metadata): id from url and index; url and chunk_idx go into the metadata and win."""
    own = F.create_map(F.lit("url"), F.col("url"), F.lit("chunk_idx"), F.col("chunk_idx").cast("string"))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("url", "chunk_idx"))
    return chunks.withColumn("id", T.chunk_id(F.col("url"), F.col("chunk_idx"))).withColumn("metadata", F.map_concat(kept, own))


def apply_hooks(text: Column, hooks: Sequence[Callable[[Column], Column]]) -> Column:
    """Each hook maps the text; where one gives null the text before it stays."""
    for hook in hooks:
        text = F.coalesce(hook(text), text)
    return text
