"""Vector expressions, all in double and all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _both(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def dot(a: Column, b: Column) -> Column:
    a, b = _both(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    a, b = _both(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm_squared(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is empty or zero; the shorter length counts."""
    a, b = _both(a, b)
    size = F.sqrt(norm_squared(a)) * F.sqrt(norm_squared(b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


#: name -> (expression, whether smaller is nearer)
METRICS = {"cosine": (cosine, False), "dot": (dot, False), "l2": (l2_squared, True), "cosine_distance": (cosine_distance, True)}


def scalar_quantize(v: Column, low: float, high: float) -> Column:
    """int8 codes: round half away from zero of (x - low) * 255 / (high - low), minus 128."""
    if high <= low:
        return F.transform(v, lambda x: F.lit(0).cast("tinyint"))
    scaled = lambda x: F.round((x.cast("double") - low) * 255 / (high - low)) - 128
    return F.transform(v, lambda x: F.least(F.greatest(scaled(x), F.lit(-128)), F.lit(127)).cast("tinyint"))


def scalar_dequantize(q: Column, low: float, high: float) -> Column:
    return F.transform(q, lambda c: (c.cast("double") + 128) * (high - low) / 255 + low)


def binary_quantize(v: Column, dimension: int) -> Column:
    """Sign bits packed into 64-bit words, lowest bit first."""
    words = []
    for start in range(0, dimension, 64):
        bits = [F.when(F.get(v, F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("long"), i - start)).otherwise(F.lit(0).cast("long")) for i in range(start, min(start + 64, dimension))]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
