import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, b string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "Éta", "theta\n", "iota", "kappa"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), "en", rng.choice(["s1", "s2", "s3", None]), 5, 9, "x", "y") for i in range(150)]
    rows += [(1000 + i, "The same text, many times over and over again", "en", "s1", 1, 1, None, None) for i in range(120)]
    rows += [(2000, "THE SAME text, many times over and over again", None, None, None, None, None, None)] * 3
    rows += [(None, "no id", "en", "s2", 1, 1, "d", "b"), (None, None, None, None, None, None, None, None), (3000, None, "en", "s1", 0, 0, "", ""), (3001, "", "en", "s1", 0, 0, "", "")]
    rows += [(3002, "long " * 30_000, "en", "s2", 0, 0, "", ""), (3003, "☃ \U0001f600 x", "en", "s2", 0, 0, "", "")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
