from __future__ import annotations

import random

import pytest

from pyspark.sql import types as T

#: Columns of ``documents`` and some that clash with names used inside the operators.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()),
    T.StructField("part", T.StringType()), T.StructField("n", T.LongType()), T.StructField("score", T.StringType()),
])


def prose(seed: int, n: int, stem: str = "w") -> str:
    rng = random.Random(seed)
    return " ".join(f"{stem}{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", 1, "z") for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties, and texts without letters."""
    long = prose(1, 60_000)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four five six seven"), (5, "one two three four five six seven"),
        (6, long), (7, long), (None, "one two three four five six seven"), (None, None), (8, "One Two three four five six seven"),
        (9, "12 34 56 !! ??"), (10, "ñandú überß été \U0001f600 " * 30), (11, "x" * 200_000), (12, "| % $ # " * 100),
    ]
