import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("rid", T.StringType()),
        T.StructField("_rid", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def frame(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "a", "b", None, "c", "d", None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


LONG = prose(1, 60_000)
EDGES = [
    (1, "one two three four five six seven"),
    (1, "one two three four five six seven"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, LONG),
    (None, "a row without an id"),
    (None, "a row without an id"),
    (7, "é 😀 ñ\nzwei\nzwei"),
    (8, "short"),
    (9, "0" * 30_000),
    (10, "x" * 30_000),
]


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
