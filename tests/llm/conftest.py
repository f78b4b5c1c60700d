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
        # Names that operators use for their own columns.
        T.StructField("score", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("id", T.LongType()),
    ]
)


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ka", "to", "mi", "ren", "sol", "ver")) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with the columns of the table and some that clash."""

    def build(pairs, lang="en", parts=3):
        rows = [(i, t, lang, "s", None if t is None else len(t), "x", 7, 8) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return build


#: Nulls, empty and blank texts, repeats, ties, and a text far longer than the others.
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one"), (None, None), (7, words(3, 60)), (8, words(3, 60)), (9, words(4, 30_000)), (10, "ünï ▁ \U0001f600\n")]


@pytest.fixture(scope="session")
def edges(make):
    return make(EDGES)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
