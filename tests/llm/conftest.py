import random

import pytest
from pyspark.sql import types as T

ODD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("score", "kept", "ids", "component_id", "accepted", "_e", "_t", "_w", "n_ids")],
    ]
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "un", "és"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words) + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, tiny, very long and repeated texts, null ids, and columns with clashing names."""
    long = prose(1, 20_000)
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, long), (6, long), (7, prose(2, 60)), (7, prose(2, 60)), (None, prose(3, 60)), (None, None), (8, "no letters? 12 — 34"), (9, "x" * 3000), (10, prose(2, 60) + " more")]
    return [(i, t, "en", "s", *["clash"] * 9) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)
