from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, score string, row string, word string"


@pytest.fixture(scope="session")
def prose():
    """Random words, the same ones each time."""
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(words, k=n))


@pytest.fixture(scope="session")
def edge_rows(prose):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and ids; and columns whose names clash."""
    texts = ["", None, " \n\t ", "one", "One", "a b c", prose(60, 1), prose(60, 1), prose(40_000, 2), "é中\U0001f600 " * 30, "\x00\x01 x", "x" * 70_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one"), (None, None), (6, prose(60, 1)), (3, "one")]
    return [(i, t, "en", "s", 0, "u", "s", "r", "w") for i, t in rows]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (8, 0, 1), (None, 1, 1), (3, None, None), (9, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
