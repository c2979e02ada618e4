import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, keep_id string, DIGEST_ string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, near copies and columns whose names clash with those of results."""
    rng = random.Random(5)
    words = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 80))) for _ in range(30)]
    texts = [None, "", " \n\t ", "x", "a b", base[0], base[0], base[0].replace(" ", "  "), base[1].upper(), "y" * 50_000,
             " ".join(rng.choice(words) for _ in range(30_000)), *base[2:]]
    texts += [f"{b} tail{i}\nshared line of some length {i % 2}" for i, b in enumerate(base[:10])]
    rows = [(i, t, None if i % 3 else "en", "z", "q") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0], (None, base[0], "en", None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows_of():
    def get(df, *columns):
        return sorted((tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()), key=repr)

    return get
