import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _b string"


def _edge_rows():
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, "ONE two"), (7, "x" * 30_000), (8, "ünïcödé \U0001f600 text " * 3)]
    for k in range(12):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(60)] = rng.choice(words)
        rows.append((20 + k, " ".join(w)))
    rows += [(40, "a b\nc d\ne f\ng h"), (41, "q\na b\nc d\ne f\ng h\nz"), (42, "r\nr\nr\nr\nr"), (43, " ".join(rng.choice(words) for _ in range(4000)))]
    rows += [(43, rows[-1][1])]
    return [(d, t, None if d == 4 else ("en", "fr")[d % 2], None if d in (5, 40) else f"s{d % 3}", None if t is None else len(t), "clash", "clash") for d, t in rows]


@pytest.fixture(scope="session")
def edge_rows():
    return _edge_rows()


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
