import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Small document tables from rows."""

    def make(rows, schema="doc_id long, text string", parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One\ttwo"), (5, "One\ttwo"), (None, "null id here"), (None, None),
        (6, long), (7, long + " more"), (8, "x" * 20_000), (9, "été " * 50), (10, "a.b@c.example.com 4111 1111 1111 1111"),
    ]
