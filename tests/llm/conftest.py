import pytest

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names clash with results."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "x", 1, 0.5, "x"),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "x", 1, 0.5, "x"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", None, None, None, None),
        (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", None, None, None, None, None),
        (3, None, "de", "x", 0, 0.1, "x"),
        (4, "", None, "x", 0, 0.1, "x"),
        (5, " \n\t ... !!", "fr", "x", 0, 0.1, "x"),
        (6, "word " * 30_000, "en", "x", 0, 0.1, "x"),
        (7, "é" * 5_000, "fr", "x", 0, 0.1, "x"),
        (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, full string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
