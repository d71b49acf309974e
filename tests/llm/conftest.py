import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns that clash with results."""
    long_text = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 1, 5, "x"),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 1, 5, "x"),
        (2, None, None, None, None, None, None),
        (None, "some words here", "de", "b", 3, 1, None),
        (None, None, None, None, None, None, None),
        (3, "", "fr", "b", 0, 0, ""),
        (4, " \t\n\r\x0b\x0c ", "es", "", 7, 0, ""),
        (5, long_text, "en", "a", 9, 0, ""),
        (6, long_text + " tail", "en", "a", 9, 0, ""),
        (7, "ünïcode — wörds no break 漢字 \U0001f600", "xx", "c", 9, 0, ""),
        (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 1, 5, "x"),
        (20, "one", "en", "c", 1, 1, ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
