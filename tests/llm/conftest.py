import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again in the old town", "en", "s1", 0.5, "x"),
        (1, "The quick brown fox jumps over the lazy dog again and again in the old town", "en", "s1", 0.5, "x"),
        (2, None, "en", "s1", None, None), (3, "", None, None, 1.0, "y"), (4, " \n\t ", "de", "s1", 1.0, "y"),
        (5, LONG, "en", "s2", 1.0, None), (6, "x" * 30_000, "fr", "s2", 1.0, None), (None, "text without id", "en", "s1", 1.0, "z"),
        (7, "Die Straße über den Fluß führt nach Süden \U0001F600 und weiter", "de", None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, rejected string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
