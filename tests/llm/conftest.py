import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with what operators must stand: nulls, empty and long texts, ties, repeats, clashing extra columns."""
    rows = [
        (1, "The quick  brown\tfox jumps over the lazy dog today", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog today", "en", "a"),
        (3, "The quick brown fox jumps\nover the lazy dog today", "en", "b"),
        (4, None, None, None),
        (5, "", "en", "a"),
        (6, "   \n ", "en", "b"),
        (7, "word " * 30_000, "en", "c"),
        (8, "one", "en", "c"),
        (8, "one", "en", "c"),
        (9, "ONE", "de", None),
        (None, "no id here but some text", "fr", "a"),
        (None, None, "fr", "a"),
        (10, "Die Straße führt über Köln.\n\nZweiter Absatz\nmit Zeilen", "de", "a"),
    ]
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, uid long, digest string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
