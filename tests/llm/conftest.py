import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, salt int, norm string"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, clashing column names."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "s1", 44, "r", 1, "x"),
        (2, "the QUICK brown fox jumps over the lazy dog.", "en", "s2", 44, None, 2, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "de", "s1", 0, "", 0, ""),
        (5, " \t\n ", "de", "s1", 4, "", 0, ""),
        (None, "Ein Satz ohne Nummer, der hier steht.", "de", "s2", 37, "", 0, ""),
        (None, "Ein Satz ohne Nummer, der hier steht.", "de", "s2", 37, "", 0, ""),
        (7, long, "en", "s3", len(long), "", 0, ""),
        (8, long + " end", "en", "s3", len(long) + 4, "", 0, ""),
        (9, "ÄÖÜ Straße ſ K 中文 字 😀 a\x0bb", None, "s3", 24, "", 0, ""),
        (9, "ÄÖÜ Straße ſ K 中文 字 😀 a\x0bb", None, "s3", 24, "", 0, ""),
        (10, "12345 67890 !!!", "en", "ä", 15, "", 0, ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
