import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and texts, an extra clashing column."""
    long = " ".join(f"word{i} the of" for i in range(30_000))
    plain = " ".join(f"w{i} the" for i in range(60)) + "\nand so on"
    rows = [
        (1, plain, "en", "b", 9, "x"),
        (2, plain, "en", None, 9, "x"),
        (2, plain, "en", None, 9, "x"),
        (3, None, "de", "a", None, None),
        (4, "", None, "a", 0, "y"),
        (5, " \n\t\n ", "fr", "", 5, "y"),
        (None, "one two", None, None, None, None),
        (None, None, None, None, None, None),
        (7, long, "en", "b", len(long), "z"),
        (8, "é" * 40_000, "fr", "c", 40_000, "z"),
        (9, "ABC abc", "en", "c", 7, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
