import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
COPY = " ".join(f"copy{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls in every column, empty, blank and very long texts, ties, repeated rows and ids."""
    return [
        (1, COPY, "en", "a"), (2, COPY, "en", "a"), (2, COPY, "en", "a"), (3, COPY + " more", "en", None), (4, None, None, "b"), (5, "", "en", "b"),
        (6, " \t\n\x0b ", "fr", "b"), (7, LONG, "en", "c"), (8, "one two", "fr", "c"), (9, "one two", "fr", "c"), (None, COPY, "en", "a"), (None, None, None, None),
        (10, "été ÀÉ ǅ \U0001f600 ## !!\nline\nline\n\nline", "fr", "é"), (11, COPY.upper(), None, "a"), (12, "x" * 100_000, "en", "c"), (3, "other text of the same id", "en", "z"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names clash with those of results."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string").repartition(3)
    return df.selectExpr("*", "cast(length(text) as long) as n_chars", "'keep' as size", "1 as n_words", "true as kept", "7 as label", "'s' as score", "5 as n_tokens", "0 as a", "0 as node", "0 as k", "0 as h")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
