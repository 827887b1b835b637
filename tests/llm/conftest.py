import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, id string, component long, words string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, repeated rows, ties, a very long text, special strings; extra columns with clashing names."""
    texts = [
        (1, "one two three four five six seven eight nine ten"),
        (2, "ONE two  three four five six\tseven eight nine ten"),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (5, " \n\t "),
        (None, "one two three four five six seven eight nine ten"),
        (None, None),
        (6, "short text"),
        (7, "Short text"),
        (8, "Released under the MIT License. Licensed under the Apache License, Version 2.0. cc-by-nc cc by nc"),
        (9, "<|endoftext|> naïve café <|endoftext|>\u00a0\u3000 🙂🙂 don't  stop"),
        (10, "word " * 30_000 + "x" * 30_000),
        (11, "\u00e9" * 5000),
        (12, "under the mit license under the mit license version 2"),
    ]
    return [(i, t, None, "s", None, "k", "i", 7, "w") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    """All documents of the smallest tables, in a few partitions."""
    return spark.read.parquet(f"{sf}/documents.parquet").repartition(4)


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
