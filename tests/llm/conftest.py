"""Small tables that every operator must take: nulls, empty and long texts, ties, repeats, extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(11)
    word = lambda: rng.choice("the of and in ab cd".split()) + rng.choice(["", "", "x", "y"])
    long_text = " ".join(word() for _ in range(30_000))
    return [
        (None, None),
        (None, "the of and in the of and in"),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "a"),
        (5, "The of AND in ab cd ef"),
        (6, "the of and in ab cd ef"),
        (6, "the of and in ab cd ef"),
        (7, "é\U0001f600 ▁ </s> <|endoftext|> \x00\x01"),
        (8, "w" * 50_000),
        (9, long_text),
        (10, long_text + " end"),
        (11, "same line here\n" * 40),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def crowded(spark, odd_rows):
    """The odd rows with columns whose names the operators use inside."""
    names = "key score node label row_key_ row_spans_ bucket length hash n_words spans base kept predicted term".split()
    rows = [(*r, *range(len(names))) for r in odd_rows]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {n} long" for n in names))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
