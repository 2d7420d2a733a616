from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept string, n_words string, row string, content string, size string, doc string"
)
LONG_WORDS = 60_000


def long_text(seed: int, words: int = LONG_WORDS) -> str:
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(5_000)}" for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, source): nulls, empty and very long texts, ties, repeated rows."""
    usual = "The Quick brown fox jumps over the lazy dog near the old stone bridge at noon today"
    return [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \n\t\x0b ", None),
        (4, "one two three", "a"),
        (5, "one two three", None),
        (6, usual, "b"),
        (6, usual, "b"),
        (7, usual.upper(), "b"),
        (8, usual + "\nÉtude für Straße non breaking", "b"),
        (None, usual + " and more", "b"),
        (None, None, None),
        (10, long_text(1), "c"),
        (11, long_text(1) + " tail", "c"),
        (12, "same line\n" * 50 + "x", "a"),
    ]


@pytest.fixture(scope="session")
def edge_documents(spark, edge_rows):
    """The rows with extra columns whose names operators use inside."""
    rows = [(i, t, "en", s, None, "k", "n", "r", "c", "s", "d") for i, t, s in edge_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
