"""Column helpers for words and lines; built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Between words: blank and the ASCII control characters tab to carriage return.
SPACE = r"[ \t-\r]"
#: Between words of letters and digits: every other ASCII character.
NOT_ALPHANUMERIC = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row.

    A column that a lambda refers to is otherwise computed for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case; letters outside ASCII stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column, between: str = SPACE) -> Column:
    """The words of a text in order."""
    return F.array_remove(F.split(text, f"{between}+"), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long")
