"""Column helpers of the native operators: everything here is a built-in expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body may use it in a lambda for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def positions(n: Column) -> Column:
    """0 to n-1; empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * 6), " "), "")


def lower(text: Column) -> Column:
    """A-Z lowered, all else unchanged."""
    return F.translate(text, UPPER, LOWER)
