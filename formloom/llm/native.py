"""Column helpers shared by the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A plain column that a lambda refers to is inlined by the optimizer and then
    evaluated again for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def space_words(text: Column) -> Column:
    """Maximal runs of characters other than space and tab to carriage return."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` alone would also fold other letters."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)
