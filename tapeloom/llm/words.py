"""Words of a text as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+"), "")


def chars(text: Column) -> Column:
    """Code points of a text; 0 for null."""
    return F.coalesce(F.char_length(text), F.lit(0)).cast("long")


def count_of(text: Column, char_class: str) -> Column:
    """How many characters of a text lie in the class; 0 for null."""
    return chars(F.regexp_replace(text, f"[^{char_class}]+", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where a lambda inside looks at it again."""
    return F.get(F.transform(F.array(value), body), 0)


def sampled(rows: DataFrame, wanted: int, seed: int) -> DataFrame:
    """About ``wanted`` rows, at most twice as many, by a hash over all their columns.

    A share of the hash range is kept, so no task sends more than its share.
    """
    total = rows.count()
    if total <= wanted:
        return rows
    top = -(1 << 63) + (1 << 64) * wanted // total
    return rows.where(F.xxhash64(*rows.columns, F.lit(seed)) < top).limit(2 * wanted)
