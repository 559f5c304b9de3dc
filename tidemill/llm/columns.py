"""Column expressions and row keys that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Text of ASCII alone takes the faster built-in way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole(df: DataFrame, name: str) -> Column:
    """The text column, with null as the empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def same_row(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Equality of all keys, null equal to null."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))
