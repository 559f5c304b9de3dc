"""Counts per (column, value) for many columns in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import col, float_columns


def one_zero(c: Column, is_float: bool) -> Column:
    """-0.0 as 0.0: they are equal as numbers and differ as text."""
    return F.when(c == 0, F.abs(c)).otherwise(c) if is_float else c


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for all non-null values; equal values are merged before the shuffle."""
    floats = set(float_columns(df))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), one_zero(col(c), c in floats).cast("string").alias("value"))
                      for c in columns])
    return (df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
            .filter(F.col("value").isNotNull()).groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def count_name(column: str) -> str:
    """The name of the count beside ``column``: n, or _n where the column itself is called so."""
    return "_n" if column.lower() == "n" else "n"


def column_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, ``count_name(column)``) with the column's own type, NULLs left out."""
    return (df.filter(col(column).isNotNull()).groupBy(col(column).alias(column))
            .agg(F.count(F.lit(1)).alias(count_name(column))))
