"""Type classes, column checks and the missing-value rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


class ColumnError(ValueError):
    """A column argument does not fit the operator."""


def q(name: str) -> str:
    """Quote a column name so dots and spaces in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ColumnError(f"columns not found: {missing}")


def require_numeric(df: DataFrame, *names: str) -> None:
    require(df, *names)
    wrong = [n for n in names if not is_numeric(df, n)]
    if wrong:
        raise ColumnError(f"columns are not numeric: {wrong}")


def require_categorical(df: DataFrame, *names: str) -> None:
    require(df, *names)
    wrong = [n for n in names if is_numeric(df, n)]
    if wrong:
        raise ColumnError(f"columns are numeric, expected text or boolean: {wrong}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL both mean missing; keep one of them. Infinite values stay."""
    floats = set(float_columns(df))
    if not floats:
        return df
    return df.select([
        F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns
    ])


def finite(c: Column) -> Column:
    """The value, or NULL where it is infinite or NaN."""
    c = c.cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def free_name(df: DataFrame, stem: str) -> str:
    name = stem
    while name in df.columns:
        name = "_" + name
    return name
