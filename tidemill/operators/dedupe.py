"""Removing duplicate rows.

Each group is reduced by an aggregate that merges before the shuffle, so a group holding a large part
of the table reaches the reducer as a few partial rows instead of all its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import ColumnError, col, free_name, require


def drop_duplicate_rows(df: DataFrame, subset: list[str] | None = None, keep: str = "first",
                        order_by: list[str] | None = None) -> DataFrame:
    """Keep the ``first`` or ``last`` row per key in ``order_by`` order, or ``none`` of a repeated key."""
    if keep not in ("first", "last", "none"):
        raise ColumnError(f"keep must be first, last or none, not {keep!r}")
    keys = list(subset or df.columns)
    require(df, *keys)
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*map(col, keys))
    count, whole, tie = (free_name(df, name) for name in ("_n", "_row", "_tie"))
    if not rest:
        counted = grouped.agg(F.count(F.lit(1)).alias(count))
        kept = counted.filter(col(count) == 1) if keep == "none" else counted
        return kept.select(*map(col, df.columns))
    row = F.struct(*map(col, rest))
    if keep == "none":
        reduced = grouped.agg(F.count(F.lit(1)).alias(count), F.any_value(row).alias(whole)) \
            .filter(col(count) == 1)
    else:
        if not order_by:
            raise ColumnError("first and last need order_by: a table has no row order of its own")
        require(df, *order_by)
        # rows that tie are ordered by a hash of their cells, so that the same one stays in every run
        order = F.struct(*map(col, order_by), F.xxhash64(*map(col, df.columns)).alias(tie))
        reduced = grouped.agg((F.min_by if keep == "first" else F.max_by)(row, order).alias(whole))
    return reduced.select(*[col(c) if c in keys else col(whole).getField(c).alias(c)
                            for c in df.columns])


def duplicate_count(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each key."""
    keys = list(subset or df.columns)
    count = free_name(df, "_n")
    groups = df.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias(count))
    return groups.agg(F.coalesce(F.sum(col(count) - 1), F.lit(0).cast("bigint")).alias("duplicates"))
