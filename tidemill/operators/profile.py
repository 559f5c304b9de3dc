"""Column profiles: numeric and categorical summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.functions.columns import categorical_columns, col, numeric_columns, require
from tidemill.functions.moments import sample_kurtosis, sample_skewness
from tidemill.operators.quantiles import exact_quantiles
from tidemill.operators.valuecounts import value_counts


def stack_columns(df: DataFrame, columns: list[str], stats) -> DataFrame:
    """One aggregate over all columns, turned into one row per column.

    ``stats(column)`` returns the named aggregates of that column.
    """
    cells = []
    for c in columns:
        cells.append(F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in stats(c).items()]))
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")) \
        .select("cell.*")


def column_stats(df: DataFrame, columns: list[str], stats) -> DataFrame:
    """Like ``stack_columns`` for numeric columns and many statistics: the columns are stacked first,
    so the compiled aggregate is that of one column. Partial results leave each task, not rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(cells).alias("cell")).select("cell.*")
    return long.groupBy("column").agg(*[v.alias(k) for k, v in stats(F.col("x")).items()])


def attach(frame: DataFrame, key: str, values: dict[str, list], names: list[str]) -> DataFrame:
    """Add per-column driver values (one row per column name) to a report frame."""
    if not values:
        return frame.withColumns({n: F.lit(None).cast("double") for n in names})
    table = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(x).cast("double").alias(n)
                                                      for n, x in zip(names, v)])
                      for k, v in values.items()])
    found = F.filter(table, lambda s: s["k"] == F.col(key))[0]
    return frame.withColumn("_found", found).select(
        "*", *[F.col("_found")[n].alias(n) for n in names]).drop("_found")


def describe_numeric(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    columns = columns or numeric_columns(df)
    require(df, *columns)

    def stats(x: Column) -> dict[str, Column]:
        return {
            "mean": F.round(F.coalesce(F.avg(x), F.lit(0.0)), digits),
            "std": F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), digits),
            "min": F.min(x), "max": F.max(x),
            "skewness": F.round(F.coalesce(sample_skewness(x), F.lit(0.0)), digits),
            "kurtosis": F.round(F.coalesce(sample_kurtosis(x), F.lit(0.0)), digits),
            "num_zeros": F.count_if(x == 0), "num_negatives": F.count_if(x < 0),
        }

    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    frame = attach(column_stats(df, columns, stats), "column", quartiles, ["q25", "q50", "q75"])
    return frame.select("column", "mean", "std", "min", "max", "q25", "q50", "q75",
                        "skewness", "kurtosis", "num_zeros", "num_negatives")


def describe_categorical(df: DataFrame, columns: list[str] | None = None, top: int = 5,
                         rare_share: float = 0.05) -> DataFrame:
    """One row per column and top value, with the column's totals repeated on each."""
    columns = columns or categorical_columns(df)
    require(df, *columns)
    counts = value_counts(df, columns)
    rows = stack_columns(df, columns, lambda c: {
        "total_rows": F.count(F.lit(1)),
        "missing_count": F.count_if(col(c).isNull()),
        "avg_length": F.round(F.coalesce(F.avg(F.char_length(col(c).cast("string"))), F.lit(0.0)), 2)})
    totals = F.broadcast(rows)  # one row per column
    rare = F.col("n") < F.lit(rare_share) * (F.col("total_rows") - F.col("missing_count"))
    per_column = counts.join(totals, "column").groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"), F.count_if(rare).alias("rare_count"))
    best = top_values(counts, top)
    return (best.join(totals, "column").join(F.broadcast(per_column), "column")
            .select("column", "unique_count", "missing_count", "rare_count", "avg_length", "rank",
                    "value", F.col("n").alias("count"),
                    F.round(F.col("n") * 100.0 / F.col("total_rows"), 2).alias("percentage")))


def top_values(counts: DataFrame, top: int) -> DataFrame:
    """The ``top`` most frequent values per column; each task keeps its own best before the shuffle."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
