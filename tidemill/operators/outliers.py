"""Outlier filters on one numeric column: fit bounds or scores, then filter rows.

NULL and infinite values are always kept, and a column without spread loses nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import ColumnError, col, finite, require_numeric
from tidemill.operators.quantiles import exact_quantiles

# Default thresholds and the normal-consistency factor of the median deviation
DEFAULT_LIMITS = {"zscore": 3.0, "iqr": 1.5, "modified_zscore": 3.5}
MAD_FACTOR = 0.6745


@dataclass
class OutlierBounds:
    """Fitted bounds: ``transform`` is a plain filter with literals."""

    column: str
    method: str
    threshold: float
    stats: dict[str, float | None] = field(default_factory=dict)
    drops_rows: ClassVar[bool] = True

    @property
    def active(self) -> bool:
        return self.stats.get("lower_bound") is not None

    def keep(self) -> Column:
        c, value = col(self.column), finite(col(self.column))
        if not self.active:
            return F.lit(True)
        inside = value.between(self.stats["lower_bound"], self.stats["upper_bound"])
        return F.coalesce(inside, F.lit(True))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.filter(self.keep()) if self.active else df

    def report(self, df: DataFrame) -> DataFrame:
        row = df.agg(F.count_if(~self.keep()).alias("rows_removed"),
                     F.count_if(self.keep()).alias("remaining_rows"))
        facts = [F.round(F.lit(v).cast("double"), 4).alias(k) for k, v in self.stats.items()]
        return row.select(F.lit(self.column).alias("column"), F.lit(self.method).alias("method"),
                          F.lit(float(self.threshold)).alias("threshold"),
                          "rows_removed", "remaining_rows", *facts)


def fit_outliers(df: DataFrame, column: str, method: str, threshold: float | None = None) -> OutlierBounds:
    require_numeric(df, column)
    if method not in DEFAULT_LIMITS:
        raise ColumnError(f"unknown method {method!r}")
    limit = DEFAULT_LIMITS[method] if threshold is None else threshold
    if limit <= 0:
        raise ColumnError("threshold must be greater than 0")
    value = df.select(finite(col(column)).alias("x"))
    stats: dict[str, float | None]
    if method == "zscore":
        mean, std = value.agg(F.avg("x"), F.stddev_samp("x")).first()
        stats = {"mean": mean, "std": std, "lower_bound": None, "upper_bound": None}
        if std:
            stats.update(lower_bound=mean - limit * std, upper_bound=mean + limit * std)
    elif method == "iqr":
        q1, q3 = exact_quantiles(value, ["x"], [0.25, 0.75])["x"]
        spread = None if q1 is None else q3 - q1
        stats = {"q1": q1, "q3": q3, "iqr": spread, "lower_bound": None, "upper_bound": None}
        if spread:
            stats.update(lower_bound=q1 - limit * spread, upper_bound=q3 + limit * spread)
    else:
        median = exact_quantiles(value, ["x"], [0.5])["x"][0]
        mad = None
        if median is not None:
            away = value.select(F.abs(F.col("x") - median).alias("x"))
            mad = exact_quantiles(away, ["x"], [0.5])["x"][0]
        stats = {"median": median, "mad": mad, "lower_bound": None, "upper_bound": None}
        if mad:
            reach = limit * mad / MAD_FACTOR
            stats.update(lower_bound=median - reach, upper_bound=median + reach)
    return OutlierBounds(column, method, limit, stats)


def remove_outliers(df: DataFrame, column: str, method: str, threshold: float | None = None) -> DataFrame:
    if method in DEFAULT_LIMITS:
        return fit_outliers(df, column, method, threshold).transform(df)
    from tidemill.operators.outlier_models import fit_isolation_forest, fit_local_outlier_factor

    fits = {"isolation_forest": fit_isolation_forest, "lof": fit_local_outlier_factor}
    if method not in fits:
        raise ColumnError(f"unknown method {method!r}")
    return fits[method](df, column, threshold).transform(df)
