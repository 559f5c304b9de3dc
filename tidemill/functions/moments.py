"""Bias-adjusted shape statistics and division that never raises."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, NULL where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sample_skewness(c: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; 0 for a constant column, NULL below three values."""
    x = c.cast("double")
    n = F.count(x).cast("double")
    g1 = F.when(F.max(x) == F.min(x), F.lit(0.0)).otherwise(F.skewness(x))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.when(n >= 3, n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Adjusted excess kurtosis; 0 for a constant column, NULL below four values."""
    x = c.cast("double")
    n = F.count(x).cast("double")
    safe = F.when(n >= 4, n)
    adjusted = (safe - 1) / ((safe - 2) * (safe - 3)) * ((safe + 1) * F.kurtosis(x) + 6)
    return F.when(n < 4, F.lit(None).cast("double")).when(
        F.max(x) == F.min(x), F.lit(0.0)).otherwise(adjusted)
