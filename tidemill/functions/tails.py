"""Upper tail of the F distribution for report frames (one value per column pair)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def f_upper_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f), by the continued fraction of the regularised incomplete beta function."""
    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        from math import exp, lgamma, log

        def fraction(a, b, x):
            tiny, c = 1e-300, 1.0
            d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
            h = d
            for m in range(1, 500):
                even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
                odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                for step in (even, odd):
                    d = 1.0 + step * d
                    d = 1.0 / (d if abs(d) > tiny else tiny)
                    c = 1.0 + step / c
                    c = c if abs(c) > tiny else tiny
                    h *= c * d
                if abs(c * d - 1.0) < 1e-15:
                    break
            return h

        def one(fv, a, b):
            if pd.isna(fv) or pd.isna(a) or pd.isna(b) or a <= 0 or b <= 0:
                return None
            if fv <= 0:
                return 1.0
            if fv == float("inf"):
                return 0.0
            x, p, r = b / (b + a * fv), b / 2.0, a / 2.0
            front = lgamma(p + r) - lgamma(p) - lgamma(r) + p * log(x) + r * log(1.0 - x)
            if x < (p + 1.0) / (p + r + 2.0):
                return exp(front) * fraction(p, r, x) / p
            return 1.0 - exp(front) * fraction(r, p, 1.0 - x) / r

        return pd.Series([one(*row) for row in zip(f, d1, d2)], dtype="float64")

    return tail(f.cast("double"), df1.cast("double"), df2.cast("double"))
