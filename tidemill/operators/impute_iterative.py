"""Round-robin regression imputation from one pass over the data.

Rows with the same set of missing cells share one linear map from their known cells to their filled
row. The map, and the sums of products of the filled rows, follow from the sums of products of the
known cells alone. So one aggregate per pattern of missing cells replaces a pass per column and
round; the regressions run on matrices of columns x columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import ColumnError, col, require_numeric

MAX_PATTERNS = 4096


@dataclass
class RegressionFill:
    """Per pattern of missing cells: the affine map that fills each missing column."""

    columns: list[str]
    incomplete: list[str]
    centre: np.ndarray
    maps: dict[int, np.ndarray]
    start: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        pattern = _pattern(self.incomplete)
        out = {}
        for name in self.incomplete:
            j = self.columns.index(name)
            filled = F.lit(float(self.start[j]))
            cases = None
            for bits, weights in self.maps.items():
                if bits >> self.incomplete.index(name) & 1:
                    value = F.lit(float(weights[j, 0] + self.centre[j]))
                    for i, c in enumerate(self.columns):
                        if weights[j, i + 1]:
                            value = value + F.lit(float(weights[j, i + 1])) * (
                                col(c).cast("double") - float(self.centre[i]))
                    cases = (F if cases is None else cases).when(pattern == bits, value)
            filled = cases.otherwise(filled) if cases is not None else filled
            out[name] = F.coalesce(col(name).cast("double"), filled)
        return df.select(*[out[c].alias(c) if c in out else col(c) for c in df.columns])


def _pattern(incomplete: list[str]):
    bits = F.lit(0).cast("bigint")
    for i, c in enumerate(incomplete):
        bits = bits + F.when(col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return bits


def fit_regression_fill(df: DataFrame, columns: list[str], max_iter: int = 10,
                        tol: float = 1e-9) -> RegressionFill:
    """Columns are visited from fewest to most missing cells, starting from the means."""
    require_numeric(df, *columns)
    if len(columns) < 2:
        raise ColumnError("regression needs two or more numeric columns")
    x = [col(c).cast("double") for c in columns]
    d = len(columns)
    head = df.agg(F.count(F.lit(1)), *[F.count(c) for c in x], *[F.avg(c) for c in x]).first()
    rows, known, means = head[0], head[1:d + 1], head[d + 1:]
    if any(m is None for m in means):
        raise ColumnError("a column without any value cannot be filled")
    order = sorted((i for i in range(d) if known[i] < rows), key=lambda i: rows - known[i])
    incomplete = [columns[i] for i in order]
    if len(incomplete) > 62:
        raise ColumnError("at most 62 incomplete columns")
    centre = np.array(means, dtype=float)
    z = [F.coalesce(c - float(m), F.lit(0.0)) for c, m in zip(x, centre)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    grouped = df.groupBy(_pattern(incomplete).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in z]).alias("s"),
        F.array(*[F.sum(z[i] * z[j]) for i, j in pairs]).alias("g"))
    patterns = grouped.limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ColumnError(f"more than {MAX_PATTERNS} patterns of missing cells")

    moments, maps = {}, {}
    for row in patterns:
        m = np.zeros((d + 1, d + 1))
        m[0, 0], m[0, 1:], m[1:, 0] = row["n"], row["s"], row["s"]
        for (i, j), v in zip(pairs, row["g"]):
            m[i + 1, j + 1] = m[j + 1, i + 1] = v
        moments[row["bits"]] = m
        full = np.zeros((d, d + 1))  # filled row = full @ [1, known cells]; missing start at the mean
        for i, c in enumerate(columns):
            if not (c in incomplete and row["bits"] >> incomplete.index(c) & 1):
                full[i, i + 1] = 1.0
        maps[row["bits"]] = full

    for _ in range(max_iter):
        moved = 0.0
        for place, j in enumerate(order):
            others = [i for i in range(d) if i != j]
            total = np.zeros((d + 1, d + 1))
            for bits, full in maps.items():
                if not bits >> place & 1:
                    lifted = np.vstack([np.eye(1, d + 1), full])
                    total += lifted @ moments[bits] @ lifted.T
            intercept, slope = _bayesian_ridge(total, [i + 1 for i in others], j + 1)
            for bits, full in maps.items():
                if bits >> place & 1:
                    new = slope @ full[others]
                    new[0] += intercept
                    moved = max(moved, float(np.abs(new - full[j]).max()))
                    full[j] = new
        if moved <= tol * max(1.0, float(np.abs(centre).max())):
            break
    return RegressionFill(columns, incomplete, centre, maps, centre)


def _bayesian_ridge(moment: np.ndarray, xs: list[int], y: int,
                    max_iter: int = 300, tol: float = 1e-3) -> tuple[float, np.ndarray]:
    """Evidence-maximising ridge regression from the matrix of sums of products."""
    n = moment[0, 0]
    mean = moment[0] / n
    cov = moment - n * np.outer(mean, mean)
    gram, cross, yy = cov[np.ix_(xs, xs)], cov[xs, y], max(cov[y, y], 0.0)
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    turned = vectors.T @ cross
    tiny = np.finfo(float).eps
    prior = 1e-6  # shape and rate of both gamma priors
    alpha, lam = 1.0 / (yy / n + tiny), 1.0
    slope = np.zeros(len(xs))
    for i in range(max_iter):
        new = vectors @ (turned / (values + lam / alpha))
        residual = max(yy - 2 * new @ cross + new @ gram @ new, 0.0)
        gamma = float(np.sum(alpha * values / (lam + alpha * values)))
        lam = (gamma + 2 * prior) / (float(new @ new) + 2 * prior)
        alpha = (n - gamma + 2 * prior) / (residual + 2 * prior)
        done = i > 0 and np.abs(new - slope).sum() < tol
        slope = new
        if done:
            break
    slope = vectors @ (turned / (values + lam / alpha))
    return float(mean[y] - slope @ mean[xs]), slope
