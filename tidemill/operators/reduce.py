"""Dimensionality reduction: sums over the rows give a columns x columns matrix, its eigenvectors give
the projection, and the projection is a plain column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import ColumnError, col, numeric_columns, require

METHODS = ("pca", "truncated_svd", "lda")
PRODUCTS_PER_PASS = 500


@dataclass
class Projection:
    """Standardised columns times ``weights`` (columns x components)."""

    method: str
    columns: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[list[float]]
    target: str | None = None
    keep: list[str] = field(default_factory=list)
    explained: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        z = [(col(c).cast("double") - float(m)) / float(s)
             for c, m, s in zip(self.columns, self.mean, self.scale)]
        out = []
        for j in range(len(self.weights[0])):
            total = F.lit(0.0)
            for i, x in enumerate(z):
                total = total + x * float(self.weights[i][j])
            out.append(total.alias(f"{self.method}_{j + 1}"))
        rest = list(self.keep) + ([self.target] if self.target and self.target in df.columns else [])
        return df.select(*out, *map(col, rest))

    def report(self, df: DataFrame) -> DataFrame:
        rows = [(self.method, j + 1, float(v)) for j, v in enumerate(self.explained)]
        return df.sparkSession.createDataFrame(
            rows, "method string, component int, explained_variance_ratio double")


def _moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    x = [col(c).cast("double") for c in columns]
    row = df.agg(F.count(F.lit(1)), *[F.count(c) for c in x], *[F.avg(c) for c in x],
                 *[F.stddev_pop(c) for c in x]).first()
    d, n = len(columns), row[0]
    gaps = [c for c, k in zip(columns, row[1:d + 1]) if k < n]
    if gaps:
        raise ColumnError(f"columns with missing values must be filled first: {gaps}")
    if n < 2:
        raise ColumnError("reduction needs at least two rows")
    scale = np.array([s or 1.0 for s in row[2 * d + 1:]])
    return n, np.array(row[d + 1:2 * d + 1]), scale


def _facing(vectors: np.ndarray) -> np.ndarray:
    """Turn each column so that its largest entry is positive."""
    peak = vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])]
    return vectors * np.where(peak < 0, -1.0, 1.0)


def fit_reduction(df: DataFrame, method: str, n_components: int, target: str | None = None,
                  keep: list[str] | None = None) -> Projection:
    if method not in METHODS:
        raise ColumnError(f"unknown method {method!r}")
    if method == "lda" and target is None:
        raise ColumnError("lda needs a target")
    require(df, *[c for c in [target, *(keep or [])] if c])
    columns = [c for c in numeric_columns(df) if c != target and c not in (keep or [])]
    if not columns:
        raise ColumnError("no numeric columns")
    if not 0 < n_components <= len(columns):
        raise ColumnError(f"n_components must be between 1 and {len(columns)}")
    n, mean, scale = _moments(df, columns)
    z = [(col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(columns, mean, scale)]
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    common = dict(method=method, columns=columns, mean=mean.tolist(), scale=scale.tolist(),
                  target=target, keep=list(keep or []))

    def square(values) -> np.ndarray:
        full = np.zeros((d, d))
        for (i, j), v in zip(pairs, values):
            full[i, j] = full[j, i] = v
        return full

    if method in ("pca", "truncated_svd"):
        # the columns are centred, so both are the eigenvectors of the same matrix
        sums: list[float] = []
        for start in range(0, len(pairs), PRODUCTS_PER_PASS):
            some = pairs[start:start + PRODUCTS_PER_PASS]
            sums += df.agg(F.array(*[F.sum(z[i] * z[j]) for i, j in some])).first()[0]
        values, vectors = np.linalg.eigh(square(sums) / n)
        best = np.argsort(values)[::-1][:n_components]
        share = np.maximum(values[best], 0.0) / max(float(values.sum()), 1e-300)
        return Projection(weights=_facing(vectors[:, best]).tolist(), explained=share.tolist(), **common)

    classes, unnamed = df.select(col(target).alias("label")).distinct().agg(
        F.count(F.lit(1)), F.count_if(F.col("label").isNull())).first()
    if unnamed:
        raise ColumnError("the target has missing values")
    if n_components > classes - 1:
        raise ColumnError(f"lda gives at most {classes - 1} components for {classes} classes")
    # the overall mean of standardised columns is zero, so what is not between the classes is within them
    sums = df.groupBy(col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(z)])
    total, between = np.zeros((d, d)), np.zeros((d, d))
    for start in range(0, len(pairs), PRODUCTS_PER_PASS):
        some = pairs[start:start + PRODUCTS_PER_PASS]
        for matrix, values in (
                (total, df.agg(F.array(*[F.sum(z[i] * z[j]) for i, j in some])).first()[0]),
                (between, sums.agg(F.array(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) for i, j in some])).first()[0])):
            for (i, j), v in zip(some, values):
                matrix[i, j] = matrix[j, i] = v
    within = (total - between) / (n - classes)
    between /= classes - 1
    values, vectors = np.linalg.eigh(within)
    solid = values > 1e-10 * values.max()
    whiten = vectors[:, solid] / np.sqrt(values[solid])
    ratios, turned = np.linalg.eigh(whiten.T @ between @ whiten)
    best = np.argsort(ratios)[::-1][:n_components]
    share = np.maximum(ratios[best], 0.0) / max(float(np.maximum(ratios, 0.0).sum()), 1e-300)
    return Projection(weights=_facing(whiten @ turned[:, best]).tolist(), explained=share.tolist(), **common)
