"""Feature selection: learn on the training part which columns to drop, drop them anywhere."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import ColumnError, col, is_numeric, numeric_columns, require
from tidemill.functions.durable import stage
from tidemill.operators.association import pearson_pairs

REGRESSION_VALUES = 20


@dataclass
class Selection:
    """Columns to drop; the target, if any, is moved to the end."""

    method: str
    dropped: list[str]
    target: str | None = None
    scores: dict[str, float | None] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in self.dropped and c != self.target]
        if not kept:
            raise ColumnError("no feature would remain")
        return df.select(*map(col, kept + ([self.target] if self.target else [])))

    def report(self, df: DataFrame) -> DataFrame:
        features = [c for c in df.columns if c != self.target]
        rows = [(self.method, c, c in self.dropped, self.scores.get(c)) for c in features]
        return df.sparkSession.createDataFrame(
            rows, "method string, feature string, dropped boolean, score double")


def _features(df: DataFrame, target: str | None, numeric: bool = True) -> list[str]:
    if target:
        require(df, target)
    return [c for c in (numeric_columns(df) if numeric else df.columns) if c != target]


def select_missing(df: DataFrame, threshold: float, target: str | None = None) -> Selection:
    if not 0 <= threshold <= 1:
        raise ColumnError("threshold must be between 0 and 1")
    columns = _features(df, target, numeric=False)
    row = df.agg(*[F.avg(col(c).isNull().cast("double")) for c in columns]).first()
    shares = dict(zip(columns, row))
    return Selection("missing_threshold", [c for c in columns if (shares[c] or 0) > threshold],
                     target, shares)


def select_variance(df: DataFrame, threshold: float = 0.0, target: str | None = None) -> Selection:
    columns = _features(df, target)
    if not columns:
        raise ColumnError("no numeric columns")
    row = df.agg(*[a for c in columns for a in (F.var_pop(col(c).cast("double")),
                                                F.max(col(c)) == F.min(col(c)))]).first()
    spread = {c: 0.0 if row[2 * i + 1] else row[2 * i] for i, c in enumerate(columns)}
    return Selection("variance_threshold",
                     [c for c in columns if spread[c] is not None and spread[c] <= threshold], target, spread)


def select_correlation(df: DataFrame, threshold: float, target: str | None = None) -> Selection:
    """Of every pair above the threshold the alphabetically later column goes."""
    if not 0 < threshold <= 1:
        raise ColumnError("threshold must be above 0 and at most 1")
    columns = _features(df, target)
    if len(columns) < 2:
        return Selection("correlation_threshold", [], target)
    rows = pearson_pairs(df, columns).collect()  # one row per column pair
    strong = [r for r in rows if r["r"] is not None and abs(r["r"]) > threshold]
    return Selection("correlation_threshold",
                     sorted({max(r["feature_1"], r["feature_2"]) for r in strong}), target)


def is_regression(df: DataFrame, target: str) -> bool:
    if not is_numeric(df, target):
        return False
    seen = df.select(col(target)).filter(col(target).isNotNull()).distinct().limit(REGRESSION_VALUES + 1)
    return seen.count() > REGRESSION_VALUES


def _require_complete(df: DataFrame, columns: list[str]) -> None:
    row = df.agg(*[F.count_if(col(c).isNull()) for c in columns]).first()
    gaps = [c for c, n in zip(columns, row) if n]
    if gaps:
        raise ColumnError(f"columns with missing values must be filled first: {gaps}")


def f_scores(df: DataFrame, columns: list[str], target: str) -> dict[str, float | None]:
    """Regression F for a numeric target with many values, otherwise one-way analysis of variance."""
    if is_regression(df, target):
        pairs = pearson_pairs(df, [target, *columns])
        rows = pairs.filter(F.col("feature_1") == target).collect()  # one row per column
        out = {}
        for r in rows:
            r2 = None if r["r"] is None else r["r"] ** 2
            out[r["feature_2"]] = None if r2 is None else (
                float("inf") if r2 >= 1 else r2 * (r["n"] - 2) / (1 - r2))
        return out
    means = df.agg(*[F.avg(col(c).cast("double")) for c in columns]).first()
    x = [col(c).cast("double") - F.lit(m) for c, m in zip(columns, means)]
    groups = df.groupBy(col(target)).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[a for i, v in enumerate(x) for a in (F.sum(v).alias(f"s{i}"), F.sum(v * v).alias(f"q{i}"))])
    row = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *[
        a for i in range(len(columns)) for a in (
            F.sum(f"s{i}").alias(f"s{i}"), F.sum(f"q{i}").alias(f"q{i}"),
            F.sum(F.col(f"s{i}") * F.col(f"s{i}") / F.col("n")).alias(f"b{i}"))]).first()
    out = {}
    for i, c in enumerate(columns):
        between = row[f"b{i}"] - row[f"s{i}"] ** 2 / row["n"]
        inner = row[f"q{i}"] - row[f"b{i}"]
        free = row["n"] - row["k"]
        if row["k"] < 2 or free <= 0:
            out[c] = None
        elif inner <= 0:
            out[c] = float("inf") if between > 0 else None
        else:
            out[c] = (between / (row["k"] - 1)) / (inner / free)
    return out


def select_k_best(df: DataFrame, k: int, target: str) -> Selection:
    columns = _features(df, target)
    if not columns:
        raise ColumnError("no numeric columns")
    if not 0 < k < len(columns):
        raise ColumnError(f"k must be between 1 and {len(columns) - 1}")
    _require_complete(df, columns)
    scores = f_scores(df, columns, target)
    best = sorted(columns, key=lambda c: (scores[c] is None, -(scores[c] or 0.0), columns.index(c)))
    return Selection("select_k_best", best[k:], target, scores)


def select_rfe(df: DataFrame, k: int, target: str, trees: int = 50, seed: int = 42) -> Selection:
    """Drop the least important numeric column of a random forest until k are left."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    columns = _features(df, target)
    if not 0 < k <= len(columns):
        raise ColumnError(f"k must be between 1 and {len(columns)}")
    _require_complete(df, columns + [target])
    data = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
                     col(target).alias("_target"))
    if is_regression(df, target):
        data = data.withColumn("_label", F.col("_target").cast("double"))
        forest = RandomForestRegressor(numTrees=trees, seed=seed, labelCol="_label", featuresCol="_x")
    else:
        data = StringIndexer(inputCol="_target", outputCol="_label", stringOrderType="alphabetAsc") \
            .fit(data.withColumn("_target", F.col("_target").cast("string"))) \
            .transform(data.withColumn("_target", F.col("_target").cast("string")))
        forest = RandomForestClassifier(numTrees=trees, seed=seed, labelCol="_label", featuresCol="_x")
    data = stage(data.drop("_target"), "forest")
    left, gone = list(range(len(columns))), []
    importance: dict[str, float | None] = {}
    while len(left) > k:
        ready = VectorAssembler(inputCols=[f"x{i}" for i in left], outputCol="_x").transform(data)
        weights = forest.fit(ready).featureImportances.toArray()
        worst = min(range(len(left)), key=lambda i: (weights[i], -left[i]))
        importance[columns[left[worst]]] = float(weights[worst])
        gone.append(columns[left.pop(worst)])
    return Selection("rfe", gone, target, importance)


def select_by_name(df: DataFrame, names: list[str], target: str | None = None) -> Selection:
    if not names:
        raise ColumnError("no names given")
    require(df, *names)
    return Selection("by_name", [n for n in names if n != target], target)
