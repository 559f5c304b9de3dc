"""Data-quality issues as one table: (type, column, severity, method, parameters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import col, numeric_columns
from tidemill.functions.durable import stage
from tidemill.functions.moments import ratio, sample_kurtosis, sample_skewness
from tidemill.operators.profile import column_stats, stack_columns
from tidemill.operators.quantiles import exact_quantiles
from tidemill.operators.valuecounts import value_counts

# Severity steps and distribution limits
MISSING_STEPS = (5.0, 20.0)
OUTLIER_STEPS = (1.0, 5.0)
RATIO_STEPS = (0.5, 0.8, 0.95)
DISTINCT_STEPS = (50, 100, 200)
DUPLICATE_STEPS = (10, 100)
MIN_OUTLIER_ROWS = 3
SMALL_SAMPLE = 30
HEAVY_SKEW, HEAVY_KURTOSIS = 1.0, 3.0
NEAR_NORMAL_SKEW, NEAR_NORMAL_KURTOSIS = 0.5, 1.0
IQR_FACTOR, Z_LIMIT = 1.5, 3.0
DOMINANT_SHARE = 0.99


def severity_below(c: Column, steps: tuple) -> Column:
    low, medium = steps
    return F.when(c < low, "low").when(c < medium, "medium").otherwise("high")


def quality_missing(df: DataFrame) -> DataFrame:
    share = F.col("count") * 100.0 / F.col("total_rows")
    return (stack_columns(df, df.columns, lambda c: {
        "count": F.count_if(col(c).isNull()), "total_rows": F.count(F.lit(1))})
        .filter(F.col("count") > 0)
        .select("column", "count", F.round(share, 2).alias("percentage"),
                severity_below(share, MISSING_STEPS).alias("severity"), "total_rows"))


def quality_outliers(df: DataFrame) -> DataFrame:
    """Pass 1 takes shape and quartiles of all columns, pass 2 counts against the bounds."""
    columns = numeric_columns(df)
    shape = column_stats(df, columns, lambda x: {
        "n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x),
        "skewness": sample_skewness(x), "kurtosis": sample_kurtosis(x)})
    moments = {r["column"]: r for r in shape.collect()}  # one row per column
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])

    counted, facts = {}, {}
    for c in columns:
        if c not in moments or moments[c]["n"] < MIN_OUTLIER_ROWS:
            continue
        m, (q1, q3) = moments[c], quartiles[c]
        low, high = q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)
        x = col(c).cast("double")
        iqr = x.isNotNull() & ((x < low) | (x > high))
        z = F.abs(x - m["mean"]) / m["std"] > Z_LIMIT if m["std"] else F.lit(False)
        z = F.coalesce(z, F.lit(False))
        skew, kurt = abs(m["skewness"] or 0.0), abs(m["kurtosis"] or 0.0)
        if m["n"] < SMALL_SAMPLE:
            method, reason = "IQR", "small_sample_size"
        elif skew >= HEAVY_SKEW or kurt >= HEAVY_KURTOSIS:
            method, reason = "IQR", "highly_skewed" if skew >= HEAVY_SKEW else "heavy_tails"
        elif skew < NEAR_NORMAL_SKEW and kurt < NEAR_NORMAL_KURTOSIS:
            method, reason = "Z-score", "approximately_normal"
        else:
            method, reason = "Both_intersection", "borderline_distribution"
        hit = {"IQR": iqr, "Z-score": z}.get(method, iqr & z)
        counted[c] = [F.count_if(hit), F.count_if(iqr & ~z), F.count_if(z & ~iqr)]
        facts[c] = (method, reason, m, q1, q3, low, high)
    fields = ("column string, severity string, method string, method_reason string, "
              "outlier_count bigint, outlier_percentage double, iqr_only_count bigint, "
              "zscore_only_count bigint, sample_size bigint, skewness double, kurtosis double, "
              "q1 double, q3 double, lower_fence double, upper_fence double, mean double, std double")
    rows = []
    if counted:
        totals = df.agg(*[F.array(*v).alias(f"a{i}") for i, v in enumerate(counted.values())]).first()
        for (c, (method, reason, m, q1, q3, low, high)), (hits, only_iqr, only_z) in zip(
                facts.items(), totals):
            if hits:
                share = hits * 100.0 / m["n"]
                level = "low" if share < OUTLIER_STEPS[0] else (
                    "medium" if share < OUTLIER_STEPS[1] else "high")
                both = method == "Both_intersection"
                rows.append((c, level, method, reason, hits, share, only_iqr if both else None,
                             only_z if both else None, m["n"], m["skewness"], m["kurtosis"],
                             q1, q3, low, high, m["mean"], m["std"]))
    report = df.sparkSession.createDataFrame(rows, fields)
    rounded = {"outlier_percentage": 2, "skewness": 4, "kurtosis": 4, "q1": 4, "q3": 4,
               "lower_fence": 4, "upper_fence": 4, "mean": 4, "std": 4}
    return report.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c)
                           for c in report.columns])


def distinct_summary(df: DataFrame) -> DataFrame:
    """Per column: rows, non-null rows, distinct values and the most frequent value, in one shuffle."""
    counts = value_counts(df, df.columns)
    best = F.max_by(F.struct("value", "n"), F.struct(F.col("n"), F.col("value"))).alias("top")
    per_value = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("non_null_count"),
        F.min("n").alias("least_count"), best)
    total = stack_columns(df.select(F.lit(1).alias("one")), ["one"],
                          lambda c: {"total_rows": F.count(F.lit(1))}).first()["total_rows"]
    every = df.sparkSession.createDataFrame(
        [(c, c in set(numeric_columns(df))) for c in df.columns], "column string, is_numeric boolean")
    # one row per column on both sides
    return (every.join(per_value, "column", "left")
            .select("column", "is_numeric", F.lit(total).cast("bigint").alias("total_rows"),
                    *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
                      for c in ("unique_count", "non_null_count", "least_count")],
                    F.col("top.value").alias("top_value"), F.col("top.n").alias("top_count")))


def quality_cardinality(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    summary = summary if summary is not None else distinct_summary(df)
    share = ratio(F.col("unique_count"), F.col("total_rows"))

    def level(c, steps):
        return F.when(c > steps[2], "high").when(c > steps[1], "medium").when(c > steps[0], "low")

    graded = F.when(F.col("is_numeric"), level(share, RATIO_STEPS)) \
        .otherwise(level(F.col("unique_count"), DISTINCT_STEPS))
    return (summary.withColumn("severity", graded).filter(F.col("severity").isNotNull())
            .select("column", "severity", "unique_count", F.round(share, 4).alias("ratio"), "total_rows"))


def quality_zero_variance(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    summary = summary if summary is not None else distinct_summary(df)
    return (summary.filter((F.col("non_null_count") > 0) & (F.col("unique_count") <= 1))
            .select("column", "unique_count", F.col("top_value").alias("constant_value"),
                    "non_null_count", "total_rows"))


def quality_near_zero_variance(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    summary = summary if summary is not None else distinct_summary(df)
    share = ratio(F.col("top_count"), F.col("non_null_count"))
    minority = F.when(F.col("unique_count") == 2, F.col("least_count"))
    return (summary.filter((F.col("unique_count") >= 2) & (share > DOMINANT_SHARE))
            .select("column", "unique_count", F.col("top_value").alias("dominant_value"),
                    F.round(share, 4).alias("dominant_ratio"), minority.alias("minority_count"),
                    "total_rows"))


def quality_duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows; equal rows merge before the shuffle."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return (groups.agg(F.sum(F.col("_n") - 1).alias("duplicate_count"),
                       F.count_if(F.col("_n") > 1).alias("unique_duplicated_rows"),
                       F.sum("_n").alias("total_rows"))
            .filter(F.col("duplicate_count") > 0)
            .select(severity_below(F.col("duplicate_count"), DUPLICATE_STEPS).alias("severity"),
                    "duplicate_count", "unique_duplicated_rows", "total_rows",
                    F.round(F.col("duplicate_count") * 100.0 / F.col("total_rows"), 2)
                    .alias("duplicate_percentage")))


def quality_issues(df: DataFrame) -> DataFrame:
    """All checks in one long table; the parameters of each issue are a JSON object."""
    summary = stage(distinct_summary(df), "distinct")  # one row per column, read three times

    def issue(frame: DataFrame, kind: str, method, level, column=F.col("column")) -> DataFrame:
        details = [c for c in frame.columns if c not in ("column", "severity", "method")]
        return frame.select(F.lit(kind).alias("type"), column.alias("column"), level.alias("severity"),
                            method.alias("method"), F.to_json(F.struct(*details)).alias("parameters"))

    given = F.col("severity")
    return (issue(quality_missing(df), "missing_values", F.lit("Percentage"), given)
            .unionByName(issue(quality_outliers(df), "outliers", F.col("method"), given))
            .unionByName(issue(quality_cardinality(df, summary), "high_cardinality",
                               F.lit("Unique_ratio"), given))
            .unionByName(issue(quality_duplicates(df), "duplicate_rows", F.lit("Exact_match"), given,
                               F.lit("ALL_COLUMNS")))
            .unionByName(issue(quality_zero_variance(df, summary), "zero_variance",
                               F.lit("Unique_count"), F.lit("high")))
            .unionByName(issue(quality_near_zero_variance(df, summary), "near_zero_variance",
                               F.lit("Dominant_value_ratio"), F.lit("medium"))))
