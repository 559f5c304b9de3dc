import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions.tails import f_upper_tail
from tidemill.operators import association


def numbers(spark, seed=0, n=120):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n).round(1)
    pdf = pd.DataFrame({"a": a, "b": (a * 2 + rng.normal(size=n)).round(1), "c": rng.integers(0, 4, n).astype(float)})
    pdf.loc[:9, "b"] = np.nan
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.to_numpy()]
    return pdf, spark.createDataFrame(rows, "a double, b double, c double")


def tau_b(x, y):
    keep = ~(np.isnan(x) | np.isnan(y))
    dx = np.sign(x[keep][:, None] - x[keep][None, :])
    dy = np.sign(y[keep][:, None] - y[keep][None, :])
    return (dx * dy).sum() / np.sqrt((dx != 0).sum() * (dy != 0).sum())


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlation(spark, method):
    pdf, df = numbers(spark)
    got = {(r["feature_1"], r["feature_2"]): r for r in association.correlation(df, method).collect()}
    assert len(got) == 3
    for (a, b), row in got.items():
        both = pdf[[a, b]].dropna()
        if method == "kendall":
            want = tau_b(both[a].to_numpy(), both[b].to_numpy())
        else:
            frame = both.rank() if method == "spearman" else both
            want = np.corrcoef(frame[a], frame[b])[0, 1]
        assert row["value"] == pytest.approx(want, abs=1e-4)
        assert row["sample_size"] == len(both)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 0.1) for i in range(9)], "a double, b double")
    assert association.correlation(df).first()["value"] is None


def test_kendall_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        pdf, df = numbers(spark, 3, 60)
        got = association.correlation(df, "kendall", ["a", "c"]).first()["value"]
        assert got == pytest.approx(tau_b(pdf["a"].to_numpy(), pdf["c"].to_numpy()), abs=1e-4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_f_tail(spark):
    # published quantiles of the F distribution: 5% and 1% points
    cases = [(4.9646, 1.0, 10.0, 0.05), (3.3258, 5.0, 10.0, 0.05), (5.6363, 5.0, 10.0, 0.01), (0.0, 2.0, 5.0, 1.0)]
    df = spark.createDataFrame(cases, "f double, a double, b double, p double")
    for row in df.select("p", f_upper_tail(F.col("f"), F.col("a"), F.col("b")).alias("got")).collect():
        assert row["got"] == pytest.approx(row["p"], abs=1e-4)


def test_two_by_two_uses_the_continuity_correction(spark):
    rows = [("x", "u")] * 20 + [("x", "v")] * 5 + [("y", "u")] * 4 + [("y", "v")] * 11
    df = spark.createDataFrame(rows, "p string, q string")
    observed = np.array([[20, 5], [4, 11.0]])
    expected = observed.sum(1, keepdims=True) * observed.sum(0) / 40
    chi2 = ((np.abs(observed - expected) - 0.5) ** 2 / expected).sum()
    n, phi = 40, max(0, chi2 / 40 - 1 / 39)
    want = np.sqrt(phi / ((2 - 1 / 39) - 1))
    row = association.categorical_association(df).first()
    assert row["value"] == pytest.approx(want, abs=1e-4) and row["sample_size"] == n


def test_only_columns_with_few_categories_are_compared(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("many"), F.lit("a").alias("one"),
                                 (F.col("id") % 3).cast("string").alias("few"))
    assert association.comparable_categories(df) == ["few"]
