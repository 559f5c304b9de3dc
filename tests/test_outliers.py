import numpy as np
import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemill.functions.columns import ColumnError
from tidemill.operators import outlier_models
from tidemill.operators.outliers import fit_outliers, remove_outliers

INF = float("inf")


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")


def kept(spark, values, *args):
    return column(remove_outliers(frame(spark, [None if v is None else float(v) for v in values]), "x", *args), "x")


def test_bounds_methods(spark):
    assert kept(spark, [1, 2, 3, 4, 100], "iqr", 1.5) == [1, 2, 3, 4]
    fitted = fit_outliers(frame(spark, [1.0, 2.0, 3.0, 4.0, 100.0]), "x", "iqr")
    assert (fitted.stats["lower_bound"], fitted.stats["upper_bound"]) == (-1.0, 7.0)
    assert len(kept(spark, [*range(1, 9), 100, None], "iqr")) == 9
    assert kept(spark, [5] * 4, "zscore") == [5] * 4
    assert kept(spark, [0, 10], "zscore", 1.0) == [0, 10]
    assert kept(spark, [0, 10], "zscore", 0.5) == []
    assert kept(spark, [1, 2, 3, 4, 100], "modified_zscore") == [1, 2, 3, 4]
    assert len(kept(spark, [10, 12, 10, 11, 15], "modified_zscore", 2.5)) == 4
    assert len(kept(spark, [10, 12, 10, 11, 15], "modified_zscore", 3.0)) == 5
    rng = np.random.default_rng(0)
    assert len(kept(spark, [*np.clip(rng.normal(size=100), -2.5, 2.5), 100.0], "zscore", 3.0)) == 100


def test_infinite_values_stay(spark):
    assert INF in kept(spark, [1, 2, 3, 2, 1, INF], "zscore")


def test_arguments(spark):
    df = frame(spark, [1.0, 2.0])
    for method, t in (("iqr", 0), ("nothing", 1), ("lof", 0.7), ("isolation_forest", -1.0)):
        with pytest.raises(ColumnError):
            remove_outliers(df, "x", method, t)
    with pytest.raises(ColumnError):
        remove_outliers(df.withColumn("t", F.lit("a")), "t", "iqr")


def test_isolation_forest(spark):
    rng = np.random.default_rng(42)
    values = [*rng.normal(0, 1, 50), *rng.normal(20, 1, 5)]
    left = kept(spark, values, "isolation_forest", 0.1)
    assert 4 <= len(values) - len(left) <= 7
    assert len(kept(spark, [1, 2, 3], "isolation_forest", 0.1)) == 3
    assert len(kept(spark, [7] * 30, "isolation_forest")) == 30


def test_models_keep_missing_and_infinite(spark):
    values = [1, 2, 3, 4, 5] * 3 + [None, INF, -INF, 100]
    for method in ("isolation_forest", "lof"):
        left = kept(spark, values, method, 0.1)
        assert None in left and INF in left and -INF in left


def test_lof_case(spark):
    left = kept(spark, [1.0] * 10 + [10.0] * 10 + [5.5], "lof", 0.1)
    assert 5.5 not in left


def brute_lof(x, k):
    x = np.asarray(x)
    d = np.abs(x[:, None] - x[None, :])
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, order, 1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, order, 1), kd[order])
    lrd = 1 / (reach.mean(axis=1) + 1e-10)
    return lrd[order].mean(axis=1) / lrd


def test_lof_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(50, 5, 100), rng.uniform(-100, 100, 40)])
    df = frame(spark, x.tolist())
    fitted = outlier_models.fit_local_outlier_factor(df, "x", 0.1)
    got = np.array(column(fitted.scored(df, "lof"), "lof"))
    assert np.allclose(got, brute_lof(x, 20), rtol=1e-9)


def test_lof_over_many_small_ranges(spark):
    """Ranges smaller than the neighbourhood: the halo has to reach over several of them."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 120)
    df = frame(spark, x.tolist())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        fitted = outlier_models.fit_local_outlier_factor(df, "x", 0.1)
        got = np.array(column(fitted.scored(df, "lof"), "lof"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose(got, brute_lof(x, 20), rtol=1e-9)
