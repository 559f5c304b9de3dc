import numpy as np
import pandas as pd
import pytest
from conftest import column
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemill.functions.columns import ColumnError, nan_to_null
from tidemill.operators import impute
from tidemill.operators.impute_iterative import fit_regression_fill
from tidemill.operators.impute_knn import fit_neighbour_fill

KIND = "i int, x double"


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], KIND)


def test_value_fills(spark):
    df = frame(spark, [1.0, None, 3.0, None, 5.0])
    for strategy in ("mean", "median"):
        fitted = impute.fit_value_fill(df, "x", strategy)
        assert fitted.value == 3.0
        assert column(fitted.transform(df), "x") == [1, 3, 3, 3, 5]
    assert impute.fit_value_fill(df, "x", "mean").report(df).first()["rows_affected"] == 2
    words = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, None), (4, "b")], "i int, w string")
    assert impute.fit_value_fill(words, "w", "mode").value == "a"  # the smaller value wins a tie
    assert column(impute.fit_value_fill(words, "w", "constant", "z").transform(words), "w")[3] == "z"
    assert impute.fit_value_fill(words, "w", "drop_rows").transform(words).count() == 4


def test_fitted_on_train_applies_to_test(spark):
    fitted = impute.fit_value_fill(frame(spark, [2.0, 4.0]), "x", "mean")
    assert column(fitted.transform(frame(spark, [None, 9.0])), "x") == [3.0, 9.0]


def test_errors(spark):
    df = frame(spark, [None, None])
    words = spark.createDataFrame([("a",)], "w string")
    for call in (lambda: impute.fit_value_fill(df, "x", "mean"), lambda: impute.fit_value_fill(df, "x", "mode"),
                 lambda: impute.fit_value_fill(words, "w", "median"), lambda: impute.fit_random_fill(df, "x"),
                 lambda: impute.fit_value_fill(df, "x", "constant", "word"),
                 lambda: impute.fit_value_fill(df, "y", "mean")):
        with pytest.raises(ColumnError):
            call()


def test_fills(spark):
    assert column(impute.fill_forward(frame(spark, [1.0, None, None, 4.0, None]), "x", ["i"]), "x") == [1, 1, 1, 4, 4]
    assert column(impute.fill_backward(frame(spark, [None, None, 3.0, None, 5.0]), "x", ["i"]), "x") == [3, 3, 3, 5, 5]
    assert column(impute.fill_interpolated(frame(spark, [0.0, None, 2.0, None, 4.0]), "x", ["i"]), "x") == [0, 1, 2, 3, 4]


def test_fills_over_many_ranges(spark):
    """One row per range: everything is carried across borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        values = [None, None, 5.0, None, None, None, 8.0, None, 1.0, None, None, None]
        s = pd.Series(values, dtype=float)
        df = frame(spark, values)
        assert column(impute.fill_forward(df, "x", ["i"]), "x") == s.ffill().bfill().tolist()
        assert column(impute.fill_backward(df, "x", ["i"]), "x") == s.bfill().ffill().tolist()
        assert column(impute.fill_interpolated(df, "x", ["i"]), "x") == pytest.approx(
            s.interpolate(limit_direction="both").tolist())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@settings(max_examples=4, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=1, max_size=40).filter(
    lambda v: any(x is not None for x in v)))
def test_fills_equal_pandas(spark, values):
    s = pd.Series(values, dtype=float)
    df = frame(spark, values)
    assert column(impute.fill_forward(df, "x", ["i"]), "x") == s.ffill().bfill().tolist()
    assert column(impute.fill_interpolated(df, "x", ["i"]), "x") == pytest.approx(
        s.interpolate(limit_direction="both").tolist())


def test_random_fill(spark):
    values = [1.0] * 300 + [2.0] * 100 + [None] * 400
    df = frame(spark, values)
    fitted = impute.fit_random_fill(df, "x")
    out = column(fitted.transform(df, ["i"]), "x")
    assert len(out) == 800 and set(out) == {1.0, 2.0}
    assert out[:400] == values[:400]
    assert 0.6 < out[400:].count(1.0) / 400 < 0.9
    assert out == column(fitted.transform(df, ["i"]), "x")
    assert out != column(fitted.transform(df, ["i"], seed=43), "x")


def brute_knn(data, target, k):
    data = np.array(data, dtype=float)
    out = data[:, target].copy()
    d = data.shape[1]
    donors = [j for j in range(len(data)) if not np.isnan(data[j, target])]
    for i in range(len(data)):
        if np.isnan(out[i]):
            far = []
            for j in donors:
                gap = data[i] - data[j]
                present = (~np.isnan(gap)).sum()
                if present:
                    far.append((np.nansum(gap ** 2) * d / present, j))
            near = sorted(far)[:k]
            out[i] = np.mean([data[j, target] for _, j in near]) if near else np.nanmean(data[:, target])
    return out


@pytest.mark.parametrize("seed,gaps", [(0, (0, 0, .3)), (1, (0, .2, .3)), (2, (.3, .3, .3))])
def test_knn_equals_brute_force(spark, seed, gaps):
    rng = np.random.default_rng(seed)
    data = np.column_stack([rng.exponential(10, 150), rng.normal(0, 3, 150), rng.uniform(0, 1, 150)])
    data[:40, :2] = data[0, :2]  # a block of equal rows
    for c, share in enumerate(gaps):
        data[rng.random(150) < share, c] = np.nan
    df = nan_to_null(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)],
                                           "i int, a double, b double, c double"))
    got = column(fit_neighbour_fill(df, "c", ["i"], ["a", "b", "c"], 4).transform(df), "c")
    assert np.allclose(got, brute_knn(data, 2, 4))


def test_knn_with_a_dense_spot_and_far_rows(spark):
    """Most rows sit in a tiny spot, one is very far away: cells start small and grow as needed."""
    rng = np.random.default_rng(9)
    data = np.column_stack([rng.normal(0, 1e-3, 400), rng.normal(0, 1e-3, 400), rng.uniform(0, 1, 400)])
    data[:20, :2] = rng.uniform(-100, 100, (20, 2))
    data[0, 0] = 1e7
    data[rng.random(400) < .2, 2] = np.nan
    data[0, 2] = np.nan
    df = nan_to_null(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)],
                                           "i int, a double, b double, c double"))
    got = column(fit_neighbour_fill(df, "c", ["i"], ["a", "b", "c"], 3).transform(df), "c")
    assert np.allclose(got, brute_knn(data, 2, 3))


def plain_rounds(data, rounds):
    """Round-robin regression on a whole matrix in memory."""
    from tidemill.operators.impute_iterative import _bayesian_ridge

    missing = np.isnan(data)
    filled = np.where(missing, np.nanmean(data, axis=0), data)
    order = sorted((j for j in range(data.shape[1]) if missing[:, j].any()), key=lambda j: missing[:, j].sum())
    for _ in range(rounds):
        for j in order:
            others = [i for i in range(data.shape[1]) if i != j]
            known = ~missing[:, j]
            full = np.column_stack([np.ones(known.sum()), filled[known]])
            base, slope = _bayesian_ridge(full.T @ full, [i + 1 for i in others], j + 1)
            filled[~known, j] = base + filled[np.ix_(~known, others)] @ slope
    return filled


def test_iterative_equals_passes_over_the_matrix(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 2, 200)
    data = np.column_stack([a, 3 * a + rng.normal(0, .1, 200), rng.normal(5, 1, 200) - a])
    data[rng.random(data.shape) < .15] = np.nan
    data[np.isnan(data).all(axis=1), 0] = 0.0
    df = nan_to_null(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)],
                                           "i int, a double, b double, c double"))
    out = fit_regression_fill(df, ["a", "b", "c"], max_iter=3, tol=0.0).transform(df)
    got = np.array([list(r)[1:] for r in out.orderBy("i").collect()])
    assert np.allclose(got, plain_rounds(data, 3), atol=1e-6)


def test_fills_on_both_parts_of_a_split(spark):
    from tidemill.operators.split import Split

    train, test = frame(spark, [1.0, None, 3.0]), frame(spark, [None, 8.0, None, 10.0])
    both = Split(train, test)
    assert column(both.apply(impute.ordered_fill("x", "forward", ["i"])).test, "x") == [8, 8, 8, 10]
    assert column(both.apply(impute.ordered_fill("x", "backward", ["i"])).train, "x") == [1, 3, 3]
    assert column(both.apply(impute.ordered_fill("x", "interpolate", ["i"])).test, "x")[2] == 9
    drawn = both.apply(impute.fit_random_fill(train, "x", ["i"]))
    assert set(column(drawn.test, "x")) <= {1.0, 3.0, 8.0, 10.0} and None not in column(drawn.train, "x")
    dropped = both.apply(impute.fit_value_fill(train, "x", "drop_rows"))
    assert (dropped.train.count(), dropped.test.count()) == (2, 4)
