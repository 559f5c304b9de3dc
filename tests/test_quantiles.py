import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemill.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def check(spark, values, **how):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    got = exact_quantiles(df, ["x"], PROBS, **how)["x"]
    want = np.quantile([v for v in values if v is not None], PROBS)
    assert got == pytest.approx(want.tolist())


@pytest.mark.parametrize("values", [
    list(range(1000)), [1.0] * 500 + [2.0] * 500, [1.0] * 499 + [1.5] + [2.0] * 500,
    [3.0] * 900 + list(range(100)), [None, 1.0, 2.0, None, 3.5],
    np.random.default_rng(1).exponential(size=5000).tolist()])
def test_narrowing_equals_sorting(spark, values):
    check(spark, values, in_memory=0, gather=10)
    check(spark, values)


def test_narrowing_takes_several_rounds(spark):
    df = spark.range(300_000).selectExpr("cast(pmod(xxhash64(id), 1000003) as double) as x")
    wide = exact_quantiles(df, ["x"], PROBS, in_memory=0, gather=5)["x"]
    assert wide == pytest.approx(exact_quantiles(df, ["x"], PROBS)["x"], rel=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_any_values(spark, values):
    check(spark, values, in_memory=0, gather=3)
