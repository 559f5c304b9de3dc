"""Outliers and missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.operators import impute
from tidemill.operators.impute_iterative import fit_regression_fill
from tidemill.operators.impute_knn import fit_neighbour_fill
from tidemill.operators.outliers import fit_outliers, remove_outliers
from tidemill.plans.catalog import common as c


def outliers(method, threshold=None):
    return lambda spark, d: remove_outliers(c.gappy_events(spark, d), "value", method, threshold)


BOUNDS = {
    "zscore": ("avg(value) - 3 * stddev_samp(value)", "avg(value) + 3 * stddev_samp(value)"),
    "iqr": ("quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))",
            "quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))"),
    "modified_zscore": ("median(value) - 3.5 * mad(value) / 0.6745", "median(value) + 3.5 * mad(value) / 0.6745"),
}


def outliers_sql(method):
    low, high = BOUNDS[method]
    return f"""WITH {c.GAPPY_EVENTS}, b AS (SELECT {low} AS low, {high} AS high FROM gappy_events)
        SELECT g.* FROM gappy_events g, b WHERE value IS NULL OR value BETWEEN low AND high"""


def customers_lof(spark, d):
    return remove_outliers(c.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "lof", 0.05)


# the factor by its definition, over all pairs of customers; equal distances go by value
LOF = """WITH v AS (SELECT c_custkey AS k, c_acctbal AS x FROM customer),
    near AS (SELECT a.k AS k, b.k AS o, abs(a.x - b.x) AS d FROM v a JOIN v b ON a.k <> b.k
        QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY abs(a.x - b.x), b.x) <= 20),
    kd AS (SELECT k, max(d) AS kd FROM near GROUP BY k),
    lrd AS (SELECT near.k, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near JOIN kd ON kd.k = near.o GROUP BY near.k),
    lof AS (SELECT near.k, avg(p.lrd) / any_value(own.lrd) AS lof FROM near JOIN lrd p ON p.k = near.o
        JOIN lrd own ON own.k = near.k GROUP BY near.k)
    SELECT c_custkey, c_acctbal FROM customer JOIN lof ON k = c_custkey
    WHERE lof <= (SELECT quantile_cont(lof, 0.95) FROM lof)"""


def random_sample_report(spark, d):
    """Nothing stays missing, known values stay, and every draw is a value seen before."""
    before = c.gappy_events(spark, d).select("event_id", F.col("value").alias("old"))
    after = impute_random_sample(spark, d).select("event_id", "value")
    seen = before.filter("old is not null").groupBy(F.col("old").alias("value")).agg(F.lit(1).alias("seen"))
    joined = after.join(before, "event_id").join(seen, "value", "left")
    return joined.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value").isNull()).alias("missing"),
                      F.count_if(F.col("old") == F.col("value")).alias("kept"),
                      F.count_if(F.col("seen").isNull()).alias("foreign_values"))


def outliers_report(spark, d):
    df = c.gappy_events(spark, d)
    return fit_outliers(df, "value", "iqr").report(df)


def fill(column, strategy, source, digits=None, **kw):
    def run(spark, d):
        df = source(spark, d)
        out = impute.fit_value_fill(df, column, strategy, **kw).transform(df)
        return out.withColumn(column, F.round(col(column), digits)) if digits else out
    return run


def event_fill(value):
    return f"""WITH {c.GAPPY_EVENTS} SELECT event_id, user_id, event_type, round(coalesce(value, {value}), 6) AS value
        FROM gappy_events"""


def impute_report(spark, d):
    df = c.gappy_events(spark, d)
    filled = impute.fit_value_fill(df, "value", "mean").report(df)
    return filled.withColumn("value_used", F.round(F.col("value_used").cast("double"), 6))


def impute_knn(spark, d):
    df = c.gappy_parts(spark, d)
    fitted = fit_neighbour_fill(df, "p_retailprice", ["p_partkey"], ["p_size", "p_retailprice"], k=5)
    return fitted.transform(df).withColumn("p_retailprice", F.round("p_retailprice", 4))


def impute_knn_gappy(spark, d):
    """Three features, each with gaps of its own."""
    df = c.gappy_baskets(spark, d)
    fitted = fit_neighbour_fill(df, "price", ["l_orderkey"], ["quantity", "discount", "tax", "price"], k=5)
    return fitted.transform(df).withColumn("price", F.round("price", 3))


def impute_iterative(spark, d):
    df = c.gappy_parts(spark, d)
    out = fit_regression_fill(df, ["p_partkey", "p_size", "p_retailprice"]).transform(df)
    return out.select("p_partkey", F.round("p_size", 4).alias("p_size"),
                      F.round("p_retailprice", 4).alias("p_retailprice"))


def impute_random_sample(spark, d):
    df = c.gappy_events(spark, d)
    return impute.fit_random_fill(df, "value").transform(df, ["event_id"])


QUERIES = {
    **{f"outliers_{m}": (outliers(m), outliers_sql(m)) for m in BOUNDS},
    "outliers_isolation_forest": (outliers("isolation_forest", 0.05), None),
    "outliers_lof": (customers_lof, LOF),
    "outliers_lof_events": (outliers("lof", 0.05), None),
    "outliers_report": (outliers_report, f"""
        WITH {c.GAPPY_EVENTS}, q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
            FROM gappy_events), b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
        SELECT 'value' AS "column", 'iqr' AS method, CAST(1.5 AS DOUBLE) AS threshold,
            count(*) FILTER (WHERE value IS NOT NULL AND value NOT BETWEEN low AND high) AS rows_removed,
            count(*) FILTER (WHERE value IS NULL OR value BETWEEN low AND high) AS remaining_rows,
            round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, round(any_value(q3 - q1), 4) AS iqr,
            round(any_value(low), 4) AS lower_bound, round(any_value(high), 4) AS upper_bound
        FROM gappy_events, b"""),
    "impute_mean": (fill("value", "mean", c.gappy_events, 6),
                    event_fill("(SELECT avg(value) FROM gappy_events)")),
    "impute_median": (fill("value", "median", c.gappy_events, 6),
                      event_fill("(SELECT median(value) FROM gappy_events)")),
    "impute_mode": (fill("o_orderpriority", "mode", c.gappy_orders), f"""
        WITH {c.GAPPY_ORDERS}, best AS (SELECT o_orderpriority AS v FROM gappy_orders
            WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT o_orderkey, o_orderstatus, coalesce(o_orderpriority, v) AS o_orderpriority
        FROM gappy_orders, best"""),
    "impute_constant": (fill("o_orderpriority", "constant", c.gappy_orders, constant="0-NONE"),
        f"WITH {c.GAPPY_ORDERS} SELECT o_orderkey, o_orderstatus, coalesce(o_orderpriority, '0-NONE') "
        "AS o_orderpriority FROM gappy_orders"),
    "impute_drop_rows": (fill("value", "drop_rows", c.gappy_events),
        f"WITH {c.GAPPY_EVENTS} SELECT * FROM gappy_events WHERE value IS NOT NULL"),
    "impute_ffill": (lambda spark, d: impute.fill_forward(c.gappy_events(spark, d), "value", ["event_id"]), f"""
        WITH {c.GAPPY_EVENTS} SELECT event_id, user_id, event_type, coalesce(
            last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING),
            first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            ) AS value FROM gappy_events"""),
    "impute_bfill": (lambda spark, d: impute.fill_backward(c.gappy_events(spark, d), "value", ["event_id"]), f"""
        WITH {c.GAPPY_EVENTS} SELECT event_id, user_id, event_type, coalesce(
            first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
            last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS value
        FROM gappy_events"""),
    "impute_interpolate": (lambda spark, d: impute.fill_interpolated(
        c.gappy_events(spark, d), "value", ["event_id"]).withColumn("value", F.round("value", 4)), f"""
        WITH {c.GAPPY_EVENTS}, p AS (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM gappy_events),
        w AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS v0, first_value(value IGNORE NULLS) OVER b AS v1,
            last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0,
            first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1 FROM p
            WINDOW a AS (ORDER BY i ROWS UNBOUNDED PRECEDING),
                b AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, user_id, event_type, round(CASE WHEN value IS NOT NULL THEN value
            WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0
            ELSE v0 + (v1 - v0) * ((i - i0) / CAST(i1 - i0 AS DOUBLE)) END, 4) AS value FROM w"""),
    "impute_random_sample": (impute_random_sample, None),
    "impute_random_sample_report": (random_sample_report, f"""WITH {c.GAPPY_EVENTS} SELECT count(*) AS total,
        CAST(0 AS BIGINT) AS missing, count(value) AS kept, CAST(0 AS BIGINT) AS foreign_values FROM gappy_events"""),
    "impute_knn": (impute_knn, f"""
        WITH {c.GAPPY_PARTS}, g AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM gappy_parts),
        pairs AS (SELECT q.p_partkey AS k, t.p_partkey AS i, t.p_retailprice AS v,
            (q.p_size - t.p_size) * (q.p_size - t.p_size) * 2.0 AS far
            FROM g q JOIN g t ON q.p_retailprice IS NULL AND t.p_retailprice IS NOT NULL AND q.p_size - t.p_size IS NOT NULL),
        near AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY far, i) AS r FROM pairs),
        fills AS (SELECT k, avg(v) AS v FROM near WHERE r <= 5 GROUP BY k)
        SELECT o.p_partkey, o.p_size, round(coalesce(o.p_retailprice, f.v, (SELECT avg(p_retailprice) FROM g)), 4)
            AS p_retailprice FROM gappy_parts o LEFT JOIN fills f ON f.k = o.p_partkey"""),
    "impute_knn_gappy": (impute_knn_gappy, f"""
        WITH {c.GAPPY_BASKETS}, pairs AS (SELECT q.l_orderkey AS k, t.l_orderkey AS i, t.price AS v,
            (coalesce((q.quantity - t.quantity) * (q.quantity - t.quantity), 0.0)
                + coalesce((q.discount - t.discount) * (q.discount - t.discount), 0.0)
                + coalesce((q.tax - t.tax) * (q.tax - t.tax), 0.0))
            * (4.0 / nullif(CAST((q.quantity - t.quantity IS NOT NULL) AS INT) + CAST((q.discount - t.discount IS NOT NULL) AS INT)
                + CAST((q.tax - t.tax IS NOT NULL) AS INT), 0)) AS far
            FROM gappy_baskets q JOIN gappy_baskets t ON q.price IS NULL AND t.price IS NOT NULL),
        near AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY far, i) AS r FROM pairs WHERE far IS NOT NULL),
        fills AS (SELECT k, avg(v) AS v FROM near WHERE r <= 5 GROUP BY k)
        SELECT o.l_orderkey, o.quantity, o.discount, o.tax,
            round(coalesce(o.price, f.v, (SELECT avg(price) FROM gappy_baskets)), 3) AS price
        FROM gappy_baskets o LEFT JOIN fills f ON f.k = o.l_orderkey"""),
    "impute_iterative": (impute_iterative, None),
    "impute_report": (impute_report, f"""WITH {c.GAPPY_EVENTS}
        SELECT 'value' AS "column", 'mean' AS strategy, round(avg(value), 6) AS value_used,
            count(*) FILTER (WHERE value IS NULL) AS rows_affected, count(*) AS total_rows, 'double' AS dtype FROM gappy_events"""),
}
