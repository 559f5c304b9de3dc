"""Profiles, quality checks and association."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import functions as F

from tidemill.operators import association, profile, quality, sketches
from tidemill.operators.quantiles import exact_quantiles
from tidemill.plans.catalog import common as c

ROWS = "(SELECT count(*) FROM shaped_events)"


def describe_numeric_sql():
    return f"WITH {c.SHAPED_EVENTS} " + c.union_all(f"""
        SELECT '{n}' AS "column", round(avg({n}), 4) AS mean, round(stddev_samp({n}), 4) AS std,
            CAST(min({n}) AS DOUBLE) AS min, CAST(max({n}) AS DOUBLE) AS max,
            quantile_cont(CAST({n} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({n} AS DOUBLE), 0.5) AS q50,
            quantile_cont(CAST({n} AS DOUBLE), 0.75) AS q75,
            {_shape('skewness', n)} AS skewness, {_shape('kurtosis', n)} AS kurtosis,
            count(*) FILTER (WHERE {n} = 0) AS num_zeros, count(*) FILTER (WHERE {n} < 0) AS num_negatives FROM shaped_events"""
        for n in c.SHAPED_NUMBERS)


def _shape(f, n):
    return (f"round(CASE WHEN min({n}) = max({n}) THEN 0.0 ELSE coalesce({f}(CAST({n} AS DOUBLE)), 0.0) END, 4)"
            if n != "always" else "CAST(0.0 AS DOUBLE)")


NARROWED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def quantiles_narrowed(spark, d):
    """The plan for columns too large for one task."""
    found = exact_quantiles(c.table(spark, d, "lineitem"), list(NARROWED), [0.25, 0.5, 0.9], in_memory=0, gather=500)
    rows = [(n, p, v) for n, values in found.items() for p, v in zip((0.25, 0.5, 0.9), values)]
    return spark.createDataFrame(rows, "column string, prob double, value double").withColumn("value", F.round("value", 6))


def zero_of_two_signs(spark, d):
    """A column of 0.0 and -0.0 is constant."""
    signed = c.table(spark, d, "lineitem").select(F.expr("CASE WHEN l_tax > 0.04 THEN -0.0D ELSE 0.0D END AS nought"), "l_linenumber")
    return quality.quality_zero_variance(signed)


def narrowed_sql():
    return c.union_all(f"""SELECT '{n}' AS "column", CAST({p} AS DOUBLE) AS prob,
        round(quantile_cont(CAST({n} AS DOUBLE), {p}), 6) AS value FROM lineitem""" for n in NARROWED for p in (0.25, 0.5, 0.9))


def _described(spark, d):
    out = profile.describe_numeric(c.shaped_events(spark, d).drop("event_type"))
    return out.withColumns({n: F.round(n, 6) for n in ("min", "max", "q25", "q50", "q75")})


def describe_numeric_checked():
    return "SELECT * REPLACE (round(min, 6) AS min, round(max, 6) AS max, round(q25, 6) AS q25, " \
        f"round(q50, 6) AS q50, round(q75, 6) AS q75) FROM ({describe_numeric_sql()})"


def describe_categorical_sql(columns=("o_orderstatus", "o_orderpriority")):
    return f"WITH {c.GAPPY_ORDERS} " + c.union_all(f"""(
        WITH v AS (SELECT {n} AS value, count(*) AS n FROM gappy_orders WHERE {n} IS NOT NULL GROUP BY 1),
        t AS (SELECT count(*) AS total, count(*) FILTER (WHERE {n} IS NULL) AS missing,
            round(coalesce(avg(length({n})), 0.0), 2) AS avg_length FROM gappy_orders),
        u AS (SELECT count(*) AS unique_count, count(*) FILTER (WHERE n < 0.05 * (total - missing)) AS rare_count FROM v, t)
        SELECT '{n}' AS "column", unique_count, missing AS missing_count, rare_count, avg_length,
            CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS "rank", value, n AS "count",
            round(n * 100.0 / total, 2) AS percentage
        FROM v, t, u QUALIFY row_number() OVER (ORDER BY n DESC, value) <= 5)""" for n in columns)


def missing_sql():
    return f"WITH {c.SHAPED_EVENTS}, m AS ({c.union_all(_missing(n) for n in c.SHAPED_COLUMNS)}) " + """
        SELECT "column", "count", round("count" * 100.0 / total_rows, 2) AS percentage,
            CASE WHEN "count" * 100.0 / total_rows < 5 THEN 'low' WHEN "count" * 100.0 / total_rows < 20 THEN 'medium'
            ELSE 'high' END AS severity, total_rows FROM m WHERE "count" > 0"""


def _missing(n):
    return f"SELECT '{n}' AS \"column\", count(*) FILTER (WHERE {n} IS NULL) AS \"count\", count(*) AS total_rows FROM shaped_events"


OUTLIER_FIELDS = ("column", "severity", "method", "method_reason", "outlier_count", "outlier_percentage",
                  "iqr_only_count", "zscore_only_count", "sample_size")


def outlier_facts(n):
    x = f"CAST({n} AS DOUBLE)"
    return f"""(WITH s AS (SELECT count({n}) AS n, avg({x}) AS mean, stddev_samp({x}) AS std,
            CASE WHEN min({n}) = max({n}) THEN 0.0 ELSE skewness({x}) END AS sk,
            CASE WHEN min({n}) = max({n}) THEN 0.0 ELSE kurtosis({x}) END AS ku,
            quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM shaped_events),
        f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high,
            CASE WHEN n < 30 THEN 'IQR' WHEN abs(sk) >= 1 OR abs(ku) >= 3 THEN 'IQR'
                WHEN abs(sk) < 0.5 AND abs(ku) < 1 THEN 'Z-score' ELSE 'Both_intersection' END AS method,
            CASE WHEN n < 30 THEN 'small_sample_size' WHEN abs(sk) >= 1 THEN 'highly_skewed'
                WHEN abs(ku) >= 3 THEN 'heavy_tails' WHEN abs(sk) < 0.5 AND abs(ku) < 1 THEN 'approximately_normal'
                ELSE 'borderline_distribution' END AS method_reason FROM s),
        h AS (SELECT f.*, coalesce({x} < low OR {x} > high, false) AS iqr,
            coalesce(std > 0 AND abs({x} - mean) > 3 * std, false) AS z FROM shaped_events, f)
        SELECT '{n}' AS "column", any_value(method) AS method, any_value(method_reason) AS method_reason,
            any_value(n) AS sample_size,
            CASE any_value(method) WHEN 'IQR' THEN count(*) FILTER (WHERE iqr) WHEN 'Z-score' THEN count(*) FILTER (WHERE z)
                ELSE count(*) FILTER (WHERE iqr AND z) END AS outlier_count,
            CASE WHEN any_value(method) = 'Both_intersection' THEN count(*) FILTER (WHERE iqr AND NOT z) END AS iqr_only_count,
            CASE WHEN any_value(method) = 'Both_intersection' THEN count(*) FILTER (WHERE z AND NOT iqr) END AS zscore_only_count
        FROM h)"""


def outliers_sql():
    # a constant column has no shape, so its facts are left out: it can have no outliers
    parts = c.union_all(outlier_facts(n) for n in c.SHAPED_NUMBERS if n != "always")
    return f"""WITH {c.SHAPED_EVENTS}, o AS ({parts})
        SELECT "column", CASE WHEN outlier_count * 100.0 / sample_size < 1 THEN 'low'
            WHEN outlier_count * 100.0 / sample_size < 5 THEN 'medium' ELSE 'high' END AS severity,
            method, method_reason, outlier_count, round(outlier_count * 100.0 / sample_size, 2) AS outlier_percentage,
            iqr_only_count, zscore_only_count, sample_size FROM o WHERE outlier_count > 0"""


def distinct_facts():
    return c.union_all(f"""(WITH v AS (SELECT CAST({n} AS VARCHAR) AS value, count(*) AS n FROM shaped_events
            WHERE {n} IS NOT NULL GROUP BY {n})
        SELECT '{n}' AS "column", {str(n in c.SHAPED_NUMBERS).lower()} AS is_numeric, {ROWS} AS total_rows,
            count(*) AS unique_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS non_null_count, min(n) AS least_count,
            max(n) AS top_count, arg_max(value, n) AS top_value FROM v)""" for n in c.SHAPED_COLUMNS)


def on_distinct(select):
    return f"WITH {c.SHAPED_EVENTS}, f AS ({distinct_facts()}) {select}"


CARDINALITY = on_distinct("""SELECT "column", severity, unique_count, ratio, total_rows FROM (
    SELECT "column", unique_count, total_rows, round(unique_count / CAST(total_rows AS DOUBLE), 4) AS ratio,
        CASE WHEN is_numeric THEN CASE WHEN unique_count > 0.95 * total_rows THEN 'high'
            WHEN unique_count > 0.8 * total_rows THEN 'medium' WHEN unique_count > 0.5 * total_rows THEN 'low' END
        ELSE CASE WHEN unique_count > 200 THEN 'high' WHEN unique_count > 100 THEN 'medium'
            WHEN unique_count > 50 THEN 'low' END END AS severity FROM f) WHERE severity IS NOT NULL""")
ZERO = on_distinct("""SELECT "column", unique_count, top_value AS constant_value, non_null_count, total_rows FROM f
    WHERE non_null_count > 0 AND unique_count <= 1""")
NEAR_ZERO = on_distinct("""SELECT "column", unique_count, top_value AS dominant_value,
    round(top_count / CAST(non_null_count AS DOUBLE), 4) AS dominant_ratio,
    CASE WHEN unique_count = 2 THEN least_count END AS minority_count, total_rows FROM f
    WHERE unique_count >= 2 AND top_count / CAST(non_null_count AS DOUBLE) > 0.99""")

DUPLICATES = """WITH g AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority)
    SELECT CASE WHEN sum(n - 1) < 10 THEN 'low' WHEN sum(n - 1) < 100 THEN 'medium' ELSE 'high' END AS severity,
        CAST(sum(n - 1) AS BIGINT) AS duplicate_count, count(*) FILTER (WHERE n > 1) AS unique_duplicated_rows,
        CAST(sum(n) AS BIGINT) AS total_rows, round(sum(n - 1) * 100.0 / sum(n), 2) AS duplicate_percentage
    FROM g HAVING sum(n - 1) > 0"""


def quality_issues(spark, d):
    return quality.quality_issues(c.shaped_events(spark, d)).select("type", "column", "severity", "method")


def issues_sql():
    def part(sql, kind, method, severity):
        return f"SELECT '{kind}' AS type, \"column\", {severity} AS severity, {method} AS method FROM ({sql})"
    return c.union_all([
        part(missing_sql(), "missing_values", "'Percentage'", "severity"),
        part(outliers_sql(), "outliers", "method", "severity"),
        part(CARDINALITY, "high_cardinality", "'Unique_ratio'", "severity"),
        part(ZERO, "zero_variance", "'Unique_count'", "'high'"),
        part(NEAR_ZERO, "near_zero_variance", "'Dominant_value_ratio'", "'medium'")])


CORRELATED = ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
FIELDS = "feature_1, feature_2, round(r, 4) AS value, round(abs(r), 4) AS abs_value, sample_size, '{}' AS method"


def pearson_sql():
    parts = c.union_all(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r, "
                        f"count(*) AS sample_size FROM lineitem" for a, b in combinations(CORRELATED, 2))
    return f"SELECT {FIELDS.format('pearson')} FROM ({parts})"


RANKED = ("event_id", "user_id", "value")


def spearman_sql():
    parts = c.union_all(f"""(WITH k AS (SELECT {a} AS a, {b} AS b FROM gappy_events WHERE {a} IS NOT NULL
            AND {b} IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
            rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM k)
        SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr(ra, rb) AS r, count(*) AS sample_size FROM r)"""
        for a, b in combinations(RANKED, 2))
    return f"WITH {c.GAPPY_EVENTS} SELECT {FIELDS.format('spearman')} FROM ({parts})"


PAIRED = ("c_custkey", "c_nationkey", "c_acctbal")


def kendall_sql():
    parts = c.union_all(f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2,
            sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) / sqrt(CAST(count(*) FILTER (WHERE p.{a} <> q.{a}) AS DOUBLE)
                * count(*) FILTER (WHERE p.{b} <> q.{b})) AS r, (SELECT count(*) FROM customer) AS sample_size
        FROM customer p, customer q""" for a, b in combinations(PAIRED, 2))
    return f"SELECT {FIELDS.format('kendall')} FROM ({parts})"


def categorical(spark, d):
    df = c.banded_orders(spark, d).select(*c.BANDED_CATEGORIES)
    return association.categorical_association(df)


def contingency_sql(a, b):
    return f"""(WITH n AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM banded_orders GROUP BY 1, 2),
        g AS (SELECT x, y, coalesce(n, 0) AS n FROM (SELECT DISTINCT x FROM n) CROSS JOIN (SELECT DISTINCT y FROM n)
            LEFT JOIN n USING (x, y)),
        m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny,
            sum(n) OVER () AS total FROM g),
        e AS (SELECT *, CAST(nx AS DOUBLE) * ny / total AS e FROM m),
        s AS (SELECT any_value(total) AS total, count(DISTINCT x) AS r, count(DISTINCT y) AS k,
            sum((n - e) * (n - e) / e) AS plain,
            sum(pow(abs(n - e) - least(0.5, abs(n - e)), 2) / e) AS yates,
            sum(CASE WHEN n > 0 THEN CAST(n AS DOUBLE) / total * ln(CAST(n AS DOUBLE) * total / (CAST(nx AS DOUBLE) * ny))
                ELSE 0 END) AS mi FROM e),
        p AS (SELECT *, greatest(0, CASE WHEN r = 2 AND k = 2 THEN yates ELSE plain END / total
                - (k - 1) * (r - 1) / (total - 1.0)) AS phi,
            least(k - (k - 1) * (k - 1) / (total - 1.0), r - (r - 1) * (r - 1) / (total - 1.0)) - 1 AS narrow FROM s)
        SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(sqrt(phi / narrow), 4) AS value,
            CAST(total AS BIGINT) AS sample_size, round(abs(mi), 4) AS mutual_info FROM p)"""


CATEGORY_PAIRS = c.union_all(contingency_sql(a, b) for a, b in combinations(c.BANDED_CATEGORIES, 2))


def by_category(spark, d):
    return association.numeric_by_category(
        c.banded_orders(spark, d), ["o_orderkey", "o_totalprice"], list(c.BANDED_CATEGORIES))


def groups_sql(a, g):
    x = f"CAST({a} AS DOUBLE)"
    return f"""(WITH t AS (SELECT avg({x}) AS m, count(*) AS total FROM banded_orders),
        s AS (SELECT {g} AS g, count(*) AS n, avg({x}) AS gm FROM banded_orders GROUP BY 1),
        b AS (SELECT sum(n * (gm - m) * (gm - m)) AS ssb, count(*) AS k, any_value(total) AS total FROM s, t),
        w AS (SELECT sum(({x} - gm) * ({x} - gm)) AS ssw FROM banded_orders o JOIN s ON s.g = o.{g})
        SELECT '{a}' AS feature_1, '{g}' AS feature_2, round(sqrt(ssb / (ssb + ssw)), 4) AS value,
            total AS sample_size, round((ssb / (k - 1)) / (ssw / (total - k)), 4) AS anova_f_stat FROM b, w)"""


GROUP_PAIRS = c.union_all(groups_sql(a, g) for a, g in product(("o_orderkey", "o_totalprice"), c.BANDED_CATEGORIES))

def cardinality_sketched(spark, d):
    """Sketches of the events of each type, merged: are the counts inside the stated bound of the exact ones, and are the grades right?"""
    df = c.shaped_events(spark, d)
    parts = [df.filter(F.col("event_type").eqNullSafe(r[0])) for r in df.select("event_type").distinct().collect()]
    near = sketches.sketched_summary(sketches.merge_sketches(*[sketches.column_sketches(p) for p in parts]))
    exact = quality.distinct_summary(df).select("column", F.col("unique_count").alias("exact"))
    bound = F.lit(sketches.error_bound()) * F.col("exact")
    return near.join(exact, "column").select("column", "total_rows", "non_null_count", "exact",
                                             (F.abs(F.col("unique_count") - F.col("exact")) <= bound).alias("inside"))


SKETCHED = on_distinct('SELECT "column", total_rows, non_null_count, unique_count AS exact, true AS inside FROM f')

QUERIES = {
    "quality_zero_signs": (zero_of_two_signs, """SELECT 'nought' AS "column", CAST(1 AS BIGINT) AS unique_count,
        '0.0' AS constant_value, count(*) AS non_null_count, count(*) AS total_rows FROM lineitem"""),
    "quantiles_narrowed": (quantiles_narrowed, narrowed_sql()),
    "describe_numeric": (_described, describe_numeric_checked()),
    "describe_categorical": (lambda spark, d: profile.describe_categorical(
        c.gappy_orders(spark, d), ["o_orderstatus", "o_orderpriority"]), describe_categorical_sql()),
    "quality_missing": (lambda spark, d: quality.quality_missing(c.shaped_events(spark, d)), missing_sql()),
    "quality_outliers": (lambda spark, d: quality.quality_outliers(
        c.shaped_events(spark, d)).select(*OUTLIER_FIELDS), outliers_sql()),
    "quality_cardinality": (lambda spark, d: quality.quality_cardinality(c.shaped_events(spark, d)), CARDINALITY),
    "quality_cardinality_sketched": (cardinality_sketched, SKETCHED),
    "quality_duplicates": (lambda spark, d: quality.quality_duplicates(
        c.table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")), DUPLICATES),
    "quality_zero_variance": (lambda spark, d: quality.quality_zero_variance(c.shaped_events(spark, d)), ZERO),
    "quality_near_zero_variance": (lambda spark, d: quality.quality_near_zero_variance(
        c.shaped_events(spark, d)), NEAR_ZERO),
    "quality_issues": (quality_issues, issues_sql()),
    "corr_pearson": (lambda spark, d: association.correlation(
        c.table(spark, d, "lineitem"), "pearson", list(CORRELATED)), pearson_sql()),
    "corr_spearman": (lambda spark, d: association.correlation(
        c.gappy_events(spark, d), "spearman", list(RANKED)), spearman_sql()),
    "corr_kendall": (lambda spark, d: association.correlation(
        c.table(spark, d, "customer"), "kendall", list(PAIRED)), kendall_sql()),
    "cramers_v": (lambda spark, d: categorical(spark, d).select("feature_1", "feature_2", "value", "sample_size"),
        f"WITH {c.BANDED_ORDERS} SELECT feature_1, feature_2, value, sample_size FROM ({CATEGORY_PAIRS})"),
    "mutual_info": (lambda spark, d: categorical(spark, d).select("feature_1", "feature_2", "mutual_info"),
        f"WITH {c.BANDED_ORDERS} SELECT feature_1, feature_2, mutual_info FROM ({CATEGORY_PAIRS})"),
    "correlation_ratio": (lambda spark, d: by_category(spark, d).select(
        "feature_1", "feature_2", "value", "sample_size"),
        f"WITH {c.BANDED_ORDERS} SELECT feature_1, feature_2, value, sample_size FROM ({GROUP_PAIRS})"),
    "anova_f": (lambda spark, d: by_category(spark, d).select("feature_1", "feature_2", "anova_f_stat"),
        f"WITH {c.BANDED_ORDERS} SELECT feature_1, feature_2, anova_f_stat FROM ({GROUP_PAIRS})"),
    "anova_p": (lambda spark, d: by_category(spark, d).select("feature_1", "feature_2", "anova_p_val"), None),
}
