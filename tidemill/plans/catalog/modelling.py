"""Selection, reduction, splits, versions and pre-flight checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.durable import fresh_path
from tidemill.operators import select, split, versions
from tidemill.operators.encode import fit_encoder
from tidemill.operators.outliers import OutlierBounds, fit_outliers
from tidemill.operators.preflight import preflight
from tidemill.operators.reduce import fit_reduction
from tidemill.plans.catalog import common as c
from tidemill.plans.catalog.cleaning import outliers_sql


def lines(spark, d):
    return c.table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                               F.col("l_returnflag").alias("flag"))


def selected(df, fitted, digits=4):
    return fitted.report(df).select("feature", "dropped", F.round("score", digits).alias("score"))


def select_missing(spark, d):
    df = c.shaped_events(spark, d)
    return selected(df, select.select_missing(df, 0.1))


def select_variance(spark, d):
    df = c.shaped_events(spark, d).drop("event_type", "event_id")
    return selected(df, select.select_variance(df, 0.001))


def select_correlation(spark, d):
    df = lines(spark, d)
    return select.select_correlation(df, 0.5).report(df).select("feature", "dropped")


def select_k_best(spark, d):
    df = lines(spark, d)
    return selected(df, select.select_k_best(df, 2, "flag"), 6)


def select_k_best_regression(spark, d):
    df = c.table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return select.select_k_best(df, 1, "l_extendedprice").report(df).select("feature", "dropped")


K_BEST = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def k_best_sql():
    parts = c.union_all(f"""(WITH t AS (SELECT avg({x}) AS m FROM lineitem),
        s AS (SELECT l_returnflag AS g, count(*) AS n, avg({x}) AS gm FROM lineitem GROUP BY 1),
        b AS (SELECT sum(n * (gm - m) * (gm - m)) AS ssb, count(*) AS k, sum(n) AS total FROM s, t),
        w AS (SELECT sum(({x} - gm) * ({x} - gm)) AS ssw FROM lineitem JOIN s ON g = l_returnflag)
        SELECT '{x}' AS feature, (ssb / (k - 1)) / (ssw / (total - k)) AS f FROM b, w)""" for x in K_BEST)
    return f"SELECT feature, row_number() OVER (ORDER BY f DESC) > 2 AS dropped, round(f, 6) AS score FROM ({parts})"


def correlation_drop_sql():
    pairs = [(a, b) for i, a in enumerate(K_BEST) for b in K_BEST[i + 1:]]
    strong = c.union_all(f"SELECT '{max(a, b)}' AS f, corr({a}, {b}) AS r FROM lineitem" for a, b in pairs)
    names = c.union_all(f"SELECT '{x}' AS feature" for x in (*K_BEST, "flag"))
    return f"""WITH s AS ({strong}), n AS ({names})
        SELECT feature, feature IN (SELECT f FROM s WHERE abs(r) > 0.5) AS dropped FROM n"""


def select_rfe(spark, d):
    df = c.table(spark, d, "customer").select(
        "c_nationkey", "c_acctbal", F.char_length("c_name").alias("name_length"), "c_mktsegment")
    return select.select_rfe(df, 1, "c_mktsegment").report(df)


def numbers(spark, d):
    return lines(spark, d)


def reduce(method, k):
    def run(spark, d):
        df = numbers(spark, d)
        out = fit_reduction(df, method, k, target="flag").transform(df)
        return out.select(*[F.round(x, 6).alias(x) if x != "flag" else x for x in out.columns])
    return run


def part_counts(s, *by):
    named = s.train.withColumn("part", F.lit("train")).unionByName(s.test.withColumn("part", F.lit("test")))
    return named.groupBy("part", *by).agg(F.count(F.lit(1)).alias("n"))


def split_random(spark, d):
    df = c.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return part_counts(split.train_test_split(df, 0.2, ["o_orderkey"]))


def split_stratified(spark, d):
    df = c.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return part_counts(split.train_test_split(df, 0.2, ["o_orderkey"], stratify="o_orderstatus"), "o_orderstatus")


def split_ordered(spark, d):
    s = split.ordered_split(c.table(spark, d, "events").select("event_id", "value"), 0.2, ["event_id"])
    return s.train.withColumn("part", F.lit("train")).unionByName(s.test.withColumn("part", F.lit("test")))


def fit_train_apply_both(spark, d):
    """Encoder fitted on the earlier events, applied to both parts."""
    s = split.ordered_split(c.table(spark, d, "events").select("event_id", "event_type"), 0.2, ["event_id"])
    both = s.apply(fit_encoder(s.train, "event_type", "frequency"))
    out = both.train.withColumn("part", F.lit("train")).unionByName(both.test.withColumn("part", F.lit("test")))
    return out.withColumn("event_type_freq", F.round("event_type_freq", 6))


def split_row_filter_train_only(spark, d):
    """Outlier bounds drop rows of the training part and leave the test part alone."""
    s = split.ordered_split(c.table(spark, d, "events").select("event_id", "value"), 0.2, ["event_id"])
    return part_counts(s.apply(fit_outliers(s.train, "value", "iqr")))


PLACED = """placed AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY event_id) <=
    count(*) OVER () - ceil(count(*) OVER () * 0.2) THEN 'train' ELSE 'test' END AS part FROM events)"""


def history(spark, d, keep=versions.KEEP):
    """Load customers, keep those without debt, add a column."""
    kept = versions.VersionStore(spark, fresh_path(spark, "versions"), keep)
    df = c.table(spark, d, "customer")
    kept.snapshot(df, "load_data", {"dataset_name": "customer"})
    solvent = df.filter("c_acctbal >= 0")
    kept.snapshot(solvent, "remove_outliers", {"column": "c_acctbal"})
    kept.snapshot(solvent.withColumn("c_half", F.col("c_acctbal") / 2), "create_feature", {"name": "c_half"})
    return kept


SOLVENT = "(SELECT count(*) FROM customer WHERE c_acctbal >= 0)"
EVERYONE = "(SELECT count(*) FROM customer)"


def version_list(spark, d):
    return history(spark, d).list().select("version", "op", "rows", "columns", "pinned")


def version_snapshot(spark, d):
    return history(spark, d).read(2).drop("c_half")


def version_rollback(spark, d):
    kept = history(spark, d)
    return kept.read(kept.rollback(0))


def version_retention(spark, d):
    return history(spark, d, keep=2).list().select("version", "op", "rows", "pinned")


def version_steps_between(spark, d):
    return history(spark, d).steps_between(0, 2)


def before_after(spark, d):
    before = c.gappy_events(spark, d)
    after = before.filter("value is null or value < 200").withColumn("value", F.coalesce("value", F.lit(1.5))) \
        .withColumn("user_id", F.col("user_id").cast("int")).drop("event_type").withColumn("extra", F.lit(1))
    return before, after


AFTER = f"""{c.GAPPY_EVENTS}, after AS (SELECT event_id, CAST(user_id AS INTEGER) AS user_id,
    coalesce(value, 1.5) AS value, CAST(1 AS INTEGER) AS extra FROM gappy_events WHERE value IS NULL OR value < 200)"""


def stats_sql():
    def side(n, t, tag):
        return (f"round(avg({n}), 4) AS mean_{tag}, round(stddev_samp({n}), 4) AS std_{tag}, "
                f"round(CAST(min({n}) AS DOUBLE), 4) AS min_{tag}, round(CAST(max({n}) AS DOUBLE), 4) AS max_{tag} FROM {t}")
    parts = c.union_all(f"SELECT '{n}' AS \"column\", a.*, b.* FROM (SELECT {side(n, 'gappy_events', 'before')}) a, "
                        f"(SELECT {side(n, 'after', 'after')}) b" for n in ("event_id", "user_id", "value"))
    return f"""WITH {AFTER} SELECT * FROM ({parts}) WHERE NOT (mean_before = mean_after AND std_before = std_after
        AND min_before = min_after AND max_before = max_after)"""


def fitted_store(spark, d):
    df = c.gappy_events(spark, d)
    kept = versions.FittedStore(spark, fresh_path(spark, "fitted"))
    kept.save("iqr", fit_outliers(df, "value", "iqr", 3.0))
    name = kept.save("iqr", fit_outliers(df, "value", "iqr"))
    return kept.get(name, OutlierBounds).transform(df)


CHECKS = [
    ("impute", {"column": "value", "strategy": "median"}),
    ("drop_duplicate_rows", {"subset": ["user_id", "event_type"]}),
    ("encode", {"column": "event_type", "method": "binary"}),
    ("remove_outliers", {"column": "event_type", "method": "iqr"}),
    ("encode", {"column": "value", "method": "label"}),
    ("create_feature", {"name": "value", "expression": "1"}),
    ("train_test_split", {"test_size": 1.5}),
    ("drop_columns", {"columns": ["value", "nothing"]}),
]
CHECKED = f"""WITH {c.GAPPY_EVENTS}, n AS (SELECT count(*) FILTER (WHERE value IS NULL) AS gaps,
        count(*) - count(DISTINCT (user_id, event_type)) AS extra, count(DISTINCT event_type) AS k FROM gappy_events)
    SELECT 'impute' AS op, true AS allowed, gaps || ' rows of ''value'' using median' AS reason FROM n
    UNION ALL SELECT 'drop_duplicate_rows', true, 'drops ' || extra || ' duplicate rows' FROM n
    UNION ALL SELECT 'encode', true, CAST(ceil(log2(k + 1)) AS INTEGER) || ' new column(s) from ' || k || ' categories' FROM n
    UNION ALL SELECT 'remove_outliers', false, 'column ''event_type'' is not numeric'
    UNION ALL SELECT 'encode', false, 'column ''value'' is numeric'
    UNION ALL SELECT 'create_feature', false, 'feature ''value'' already exists'
    UNION ALL SELECT 'train_test_split', false, 'test_size must be between 0 and 1'
    UNION ALL SELECT 'drop_columns', false, 'columns not found: [''nothing'']'"""

MISSING_SHARE = c.union_all(
    f"SELECT '{n}' AS feature, avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END) AS s FROM shaped_events"
    for n in c.SHAPED_COLUMNS)
SPREAD = c.union_all(
    f"SELECT '{n}' AS feature, var_pop({n}) AS s FROM shaped_events" for n in c.SHAPED_NUMBERS if n != "event_id")

QUERIES = {
    "split_row_filter_train_only": (split_row_filter_train_only, f"""WITH {PLACED}, q AS (SELECT
        quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM placed WHERE part = 'train')
        SELECT part, count(*) AS n FROM placed, q WHERE part = 'test'
            OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY part"""),
    "select_missing": (select_missing, f"""WITH {c.SHAPED_EVENTS}, m AS ({MISSING_SHARE})
        SELECT feature, s > 0.1 AS dropped, round(s, 4) AS score FROM m"""),
    "select_variance": (select_variance, f"""WITH {c.SHAPED_EVENTS}, m AS ({SPREAD})
        SELECT feature, s <= 0.001 AS dropped, round(s, 4) AS score FROM m"""),
    "select_correlation": (select_correlation, correlation_drop_sql()),
    "select_k_best": (select_k_best, k_best_sql()),
    "select_k_best_regression": (select_k_best_regression, """WITH r AS (
        SELECT 'l_quantity' AS feature, abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem
        UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem
        UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem)
        SELECT feature, row_number() OVER (ORDER BY r DESC) > 1 AS dropped FROM r"""),
    "select_rfe": (select_rfe, None),
    "select_by_name": (lambda spark, d: select.select_by_name(
        lines(spark, d), ["l_tax"], "flag").transform(lines(spark, d)),
        "SELECT l_quantity, l_extendedprice, l_discount, l_returnflag AS flag FROM lineitem"),
    "reduce_pca": (reduce("pca", 2), None),
    "reduce_svd": (reduce("truncated_svd", 2), None),
    "reduce_lda": (reduce("lda", 2), None),
    "split_random": (split_random, """SELECT 'test' AS part, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n FROM orders
        UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) FROM orders"""),
    "split_stratified": (split_stratified, """
        WITH k AS (SELECT o_orderstatus, count(*) AS n, sum(count(*)) OVER () AS total FROM orders GROUP BY 1),
        q AS (SELECT *, ceil(total * 0.2) * n / CAST(total AS DOUBLE) AS exact, ceil(total * 0.2) AS wanted FROM k),
        o AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, o_orderstatus)
            <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM q)
        SELECT 'test' AS part, o_orderstatus, CAST(quota AS BIGINT) AS n FROM o
        UNION ALL SELECT 'train', o_orderstatus, n - CAST(quota AS BIGINT) FROM o"""),
    "split_ordered": (split_ordered, f"WITH {PLACED} SELECT event_id, value, part FROM placed"),
    "fit_train_apply_both": (fit_train_apply_both, f"""WITH {PLACED}, f AS (SELECT event_type, count(*) /
            CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM placed WHERE part = 'train' GROUP BY 1)
        SELECT event_id, part, round(share, 6) AS event_type_freq FROM placed LEFT JOIN f USING (event_type)"""),
    "version_snapshot": (version_snapshot, "SELECT * FROM customer WHERE c_acctbal >= 0"),
    "version_list": (version_list, f"""SELECT CAST(0 AS INTEGER) AS version, 'load_data' AS op, {EVERYONE} AS "rows",
            CAST(5 AS INTEGER) AS "columns", true AS pinned
        UNION ALL SELECT 1, 'remove_outliers', {SOLVENT}, 5, false
        UNION ALL SELECT 2, 'create_feature', {SOLVENT}, 6, false"""),
    "version_rollback": (version_rollback, "SELECT * FROM customer"),
    "version_retention": (version_retention, f"""SELECT CAST(0 AS INTEGER) AS version, 'load_data' AS op,
            {EVERYONE} AS "rows", true AS pinned
        UNION ALL SELECT 2, 'create_feature', {SOLVENT}, false"""),
    "version_steps_between": (version_steps_between, """SELECT CAST(1 AS INTEGER) AS version,
            'v1: remove_outliers(column=c_acctbal)' AS step
        UNION ALL SELECT 2, 'v2: create_feature(name=c_half)'"""),
    "version_diff_shape": (lambda spark, d: versions.diff_shape(*before_after(spark, d)), f"""WITH {AFTER}
        SELECT 'rows' AS measure, (SELECT count(*) FROM gappy_events) AS "before", (SELECT count(*) FROM after) AS "after",
            (SELECT count(*) FROM after) - (SELECT count(*) FROM gappy_events) AS delta
        UNION ALL SELECT 'columns', 4, 4, 0"""),
    "version_diff_schema": (lambda spark, d: versions.diff_schema(*before_after(spark, d)), """
        SELECT 'event_type' AS "column", 'removed' AS change, 'string' AS type_before, CAST(NULL AS VARCHAR) AS type_after
        UNION ALL SELECT 'extra', 'added', NULL, 'int' UNION ALL SELECT 'user_id', 'retyped', 'bigint', 'int'"""),
    "version_diff_missing": (lambda spark, d: versions.diff_missing(*before_after(spark, d)), f"""WITH {AFTER},
        n AS (SELECT (SELECT count(*) FILTER (WHERE value IS NULL) FROM gappy_events) AS b,
            (SELECT count(*) FILTER (WHERE value IS NULL) FROM after) AS a)
        SELECT 'value' AS "column", b AS "before", a AS "after", a - b AS delta FROM n WHERE a <> b"""),
    "version_diff_stats": (lambda spark, d: versions.diff_stats(*before_after(spark, d)), stats_sql()),
    "version_rows_diff": (lambda spark, d: versions.diff_rows(
        c.table(spark, d, "customer"), c.table(spark, d, "customer").filter("c_acctbal >= 0")),
        "SELECT *, 'removed' AS change FROM customer WHERE c_acctbal < 0"),
    "fitted_store": (fitted_store, outliers_sql("iqr")),
    "preflight": (lambda spark, d: preflight(c.gappy_events(spark, d), CHECKS).drop("est_bytes"), CHECKED),
}
