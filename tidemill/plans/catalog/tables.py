"""Sources, sinks, projections and duplicate rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.columns import ColumnError
from tidemill.functions.durable import fresh_path
from tidemill.functions.user import create_rows, register_scalar, register_table
from tidemill.operators import dedupe, project
from tidemill.operators.runlog import RunLog, run_report
from tidemill.plans.catalog import common as c
from tidemill.sources import tables as io


def written(df, fmt, **read):
    path = io.write_table(df, fresh_path(df.sparkSession, fmt), fmt)
    return io.read_table(df.sparkSession, path, fmt, **read)


def scan_csv(spark, d):
    df = c.table(spark, d, "customer")
    return written(df, "csv", schema=df.schema)


def scan_json(spark, d):
    df = c.table(spark, d, "customer")
    return written(df, "json", schema=df.schema, lines=True).select(*df.columns)


def scan_parquet(spark, d):
    return c.dates_as_text(io.read_table(spark, f"{d}/lineitem.parquet"), "l_shipdate")


def sink_csv(spark, d):
    back = written(c.table(spark, d, "part"), "csv")  # types are inferred here
    return project.cast_columns(back, {"p_partkey": "int64", "p_size": "int32", "p_retailprice": "float64"})


def sink_json(spark, d):
    back = written(c.table(spark, d, "part"), "json", lines=True)
    return project.cast_columns(back, {"p_size": "int32"})


def sink_parquet(spark, d):
    return written(c.table(spark, d, "part"), "parquet")


def sink_guard(spark, d):
    """Writing a table over its own files is refused, and the table is still whole afterwards."""
    path = io.write_table(c.table(spark, d, "supplier"), fresh_path(spark, "guard"), "parquet")
    df = io.read_table(spark, path, "parquet")
    try:
        io.write_table(df, path, "parquet")
        refused = False
    except ColumnError:
        refused = True
    return df.agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


def _steps(spark, d):
    """Three real steps on the events table."""
    events = c.table(spark, d, "events").select("event_type", "value")
    log = RunLog(spark).add("load_data", dataset_name="events")
    extra = dedupe.duplicate_count(events).first()["duplicates"]
    log.add("drop_duplicate_rows", rows_removed=extra)
    gaps = c.gappy_events(spark, d).agg(F.count_if(F.col("value").isNull())).first()[0]
    return log.add("handle_missing_values", column="value", strategy="median", rows_affected=gaps)


_EXTRA = "(SELECT (SELECT count(*) FROM events) - count(*) FROM (SELECT DISTINCT event_type, value FROM events))"
_GAPS = "(SELECT count(*) FROM events WHERE event_type = 'error')"


def export_run_log(spark, d):
    back = _steps(spark, d).export(fresh_path(spark, "runlog"))
    return back.select("step", "op", F.coalesce(
        F.try_element_at("params", F.lit("rows_removed")),
        F.try_element_at("params", F.lit("rows_affected"))).alias("rows"))


def metadata_sql():
    types = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double"}
    return f"WITH {c.GAPPY_EVENTS} " + c.union_all(
        f"SELECT '{n}' AS \"column\", '{t}' AS dtype, count(*) AS total_rows, "
        f"round(avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_fraction FROM gappy_events"
        for n, t in types.items())


def cast(column, dtype, shown=None):
    return lambda spark, d: project.cast_columns(
        c.text_events(spark, d).select("event_id", column), {column: dtype})


def cast_sql(column, expression):
    return f"WITH {c.TEXT_EVENTS} SELECT event_id, {expression} AS {column} FROM text_events"


REPORTED = {"whole_text": "int64", "value_text": "int32", "flag_text": "bool", "value": "int16",
            "day_text": "datetime"}


def date_part(part):
    return lambda spark, d: project.extract_datetime(
        c.table(spark, d, "events").select("event_id", "ts"), "ts", [part]).drop("ts")


def date_sql(part, expression):
    return f"SELECT event_id, CAST({expression} AS INTEGER) AS ts_{part} FROM events"


def math(op):
    return lambda spark, d: project.extract_math(
        c.table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], [op])


FEATURES = {"ship_month": "year(l_shipdate) * 100 + month(l_shipdate)",
            "gross": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
            "bulk": "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END",
            "flags": "concat(l_returnflag, l_linestatus)"}


def create_feature(spark, d):
    df = c.table(spark, d, "lineitem")
    for name, expression in FEATURES.items():
        df = project.create_feature(df, name, expression)
    return c.dates_as_text(df, "l_shipdate").withColumn("gross", F.round("gross", 6))


def create_feature_functions(spark, d):
    """A value and rows from functions of the user's own, over whole documents."""
    def count_vowels(texts):
        import pyarrow.compute as pc
        return pc.cast(pc.count_substring_regex(texts, "[aeiou]"), "int64")

    class Sentences:
        def eval(self, text):
            for place, sentence in enumerate(text.split(".") if text is not None else ()):
                yield place, len(sentence)

    register_scalar(spark, "count_vowels", count_vowels, "bigint", replace=True)
    register_table(spark, "sentences", Sentences, "place int, sentence_length int", replace=True)
    df = project.create_feature(c.table(spark, d, "documents").select("doc_id", "text"), "vowels", "count_vowels(text)")
    return create_rows(df, "sentences", ["text"]).drop("text")


def duplicated(spark, d):
    return c.table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")


IDENTITIES = ["o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice"]
QUERIES = {
    "scan_csv": (scan_csv, "SELECT * FROM customer"),
    "scan_json": (scan_json, "SELECT * FROM customer"),
    "scan_parquet": (scan_parquet, f"SELECT * REPLACE ({c.date_text('l_shipdate')} AS l_shipdate) FROM lineitem"),
    "list_sources": (lambda spark, d: io.list_sources(spark, d), None),
    "table_metadata": (lambda spark, d: io.table_metadata(c.gappy_events(spark, d)), metadata_sql()),
    "sink_csv": (sink_csv, "SELECT * FROM part"),
    "sink_json": (sink_json, "SELECT * FROM part"),
    "sink_parquet": (sink_parquet, "SELECT * FROM part"),
    "sink_guard": (sink_guard, "SELECT true AS refused, count(*) AS n FROM supplier"),
    "export_run_log": (export_run_log, f"""
        SELECT CAST(1 AS INTEGER) AS step, 'load_data' AS op, CAST(NULL AS VARCHAR) AS "rows"
        UNION ALL SELECT 2, 'drop_duplicate_rows', CAST({_EXTRA} AS VARCHAR)
        UNION ALL SELECT 3, 'handle_missing_values', CAST({_GAPS} AS VARCHAR)"""),
    "run_report": (lambda spark, d: run_report(_steps(spark, d).table()), f"""
        SELECT CAST(1 AS INTEGER) AS step, 'load_data' AS op,
            '1. load data with dataset name events' AS description
        UNION ALL SELECT 2, 'drop_duplicate_rows', '2. drop duplicate rows with rows removed ' || {_EXTRA}
        UNION ALL SELECT 3, 'handle_missing_values', '3. handle missing values with column value; rows affected '
            || {_GAPS} || '; strategy median'"""),
    "drop_columns": (lambda spark, d: project.drop_columns(
        c.table(spark, d, "lineitem"), ["l_shipdate", "l_tax"]),
        "SELECT * EXCLUDE (l_shipdate, l_tax) FROM lineitem"),
    "drop_columns_impact": (lambda spark, d: project.drop_columns_impact(c.table(spark, d, "orders"), IDENTITIES), f"""
        WITH kept AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus),
        whole AS (SELECT count(*) AS n FROM orders GROUP BY {', '.join(IDENTITIES)}, o_custkey, o_orderstatus),
        made AS (SELECT CAST((SELECT coalesce(sum(n), 0) FROM whole WHERE n > 1) AS BIGINT) AS duplicates_before,
            CAST((SELECT coalesce(sum(n), 0) FROM kept WHERE n > 1) AS BIGINT) AS duplicates_after)
        """ + c.union_all(f"""SELECT '{name}' AS "column", count(DISTINCT {name}) AS unique_count, count(*) AS total_rows,
            count(DISTINCT {name}) > 0.95 * count(*) AS is_identity,
            any_value(duplicates_before) AS duplicates_before, any_value(duplicates_after) AS duplicates_after
        FROM orders, made""" for name in IDENTITIES)),
    "cast_int64": (cast("whole_text", "int64"), cast_sql("whole_text", "TRY_CAST(whole_text AS BIGINT)")),
    "cast_int32": (cast("whole_text", "int32"), cast_sql("whole_text", "TRY_CAST(whole_text AS INTEGER)")),
    "cast_int16": (cast("small_number", "int16"), cast_sql("small_number", "CAST(small_number AS SMALLINT)")),
    "cast_int8": (cast("flag_number", "int8"), cast_sql("flag_number", "CAST(flag_number AS TINYINT)")),
    "cast_int_revert": (cast("value", "int64"), cast_sql("value", "value")),
    "cast_float64": (cast("value_text", "float64"), cast_sql("value_text", "TRY_CAST(value_text AS DOUBLE)")),
    "cast_float32": (cast("value_text", "float32"), cast_sql("value_text", "TRY_CAST(value_text AS FLOAT)")),
    "cast_string": (cast("flag_number", "string"), cast_sql("flag_number", "CAST(flag_number AS VARCHAR)")),
    "cast_bool": (lambda spark, d: project.cast_columns(
        c.text_events(spark, d).select("event_id", "flag_text", "flag_number"),
        {"flag_text": "bool", "flag_number": "bool"}),
        f"WITH {c.TEXT_EVENTS} SELECT event_id, TRY_CAST(flag_text AS BOOLEAN) AS flag_text, "
        "flag_number <> 0 AS flag_number FROM text_events"),
    "cast_timestamp": (lambda spark, d: project.cast_columns(
        c.text_events(spark, d).select("event_id", "day_text"), {"day_text": "datetime"})
        .select("event_id", F.date_format("day_text", "yyyy-MM-dd HH:mm:ss").alias("day")),
        f"WITH {c.TEXT_EVENTS} SELECT event_id, strftime(TRY_CAST(day_text AS TIMESTAMP), "
        "'%Y-%m-%d %H:%M:%S') AS day FROM text_events"),
    "cast_category": (cast("flag_text", "category"), cast_sql("flag_text", "flag_text")),
    "cast_report": (lambda spark, d: project.cast_report(c.text_events(spark, d), REPORTED).select(
        "column", "old_type", "new_type", "turned_null", F.col("error").isNotNull().alias("failed")), f"""
        WITH {c.TEXT_EVENTS}, made AS (SELECT
            count(*) FILTER (WHERE TRY_CAST(whole_text AS BIGINT) IS NULL) AS whole_null,
            count(*) FILTER (WHERE value <> floor(value)) > 0 AS fractional,
            count(*) FILTER (WHERE TRY_CAST(value_text AS DOUBLE) <> floor(TRY_CAST(value_text AS DOUBLE))) > 0 AS text_fractional,
            count(*) FILTER (WHERE TRY_CAST(flag_text AS BOOLEAN) IS NULL) AS flag_null,
            count(*) FILTER (WHERE TRY_CAST(day_text AS TIMESTAMP) IS NULL) AS day_null FROM text_events)
        SELECT 'whole_text' AS "column", 'string' AS old_type, 'bigint' AS new_type, whole_null AS turned_null,
            false AS failed FROM made
        UNION ALL SELECT 'value_text', 'string', 'string', 0, text_fractional FROM made
        UNION ALL SELECT 'flag_text', 'string', 'boolean', flag_null, false FROM made
        UNION ALL SELECT 'value', 'double', 'double', 0, fractional FROM made
        UNION ALL SELECT 'day_text', 'string', 'timestamp', day_null, false FROM made"""),
    "create_feature": (create_feature, f"""SELECT * REPLACE ({c.date_text('l_shipdate')} AS l_shipdate),
        CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS ship_month,
        round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross,
        CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS INTEGER) AS bulk,
        l_returnflag || l_linestatus AS flags FROM lineitem"""),
    "create_feature_functions": (create_feature_functions, """WITH s AS (SELECT doc_id, unnest(string_split(text, '.')) AS sentence,
            generate_subscripts(string_split(text, '.'), 1) - 1 AS place FROM documents)
        SELECT doc_id, len(regexp_extract_all(text, '[aeiou]')) AS vowels, CAST(place AS INTEGER) AS place,
            CAST(length(sentence) AS INTEGER) AS sentence_length FROM documents LEFT JOIN s USING (doc_id)"""),
    "dt_year": (date_part("year"), date_sql("year", "year(ts)")),
    "dt_month": (date_part("month"), date_sql("month", "month(ts)")),
    "dt_day": (date_part("day"), date_sql("day", "day(ts)")),
    "dt_dayofweek": (date_part("dayofweek"), date_sql("dayofweek", "isodow(ts) - 1")),
    "dt_hour": (date_part("hour"), date_sql("hour", "hour(ts)")),
    "dt_is_weekend": (date_part("is_weekend"), date_sql("is_weekend", "CASE WHEN isodow(ts) > 5 THEN 1 ELSE 0 END")),
    "extract_text_length": (lambda spark, d: project.extract_text(
        c.table(spark, d, "documents").select("doc_id", "text"), "text", ["length"]).drop("text"),
        "SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length FROM documents"),
    "extract_text_word_count": (lambda spark, d: project.extract_text(
        c.table(spark, d, "documents").select("doc_id", "text"), "text", ["word_count"]).drop("text"),
        "SELECT doc_id, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS INTEGER) AS text_word_count "
        "FROM documents"),
    "math_log": (lambda spark, d: math("log")(spark, d).withColumn(
        "c_acctbal_log", F.round("c_acctbal_log", 6)),
        "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN round(ln(CASE WHEN c_acctbal > 0 THEN c_acctbal "
        "END), 6) END AS c_acctbal_log FROM customer"),
    "math_sqrt": (lambda spark, d: math("sqrt")(spark, d).withColumn(
        "c_acctbal_sqrt", F.round("c_acctbal_sqrt", 6)),
        "SELECT c_custkey, c_acctbal, round(sqrt(CASE WHEN c_acctbal >= 0 THEN c_acctbal END), 6) "
        "AS c_acctbal_sqrt FROM customer"),
    "math_square": (lambda spark, d: math("square")(spark, d).withColumn(
        "c_acctbal_square", F.round("c_acctbal_square", 4)),
        "SELECT c_custkey, c_acctbal, round(c_acctbal * c_acctbal, 4) AS c_acctbal_square FROM customer"),
    "math_interaction": (lambda spark, d: project.extract_math(
        c.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"),
        ["p_size", "p_retailprice"], ["interaction"]).withColumn(
        "p_size_x_p_retailprice", F.round("p_size_x_p_retailprice", 4)),
        "SELECT p_partkey, p_size, p_retailprice, round(CAST(p_size AS DOUBLE) * p_retailprice, 4) "
        "AS p_size_x_p_retailprice FROM part"),
    "dedupe_first": (lambda spark, d: dedupe.drop_duplicate_rows(
        c.table(spark, d, "documents"), ["text"], "first", ["doc_id"]),
        "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r "
        "FROM documents) WHERE r = 1"),
    "dedupe_last": (lambda spark, d: dedupe.drop_duplicate_rows(
        c.table(spark, d, "documents"), ["text"], "last", ["doc_id"]),
        "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS r "
        "FROM documents) WHERE r = 1"),
    "dedupe_none": (lambda spark, d: dedupe.drop_duplicate_rows(duplicated(spark, d), None, "none"),
        "SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders GROUP BY ALL HAVING count(*) = 1"),
    "dedupe_subset": (lambda spark, d: c.dates_as_text(dedupe.drop_duplicate_rows(
        c.table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "first", ["o_orderkey"]), "o_orderdate"),
        f"SELECT * EXCLUDE (r) REPLACE ({c.date_text('o_orderdate')} AS o_orderdate) FROM (SELECT *, row_number() OVER "
        "(PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1"),
    "dedupe_all_columns": (lambda spark, d: dedupe.drop_duplicate_rows(
        duplicated(spark, d), order_by=["o_custkey"]),
        "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders"),
}
