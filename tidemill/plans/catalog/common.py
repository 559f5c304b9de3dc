"""Inputs shared by the registered queries: the given tables, with gaps and dirt derived from them.

Each derived input exists twice, as Spark expressions and as SQL text for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.functions.durable import stage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dates_as_text(df: DataFrame, *names: str) -> DataFrame:
    """Dates written alike by Spark and by the SQL of the check."""
    return df.withColumns({name: F.date_format(name, "yyyy-MM-dd HH:mm:ss") for name in names})


def date_text(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"


def gappy_events(spark, folder) -> DataFrame:
    """The value of error events is missing."""
    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", F.expr("CASE WHEN event_type <> 'error' THEN value END AS value"))


GAPPY_EVENTS = """gappy_events AS (
    SELECT event_id, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"""


def untyped_events(spark, folder) -> DataFrame:
    """The type of large events is missing."""
    return table(spark, folder, "events").select(
        "event_id", "value", F.expr("CASE WHEN value <= 100 THEN event_type END AS event_type"))


UNTYPED_EVENTS = """untyped_events AS (
    SELECT event_id, value, CASE WHEN value <= 100 THEN event_type END AS event_type FROM events)"""


def gappy_orders(spark, folder) -> DataFrame:
    """Open orders have no priority."""
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.expr(
        "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority"))


GAPPY_ORDERS = """gappy_orders AS (SELECT o_orderkey, o_orderstatus,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority FROM orders)"""


def text_events(spark, folder) -> DataFrame:
    """Numbers and dates as text, some of it unreadable."""
    return table(spark, folder, "events").select(
        "event_id",
        F.expr("CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(user_id AS STRING) END AS whole_text"),
        F.expr("CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS STRING) END AS value_text"),
        F.expr("CASE WHEN event_type = 'error' THEN 'bad' ELSE date_format(ts, 'yyyy-MM-dd') END AS day_text"),
        F.expr("CASE WHEN value > 20 THEN 'true' WHEN value > 10 THEN 'false' ELSE 'what' END AS flag_text"),
        F.expr("CAST(value > 20 AS BIGINT) AS flag_number"),
        F.expr("length(event_type) AS small_number"), "value")


TEXT_EVENTS = """text_events AS (SELECT event_id,
    CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(user_id AS VARCHAR) END AS whole_text,
    CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS VARCHAR) END AS value_text,
    CASE WHEN event_type = 'error' THEN 'bad' ELSE strftime(ts, '%Y-%m-%d') END AS day_text,
    CASE WHEN value > 20 THEN 'true' WHEN value > 10 THEN 'false' ELSE 'what' END AS flag_text,
    CAST(value > 20 AS BIGINT) AS flag_number, CAST(length(event_type) AS INTEGER) AS small_number, value
    FROM events)"""


def dirty_types(spark, folder) -> DataFrame:
    """Event types in mixed case, with accents and stray spaces."""
    return table(spark, folder, "events").select("event_id", F.expr(
        "CASE WHEN value > 60 THEN upper(event_type) WHEN value > 30 THEN replace(event_type, 'i', 'í') "
        "WHEN value > 15 THEN concat('  ', event_type, '   now ') ELSE event_type END AS event_type"))


DIRTY_TYPES = """dirty_types AS (SELECT event_id,
    CASE WHEN value > 60 THEN upper(event_type) WHEN value > 30 THEN replace(event_type, 'i', 'í')
    WHEN value > 15 THEN '  ' || event_type || '   now ' ELSE event_type END AS event_type FROM events)"""


def misspelt_segments(spark, folder) -> DataFrame:
    """Customers of one nation miss the third letter of their segment."""
    return table(spark, folder, "customer").select("c_custkey", F.expr(
        "CASE WHEN c_nationkey = 3 THEN concat(substr(c_mktsegment, 1, 2), substr(c_mktsegment, 4)) "
        "ELSE c_mktsegment END AS c_mktsegment"))


def shaped_events(spark, folder) -> DataFrame:
    """Columns of all shapes: skewed, bell-shaped, constant, nearly constant, gappy, unique."""
    bell = " + ".join(
        f"conv(substr(md5(concat(event_id, '_', {i})), 1, 6), 16, 10) / 16777216.0D" for i in range(12))
    shaped = table(spark, folder, "events").select(
        "event_id", "user_id", "event_type",
        F.expr("CASE WHEN event_type <> 'error' THEN value END AS value"),
        F.expr(f"{bell} AS bell"), F.lit(1).alias("always"),
        F.expr("CASE WHEN event_id = 0 THEN 1 ELSE 0 END AS almost"))
    return stage(shaped, "shaped")  # profiles pass over it several times


_BELL = " + ".join(
    f"CAST(CAST('0x' || substr(md5(event_id || '_{i}'), 1, 6) AS BIGINT) AS DOUBLE) / 16777216.0" for i in range(12))
SHAPED_EVENTS = f"""shaped_events AS (SELECT event_id, user_id, event_type,
    CASE WHEN event_type <> 'error' THEN value END AS value, {_BELL} AS bell,
    CAST(1 AS INTEGER) AS always, CAST(CASE WHEN event_id = 0 THEN 1 ELSE 0 END AS INTEGER) AS almost
    FROM events)"""
SHAPED_COLUMNS = ("event_id", "user_id", "event_type", "value", "bell", "always", "almost")
SHAPED_NUMBERS = ("event_id", "user_id", "value", "bell", "always", "almost")


def banded_orders(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
        F.expr("CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS price_band"),
        F.expr("CASE WHEN o_totalprice > 300000 AND o_orderstatus <> 'O' THEN 'rush' ELSE 'calm' END AS mood"))


BANDED_ORDERS = """banded_orders AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority,
    CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS price_band,
    CASE WHEN o_totalprice > 300000 AND o_orderstatus <> 'O' THEN 'rush' ELSE 'calm' END AS mood FROM orders)"""
BANDED_CATEGORIES = ("o_orderstatus", "o_orderpriority", "price_band", "mood")


def gappy_parts(spark, folder) -> DataFrame:
    """Sizes of one type and prices of one brand are missing."""
    return table(spark, folder, "part").select(
        "p_partkey", F.expr("CASE WHEN p_type <> 'ECONOMY' THEN p_size END AS p_size"),
        F.expr("CASE WHEN p_brand <> 'Brand#2' THEN p_retailprice END AS p_retailprice"))


GAPPY_PARTS = """gappy_parts AS (SELECT p_partkey,
    CASE WHEN p_type <> 'ECONOMY' THEN p_size END AS p_size,
    CASE WHEN p_brand <> 'Brand#2' THEN p_retailprice END AS p_retailprice FROM part)"""


_GAPS = """l_orderkey, CASE WHEN tax >= 0.025 THEN quantity END AS quantity,
    CASE WHEN quantity < 140 THEN discount END AS discount, CASE WHEN discount < 0.065 THEN tax END AS tax,
    CASE WHEN quantity < 60 OR quantity > 68 THEN price END AS price"""


def gappy_baskets(spark, folder) -> DataFrame:
    """Orders as the sums and means of their lines; each column misses cells of its own."""
    baskets = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.expr("CAST(sum(l_quantity) AS DOUBLE) AS quantity"), F.expr("round(avg(l_discount), 6) AS discount"),
        F.expr("round(avg(l_tax), 6) AS tax"), F.expr("round(CAST(sum(l_extendedprice) AS DOUBLE), 2) AS price"))
    return stage(baskets.selectExpr(*[x.strip() for x in _GAPS.replace("\n", " ").split(", ")]), "baskets")


GAPPY_BASKETS = f"""baskets AS (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS quantity,
        round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax,
        round(CAST(sum(l_extendedprice) AS DOUBLE), 2) AS price FROM lineitem GROUP BY l_orderkey),
    gappy_baskets AS (SELECT {_GAPS} FROM baskets)"""


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)
