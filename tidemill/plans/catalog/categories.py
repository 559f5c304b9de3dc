"""Encoders and category text."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.functions.durable import fresh_path
from tidemill.operators import catnorm, cluster
from tidemill.operators.encode import encode_report, fit_encoder, unmapped_categories
from tidemill.operators.fitted import FittedStore
from tidemill.operators.split import ordered_split
from tidemill.plans.catalog import common as c

TYPES = ("click", "error", "purchase", "signup", "view")
LEVELS = {"view": 1, "click": 2, "signup": 3, "purchase": 4}  # error is left out on purpose


def encode(method, digits=None, **kw):
    def run(spark, d):
        df = c.untyped_events(spark, d)
        out = fit_encoder(df, "event_type", method, **kw).fit_transform(df)
        made = [x for x in out.columns if x not in df.columns]
        return out.withColumns({n: F.round(col(n), digits) for n in made}) if digits else out
    return run


def fitted_store_encoder(spark, d):
    """An encoder with a table of its own, saved by one store and applied by another one opened on the same folder."""
    df, path = c.untyped_events(spark, d), fresh_path(spark, "fitted")
    name = FittedStore(spark, path).save("events", fit_encoder(df, "event_type", "target", target="value"))
    out = FittedStore(spark, path).get(name).transform(df)
    return out.withColumn("event_type_target", F.round("event_type_target", 6))


def from_untyped(select):
    return f"WITH {c.UNTYPED_EVENTS} {select}"


def one_hot_sql():
    made = ", ".join(f"CASE WHEN event_type IS NOT NULL THEN CASE WHEN event_type = '{t}' THEN CAST(1 AS DOUBLE) "
                     f"ELSE CAST(0 AS DOUBLE) END END AS event_type_{t}" for t in TYPES)
    return from_untyped(f"SELECT event_id, value, {made} FROM untyped_events")


def on_map(mapping, payload):
    return f"WITH {c.UNTYPED_EVENTS}, m AS ({mapping}) SELECT e.event_id, e.value, {payload} FROM untyped_events e " \
        "LEFT JOIN m USING (event_type)"


FIRST_SEEN = """SELECT event_type, row_number() OVER (ORDER BY min(event_id)) AS code FROM untyped_events
    WHERE event_type IS NOT NULL GROUP BY event_type"""
# five categories need three binary digits
BINARY = ", ".join(f"CAST((code >> {2 - i}) & 1 AS INTEGER) AS event_type_bin_{i}" for i in range(3))

WORD = "CAST('0x' || substr(md5(event_type), {}, 8) AS BIGINT)"


def hashing_sql(buckets=8):
    value = "0"
    for start in (1, 9, 17, 25):
        value = f"(({value}) * 4294967296 + {WORD.format(start)}) % {buckets}"
    made = ", ".join(f"CAST(h = {i} AS INTEGER) AS event_type_hash_{i}" for i in range(buckets))
    return from_untyped(f"SELECT event_id, value, {made} FROM (SELECT *, {value} AS h FROM untyped_events)")


def encode_risk(spark, d):
    df = c.untyped_events(spark, d)
    return encode_report(df, fit_encoder(df, "event_type", "one_hot"))


SYNONYMS = {"interaction": ["click", "view"], "account": ["signup", "sign up"], "sale": ["purchase"]}


def harmonize_values(spark, d):
    return catnorm.harmonize_values(c.dirty_types(spark, d).withColumn(
        "event_type", F.regexp_replace(F.trim("event_type"), " +now$", "")), "event_type", SYNONYMS)


HARMONIZED = f"""WITH {c.DIRTY_TYPES}, t AS (SELECT event_id,
        regexp_replace(trim(event_type), ' +now$', '') AS event_type FROM dirty_types)
    SELECT event_id, CASE WHEN lower(event_type) IN ('click', 'view') THEN 'interaction'
        WHEN lower(event_type) = 'signup' THEN 'account' WHEN lower(event_type) = 'purchase' THEN 'sale'
        ELSE event_type END AS event_type FROM t"""


def harmonize_documents(spark, d):
    """Every word of the benchmark texts is a synonym of its first two letters: a map of thousands of words."""
    words = c.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit("[a-z0-9_]{3,}"), F.lit(0))).alias("word")).distinct()
    synonyms = {r["head"]: r["words"] for r in words.groupBy(F.concat(F.lit("<"), F.substring("word", 1, 2), F.lit(">")).alias("head"))
                .agg(F.collect_list("word").alias("words")).collect()}
    return catnorm.harmonize_values(c.table(spark, d, "documents").select("doc_id", "text"), "text", synonyms)


HARMONIZED_TEXTS = """WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')) AS word FROM benchmark),
    t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS parts FROM documents),
    u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM t),
    m AS (SELECT doc_id, string_agg(CASE WHEN word IS NULL THEN part ELSE '<' || substr(word, 1, 2) || '>' END, '' ORDER BY k) AS made
        FROM u LEFT JOIN b ON lower(part) = word GROUP BY doc_id)
    SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(made, '') END AS text FROM documents d LEFT JOIN m USING (doc_id)"""
CLEAN = "lower(trim(regexp_replace(strip_accents(event_type), '\\s+', ' ', 'g')))"

# the letters that have no accent to strip, one after another; their replacements hold none of them
PLAIN_TEXT = reduce(lambda text, pair: "replace({}, '{}', '{}')".format(text, *(p.replace("'", "''") for p in pair)),
                    catnorm.PLAIN_LETTERS.items(), "text")


def normalize_report(spark, d):
    df = c.dirty_types(spark, d)
    after = catnorm.normalize_text(df.withColumn("clean", F.col("event_type")), "clean")
    counts = after.groupBy(F.col("event_type").alias("before"), F.col("clean").alias("after")).agg(
        F.count(F.lit(1)).alias("n"))
    return catnorm.change_summary(counts).drop("sample_changes")


def misspelt_words(spark, d):
    """Segments with a fixed second word, its place depending on the nation."""
    return c.table(spark, d, "customer").select("c_custkey", F.expr(
        "CASE WHEN c_nationkey = 3 THEN concat('team ', c_mktsegment) ELSE concat(c_mktsegment, ' team') END "
        "AS c_mktsegment"))


def embedded_segments(spark, d):
    return c.table(spark, d, "customer").select("c_custkey", F.expr(
        "CASE WHEN c_nationkey = 3 THEN concat('the ', c_mktsegment, ' dept') ELSE c_mktsegment END AS c_mktsegment"))


def shortened_segments(spark, d):
    """Customers of one nation have the first three letters of their segment only."""
    return c.table(spark, d, "customer").select("c_custkey", F.expr(
        "CASE WHEN c_nationkey = 3 THEN substr(c_mktsegment, 1, 3) ELSE c_mktsegment END AS c_mktsegment"))


def encode_loo_test_part(spark, d):
    """Leave-one-out on both parts of a split: new rows get the whole mean, whatever their own target."""
    s = ordered_split(c.untyped_events(spark, d), 0.2, ["event_id"])
    both = s.apply(fit_encoder(s.train, "event_type", "leave_one_out", target="value"))
    out = both.train.withColumn("part", F.lit("train")).unionByName(both.test.withColumn("part", F.lit("test")))
    return out.withColumn("event_type_loo", F.round("event_type_loo", 6))


LOO_PARTS = f"""WITH {c.UNTYPED_EVENTS}, placed AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY event_id) <=
        count(*) OVER () - ceil(count(*) OVER () * 0.2) THEN 'train' ELSE 'test' END AS part FROM untyped_events),
    m AS (SELECT event_type, sum(value) AS s, count(*) AS n FROM placed WHERE part = 'train' AND event_type IS NOT NULL GROUP BY 1),
    p AS (SELECT avg(value) AS a FROM placed WHERE part = 'train')
    SELECT event_id, value, part, round(CASE WHEN e.event_type IS NULL THEN NULL WHEN part = 'test' THEN coalesce(s / n, a)
        WHEN n > 1 THEN (s - value) / (n - 1) ELSE a END, 6) AS event_type_loo
    FROM placed e LEFT JOIN m USING (event_type), p"""
STRICT = {"one_hot": {}, "ordinal": {"ordinal_mapping": {"view": 1, "click": 2}}, "label": {}, "frequency": {},
          "binary": {"order_by": ["event_id"]}, "target": {"target": "value"}, "leave_one_out": {"target": "value"}}


def encode_unknown_error(spark, d):
    """Encoders fitted on part of the categories: do they refuse the others, and do they keep the types of the lax ones?"""
    df = c.untyped_events(spark, d)
    some, rows = df.filter("event_type IN ('view', 'click')"), []
    for method, kw in STRICT.items():
        strict, lax = (fit_encoder(some, "event_type", method, unknown=u, **kw) for u in ("error", "ignore"))
        made = strict.transform(df)
        try:
            made.write.format("noop").mode("overwrite").save()
            refused = False
        except PySparkException as error:
            refused = "unknown category" in str(error)
        known = strict.transform(some).agg(F.count(F.lit(1))).first()[0]
        rows.append((method, refused, made.dtypes == lax.transform(df).dtypes, known))
    return spark.createDataFrame(rows, "method string, refused boolean, same_types boolean, known_rows bigint")


def cluster_report(spark, d):
    found = cluster.cluster_report(cluster.cluster_map(c.misspelt_segments(spark, d), "c_mktsegment"))
    return found.select("canonical", F.array_join("members", "|").alias("members"), "frequency", "size")


SEGMENTS = "SELECT c_custkey, c_mktsegment FROM customer"
REPORTED = """WITH s AS (SELECT c_mktsegment AS canonical, CASE WHEN c_nationkey = 3 THEN
        substr(c_mktsegment, 1, 2) || substr(c_mktsegment, 4) ELSE c_mktsegment END AS value FROM customer)
    SELECT canonical, string_agg(DISTINCT value, '|' ORDER BY value) AS members, count(*) AS frequency,
        count(DISTINCT value) AS size FROM s GROUP BY canonical HAVING count(DISTINCT value) > 1"""

QUERIES = {
    "encode_loo_test_part": (encode_loo_test_part, LOO_PARTS),
    "encode_unknown_error": (encode_unknown_error, f"""WITH {c.UNTYPED_EVENTS} SELECT unnest({list(STRICT)}) AS method,
        true AS refused, true AS same_types, n AS known_rows
        FROM (SELECT count(*) AS n FROM untyped_events WHERE event_type IN ('view', 'click'))"""),
    "cluster_partial_short": (lambda spark, d: cluster.cluster_values(
        shortened_segments(spark, d), "c_mktsegment", 95, "partial_ratio"), SEGMENTS),
    "encode_one_hot": (encode("one_hot"), one_hot_sql()),
    "encode_label": (encode("label"), on_map(
        "SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type "
        "FROM untyped_events WHERE event_type IS NOT NULL)", "code AS event_type_encoded")),
    "encode_ordinal": (encode("ordinal", ordinal_mapping=LEVELS), from_untyped(
        "SELECT event_id, value, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 "
        "WHEN 'purchase' THEN 4 END AS INTEGER) AS event_type_ordinal FROM untyped_events")),
    "encode_ordinal_unmapped": (lambda spark, d: unmapped_categories(
        c.untyped_events(spark, d), "event_type", LEVELS), from_untyped(
        "SELECT event_type AS category, count(*) AS n FROM untyped_events WHERE event_type NOT IN "
        "('view', 'click', 'signup', 'purchase') GROUP BY 1")),
    "encode_frequency": (encode("frequency", 6), on_map(
        "SELECT event_type, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM untyped_events "
        "WHERE event_type IS NOT NULL GROUP BY 1", "round(share, 6) AS event_type_freq")),
    "encode_target": (encode("target", 6, target="value"), on_map(
        "SELECT event_type, w * m + (1 - w) * (SELECT avg(value) FROM untyped_events) AS v FROM (SELECT event_type, "
        "avg(value) AS m, 1 / (1 + exp(-(count(*) - 20) / 1.0)) AS w FROM untyped_events "
        "WHERE event_type IS NOT NULL GROUP BY 1)", "round(v, 6) AS event_type_target")),
    "encode_binary": (encode("binary", order_by=["event_id"]), on_map(FIRST_SEEN, BINARY)),
    "encode_hashing": (encode("hashing"), hashing_sql()),
    "encode_leave_one_out": (encode("leave_one_out", 6, target="value"), on_map(
        "SELECT event_type, sum(value) AS s, count(*) AS n FROM untyped_events WHERE event_type IS NOT NULL GROUP BY 1",
        "round(CASE WHEN n > 1 THEN (s - e.value) / (n - 1) WHEN n = 1 THEN (SELECT avg(value) FROM untyped_events) "
        "END, 6) AS event_type_loo")),
    "encode_new_category": (encode("label", unknown="new_category"), from_untyped("""
        , f AS (SELECT event_id, value, coalesce(event_type, '__unknown__') AS event_type FROM untyped_events),
        m AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code
            FROM (SELECT DISTINCT event_type FROM f))
        SELECT event_id, value, code AS event_type_encoded FROM f JOIN m USING (event_type)""")),
    "encode_risk": (encode_risk, from_untyped("""SELECT 'event_type' AS "column", 'one_hot' AS method,
        count(DISTINCT event_type) AS new_columns, count(DISTINCT event_type) AS cardinality, count(*) AS total_rows,
        CASE WHEN count(DISTINCT event_type) <= 10 THEN 'low' WHEN count(DISTINCT event_type) <= 50 THEN 'medium'
            ELSE 'high' END AS memory_risk, false AS leakage_risk,
        CASE WHEN count(DISTINCT event_type) < 0.01 * count(*) THEN 'low'
            WHEN count(DISTINCT event_type) < 0.1 * count(*) THEN 'medium' ELSE 'high' END AS overfit_risk,
        count(DISTINCT event_type) - 1 AS feature_space_delta FROM untyped_events""")),
    "normalize_text": (lambda spark, d: catnorm.normalize_text(c.dirty_types(spark, d), "event_type"),
        f"WITH {c.DIRTY_TYPES} SELECT event_id, {CLEAN} AS event_type FROM dirty_types"),
    "normalize_documents": (lambda spark, d: catnorm.normalize_text(
        c.table(spark, d, "documents").select("doc_id", "text"), "text"),
        f"SELECT doc_id, {CLEAN.replace('event_type', PLAIN_TEXT)} AS text FROM documents"),
    "normalize_turns": (lambda spark, d: catnorm.normalize_text(
        c.table(spark, d, "conversations").select("conv_id", "turn", "text"), "text",
        ("fix_unicode", "strip_whitespace", "lowercase")),
        "SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text FROM conversations"),
    "normalize_report": (normalize_report, f"""WITH {c.DIRTY_TYPES}, n AS (SELECT event_type AS b, {CLEAN} AS a
            FROM dirty_types) SELECT count(*) AS rows_affected, count(*) FILTER (WHERE a <> b) AS values_changed,
        count(DISTINCT b) AS unique_before, count(DISTINCT a) AS unique_after FROM n"""),
    "harmonize_values": (harmonize_values, HARMONIZED),
    "harmonize_documents": (harmonize_documents, HARMONIZED_TEXTS),
    "cluster_ratio": (lambda spark, d: cluster.cluster_values(
        c.misspelt_segments(spark, d), "c_mktsegment", method="ratio"), SEGMENTS),
    "cluster_partial_ratio": (lambda spark, d: cluster.cluster_values(
        embedded_segments(spark, d), "c_mktsegment", method="partial_ratio"), SEGMENTS),
    "cluster_token_sort": (lambda spark, d: cluster.cluster_values(
        misspelt_words(spark, d), "c_mktsegment", method="token_sort_ratio"),
        "SELECT c_custkey, c_mktsegment || ' team' AS c_mktsegment FROM customer"),
    "cluster_report": (cluster_report, REPORTED),
    "dedupe_values_ml": (lambda spark, d: cluster.dedupe_values(
        c.misspelt_segments(spark, d), "c_mktsegment"), SEGMENTS),
    "gap_encode": (lambda spark, d: cluster.topic_encode(
        c.misspelt_segments(spark, d), "c_mktsegment", 10), None),
}

QUERIES["fitted_store_encoder"] = (fitted_store_encoder, QUERIES["encode_target"][1])
