"""Checks before an operation runs: would it be allowed, why, and how large would the table become."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import col, is_numeric
from tidemill.operators.dedupe import duplicate_count
from tidemill.operators.encode import HASH_BUCKETS, METHODS, ONE_HOT_LIMIT, ONE_HOT_WARN
from tidemill.operators.outlier_models import contamination

READ_ONLY = ("describe", "correlation", "quality_issues", "run_report", "list_versions", "diff_versions",
             "save", "export_run_log", "list_sources", "table_metadata")
OUTLIER_SHARE = 0.03


def table_bytes(df: DataFrame, rows: int) -> int:
    """Rows times the mean width of a row in bytes."""
    fixed = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1,
             "date": 4, "timestamp": 8, "timestamp_ntz": 8}
    widths = [F.lit(float(fixed[f.dataType.simpleString()])) if f.dataType.simpleString() in fixed
              else F.coalesce(F.avg(F.octet_length(col(f.name).cast("string"))), F.lit(0.0))
              for f in df.schema.fields]
    total = F.lit(0.0)
    for w in widths:
        total = total + w
    return int((df.agg(total).first()[0] or 0) * rows)


def preflight(df: DataFrame, checks: list[tuple[str, dict]]) -> DataFrame:
    """(op, allowed, reason, est_bytes) per check. Counts needed by several checks come from one pass."""
    wanted = {p.get("column") for op, p in checks if p.get("column") in df.columns}
    nulls = sorted(wanted)
    distinct = sorted({p["column"] for op, p in checks
                       if op == "encode" and p.get("column") in df.columns})
    row = df.agg(F.count(F.lit(1)), *[F.count_if(col(c).isNull()) for c in nulls],
                 *[F.count_distinct(col(c)) for c in distinct]).first()
    rows = row[0]
    missing = dict(zip(nulls, row[1:1 + len(nulls)]))
    cardinality = dict(zip(distinct, row[1 + len(nulls):]))
    size = table_bytes(df, rows)
    per_column = size / max(len(df.columns), 1)

    out = []
    for op, params in checks:
        allowed, reason, estimate = _check(df, op, params, rows, missing, cardinality, size, per_column)
        out.append((op, allowed, reason, int(estimate)))
    return df.sparkSession.createDataFrame(
        out, "op string, allowed boolean, reason string, est_bytes bigint")


def _check(df, op, p, rows, missing, cardinality, size, per_column):
    column, refuse = p.get("column"), lambda why: (False, why, size)
    on_column = ("remove_outliers", "impute", "normalize_text", "harmonize_values", "cluster_values",
                 "ml_prepare", "encode", "extract_datetime", "extract_text")
    if op in on_column:
        if not column:
            return refuse("no column specified")
        if column not in df.columns:
            return refuse(f"column '{column}' not found")
        if op == "remove_outliers" and not is_numeric(df, column):
            return refuse(f"column '{column}' is not numeric")
        if op in ("normalize_text", "harmonize_values", "cluster_values", "encode") and is_numeric(df, column):
            return refuse(f"column '{column}' is numeric")

    if op in READ_ONLY:
        return True, f"{op} changes nothing", size
    if op in ("drop_columns", "remove_features"):
        names = p.get("columns") or []
        if not names:
            return refuse("no columns specified")
        absent = [c for c in names if c not in df.columns]
        if absent:
            return refuse(f"columns not found: {absent}")
        if len(set(names)) >= len(df.columns):
            return refuse("no column would remain")
        return True, f"drops {len(names)} column(s)", size - per_column * len(names)
    if op == "remove_outliers":
        try:
            if p.get("method") in ("isolation_forest", "lof"):
                contamination(p.get("threshold"))
        except ValueError as error:
            return refuse(str(error))
        return True, f"filters '{column}' using {p.get('method')}", size * (1 - OUTLIER_SHARE)
    if op == "impute":
        gaps = missing[column]
        if not gaps:
            return True, f"no missing values in '{column}', nothing to do", size
        kept = 1 - gaps / max(rows, 1) if p.get("strategy") == "drop_rows" else 1
        return True, f"{gaps} rows of '{column}' using {p.get('strategy')}", size * kept
    if op == "create_feature":
        if not p.get("name"):
            return refuse("no feature name specified")
        if not p.get("expression"):
            return refuse("no expression specified")
        if p["name"] in df.columns:
            return refuse(f"feature '{p['name']}' already exists")
        return True, f"adds '{p['name']}'", size + per_column
    if op in ("extract_datetime", "extract_text", "extract_math"):
        made = len(p.get("ops") or [])
        return (True, f"adds {made} column(s)", size + per_column * made) if made \
            else refuse("no operations specified")
    if op == "reduce":
        numbers = [c for c in df.columns if is_numeric(df, c) and c != p.get("target")]
        k = p.get("n_components", 0)
        if not 0 < k <= len(numbers):
            return refuse(f"n_components must be between 1 and {len(numbers)}")
        return True, f"reduces {len(numbers)} columns to {k}", 8.0 * rows * k
    if op == "train_test_split":
        share = p.get("test_size", 0.2)
        if not 0 < share < 1:
            return refuse("test_size must be between 0 and 1")
        return True, f"splits off {share} of the rows", size
    if op == "drop_duplicate_rows":
        absent = [c for c in p.get("subset") or [] if c not in df.columns]
        if absent:
            return refuse(f"columns not found: {absent}")
        extra = duplicate_count(df, p.get("subset")).first()["duplicates"]
        return True, f"drops {extra} duplicate rows", size * (1 - extra / max(rows, 1))
    if op == "cast":
        casts = p.get("columns") or {}
        if not casts:
            return refuse("no columns specified")
        absent = [c for c in casts if c not in df.columns]
        return refuse(f"columns not found: {absent}") if absent else \
            (True, f"casts {len(casts)} column(s)", size)
    if op in ("normalize_text", "harmonize_values", "cluster_values"):
        return True, f"rewrites text in '{column}'", size
    if op == "ml_prepare":
        made = p.get("n_components", 10) if p.get("method") == "gap_encoder" else 0
        return True, f"prepares '{column}' using {p.get('method', 'deduplicate')}", size + per_column * made
    if op == "rollback":
        return (True, f"returns to version {p['version']} as a new version", size) \
            if p.get("version") is not None else refuse("no version specified")
    if op == "encode":
        return _check_encode(df, p, cardinality[column], size, per_column)
    return refuse(f"unknown operation '{op}'")


def _check_encode(df, p, cardinality, size, per_column):
    method, target = p.get("method"), p.get("target")
    if method not in METHODS:
        return False, f"unknown method '{method}'", size
    if method == "ordinal" and not p.get("ordinal_mapping"):
        return False, "ordinal needs ordinal_mapping", size
    if method in ("target", "leave_one_out"):
        if not target:
            return False, f"{method} needs a target column", size
        if target not in df.columns:
            return False, f"target '{target}' not found", size
    made = {"one_hot": cardinality, "binary": max(1, ceil(log2(cardinality + 1))),
            "hashing": p.get("n_components") or HASH_BUCKETS}.get(method, 1)
    estimate = size + per_column * made
    if method == "one_hot" and cardinality > ONE_HOT_LIMIT:
        return False, f"{cardinality} columns exceed the limit of {ONE_HOT_LIMIT}", estimate
    note = ""
    if method == "one_hot" and cardinality > ONE_HOT_WARN:
        note = f", more than the recommended {ONE_HOT_WARN}"
    if method == "target":
        note = "; leaks the target if fitted before a split"
    return True, f"{made} new column(s) from {cardinality} categories{note}", estimate
