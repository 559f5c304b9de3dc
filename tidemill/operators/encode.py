"""Categorical encoders: a fitted value map, joined back to any table with the same column."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, log2

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemill.functions.columns import ColumnError, col, q, require, require_categorical
from tidemill.functions.durable import stage
from tidemill.functions.lookup import lookup_join
from tidemill.functions.moments import ratio
from tidemill.operators.ordered import global_index
from tidemill.operators.valuecounts import column_counts, count_name

# Limits, defaults and the marker for missing categories
ONE_HOT_WARN, ONE_HOT_LIMIT = 20, 100
HASH_BUCKETS = 8
SMOOTHING, SMOOTHING_MIDPOINT = 1.0, 20
MEMORY_STEPS = (10, 50)
OVERFIT_STEPS = (0.01, 0.1)
UNKNOWN = "__unknown__"

METHODS = ("one_hot", "label", "ordinal", "frequency", "target", "binary", "hashing", "leave_one_out")


@dataclass
class Encoder:
    """``mapping`` holds one row per category; ``method`` and ``facts`` say how its payload becomes the new columns.

    All fields are plain values or tables, so that an encoder can be stored.
    """

    column: str
    method: str
    new_columns: list[str]
    mapping: DataFrame | None = None
    drop_original: bool = True
    unknown: str = "ignore"
    facts: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Encode a table that the encoder was not fitted on."""
        return self._encoded(df, fitted=False)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Encode the table the encoder was fitted on: leave-one-out leaves each row's own target out."""
        return self._encoded(df, fitted=True)

    def known(self) -> Column:
        """Whether the row's category was there when the encoder was fitted."""
        if self.mapping is not None:
            return F.coalesce("_known", F.lit(False))
        if self.method in ("one_hot", "ordinal"):
            return col(self.column).cast("string").isin([str(v) for v in self.facts["categories"]])
        return F.lit(True)  # hashing has a place for every text

    def _helpers(self) -> dict[str, Column]:
        """Worked out once per row for all new columns."""
        return {"_bucket": _md5_bucket(col(self.column), len(self.new_columns))} if self.method == "hashing" else {}

    def _columns(self, df: DataFrame, fitted: bool) -> list[Column]:
        """The new columns, over the payload of ``mapping`` and the helpers."""
        value, new, facts = col(self.column), self.new_columns, self.facts
        if self.method == "one_hot":
            return [F.when(value == F.lit(v), 1.0).otherwise(0.0) for v in facts["categories"]]
        if self.method == "ordinal":
            pairs = [F.lit(x) for pair in facts["mapping"].items() for x in pair]
            return [F.try_element_at(F.create_map(*pairs), value.cast("string"))]
        if self.method == "binary":
            return [F.shiftright(F.col("_code"), len(new) - 1 - i).bitwiseAND(F.lit(1)).cast("int") for i in range(len(new))]
        if self.method == "hashing":
            return [(F.col("_bucket") == i).cast("int") for i in range(len(new))]
        if self.method == "target":
            return [F.coalesce(F.col("_value"), F.lit(facts["prior"]))]
        if self.method == "leave_one_out":
            if not fitted:
                return [F.coalesce(ratio(F.col("_sum"), F.col("_seen")), F.lit(facts["prior"]))]
            require(df, facts["target"])
            own = _number(df, facts["target"])
            left_out = F.coalesce(ratio(F.col("_sum") - own, F.col("_seen") - 1), F.lit(facts["prior"]))
            return [left_out * (1 + F.randn(facts["seed"]) * facts["sigma"]) if facts["sigma"] else left_out]
        return [F.col("_share" if self.method == "frequency" else "_code")]

    def _encoded(self, df: DataFrame, fitted: bool) -> DataFrame:
        require(df, self.column)
        clash = [c for c in self.new_columns if c in df.columns]
        if clash:
            raise ColumnError(f"columns already exist: {clash}")
        prepared = df.withColumn(self.column, _filled(df, self.column, self.unknown))
        joined = prepared
        if self.mapping is not None:
            joined = lookup_join(prepared, self.mapping.withColumn("_known", F.lit(True)), self.column, "_n")
        joined = joined.withColumns(self._helpers())
        given = col(self.column).isNotNull()
        made = {n: F.when(given, c) for n, c in zip(self.new_columns, self._columns(df, fitted))}
        if self.unknown == "error":
            refused = F.raise_error(F.lit("unknown category"))  # without a type of its own: the column keeps its type
            made = {n: F.when(given & ~self.known(), refused).otherwise(c) for n, c in made.items()}
        kept = [c for c in df.columns if not (self.drop_original and c == self.column)]
        return joined.select(*map(col, kept), *[c.alias(n) for n, c in made.items()])

    def risk(self, rows: int, cardinality: int) -> dict:
        return encode_risk(self.method, len(self.new_columns), cardinality, rows)


def _filled(df: DataFrame, column: str, unknown: str) -> Column:
    c = col(column)
    return F.coalesce(c.cast("string"), F.lit(UNKNOWN)) if unknown == "new_category" else c


def encode_risk(method: str, new_columns: int, cardinality: int, rows: int) -> dict:
    share = cardinality / max(rows, 1)
    level = "low" if share < OVERFIT_STEPS[0] else "medium" if share < OVERFIT_STEPS[1] else "high"
    memory = ("low" if new_columns <= MEMORY_STEPS[0]
              else "medium" if new_columns <= MEMORY_STEPS[1] else "high")
    return {"memory_risk": memory, "leakage_risk": method == "target", "overfit_risk": level}


def _category_order(df: DataFrame, column: str) -> DataFrame:
    return stage(global_index(column_counts(df, column), [column], "_code")
                 .select(q(column), F.col(count_name(column)).alias("_n"), "_code"), "codes")


def fit_encoder(df: DataFrame, column: str, method: str, unknown: str = "ignore",
                drop_original: bool = True, prefix: str | None = None,
                ordinal_mapping: dict[str, float] | None = None, n_components: int | None = None,
                target: str | None = None, order_by: list[str] | None = None,
                smoothing: float = SMOOTHING, sigma: float = 0.0, seed: int = 42) -> Encoder:
    """Learn an encoder. ``unknown`` is ignore, error or new_category (missing becomes a category)."""
    require_categorical(df, column)
    if method not in METHODS:
        raise ColumnError(f"unknown method {method!r}")
    if unknown not in ("ignore", "error", "new_category"):
        raise ColumnError(f"unknown must be ignore, error or new_category, not {unknown!r}")
    name = prefix or column
    source = df.withColumn(column, _filled(df, column, unknown))
    common = dict(column=column, method=method, drop_original=drop_original, unknown=unknown)

    if method == "one_hot":
        found = source.filter(col(column).isNotNull()).select(col(column).alias("v")).distinct() \
            .limit(ONE_HOT_LIMIT + 1).collect()
        if len(found) > ONE_HOT_LIMIT:
            raise ColumnError(f"more than {ONE_HOT_LIMIT} categories: one-hot is refused")
        values = sorted(r["v"] for r in found)
        return Encoder(new_columns=[f"{name}_{v}" for v in values], facts={"categories": values, "sparse_recommended": len(values) > ONE_HOT_WARN}, **common)

    if method == "label":
        return Encoder(new_columns=[f"{name}_encoded"], mapping=_category_order(source, column), **common)

    if method == "ordinal":
        if not ordinal_mapping:
            raise ColumnError("ordinal needs ordinal_mapping")
        return Encoder(new_columns=[f"{name}_ordinal"], facts={"mapping": ordinal_mapping, "categories": list(ordinal_mapping)}, **common)

    if method == "frequency":
        counts = stage(column_counts(source, column), "counts")
        total = counts.agg(F.sum(count_name(column))).first()[0] or 0
        n = F.col(count_name(column))
        mapping = counts.select(q(column), n.alias("_n"), ratio(n, F.lit(total)).alias("_share"))
        return Encoder(new_columns=[f"{name}_freq"], mapping=mapping, **common)

    if method == "binary":
        if not order_by:
            raise ColumnError("binary numbers categories by first appearance: order_by is needed")
        require(df, *order_by)
        first = source.filter(col(column).isNotNull()).groupBy(q(column)).agg(
            F.min(F.struct(*map(col, order_by))).alias("_first"), F.count(F.lit(1)).alias("_n"))
        mapping = stage(global_index(first, ["_first"], "_code", start=1)
                        .select(q(column), "_n", "_code"), "codes")
        digits = max(1, ceil(log2(mapping.count() + 1)))
        return Encoder(new_columns=[f"{name}_bin_{i}" for i in range(digits)], mapping=mapping, **common)

    if method == "hashing":
        buckets = n_components or HASH_BUCKETS
        return Encoder(new_columns=[f"{name}_hash_{i}" for i in range(buckets)], facts={
                "n_buckets": buckets, "collision_risk": _collision_risk(df, column, buckets)}, **common)

    # target and leave_one_out
    if target is None:
        raise ColumnError(f"{method} needs a target column")
    require(df, target)
    if not isinstance(df.schema[target].dataType, (T.NumericType, T.BooleanType)):
        raise ColumnError(f"target {target!r} must be numeric or boolean")
    y = _number(df, target)
    prior = source.agg(F.avg(y)).first()[0]
    stats = source.filter(col(column).isNotNull()).groupBy(q(column)).agg(
        F.count(F.lit(1)).alias("_n"), F.count(y).alias("_seen"), F.sum(y).alias("_sum"))
    if method == "target":
        weight = 1.0 / (1.0 + F.exp(-(F.col("_seen") - SMOOTHING_MIDPOINT) / F.lit(float(smoothing))))
        mapping = stage(stats.select(q(column), "_n", (
            F.lit(prior) * (1 - weight) + ratio(F.col("_sum"), F.col("_seen")) * weight)
            .alias("_value")), "target")
        return Encoder(new_columns=[f"{name}_target"], mapping=mapping,
                       facts={"prior": prior, "smoothing": smoothing}, **common)

    return Encoder(new_columns=[f"{name}_loo"], mapping=stage(stats, "loo"),
                   facts={"prior": prior, "target": target, "sigma": sigma, "seed": seed}, **common)


def _number(df: DataFrame, name: str) -> Column:
    c = col(name)
    return (c.cast("int") if isinstance(df.schema[name].dataType, T.BooleanType) else c).cast("double")


def _collision_risk(df: DataFrame, column: str, buckets: int) -> float:
    """The chance that a category shares its bucket with another, were all buckets equally likely."""
    n = df.agg(F.count_distinct(col(column))).first()[0] or 0
    return 1.0 - (1.0 - 1.0 / buckets) ** max(n - 1, 0)


def _md5_bucket(c: Column, buckets: int) -> Column:
    """The 128-bit md5 modulo ``buckets``, taken eight hex digits at a time."""
    digest = F.md5(c.cast("string"))
    value = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        value = F.pmod(value * F.lit(1 << 32) + word, F.lit(buckets).cast("bigint"))
    return value


def encode_report(df: DataFrame, encoder: Encoder) -> DataFrame:
    """Columns made, cardinality and risk levels of a fitted encoder on a table."""
    rows, cardinality = df.agg(F.count(F.lit(1)), F.count_distinct(col(encoder.column))).first()
    risk = encoder.risk(rows, cardinality)
    return df.sparkSession.createDataFrame(
        [(encoder.column, encoder.method, len(encoder.new_columns), cardinality, rows,
          risk["memory_risk"], risk["leakage_risk"], risk["overfit_risk"],
          len(encoder.new_columns) - int(encoder.drop_original))],
        "column string, method string, new_columns bigint, cardinality bigint, total_rows bigint, "
        "memory_risk string, leakage_risk boolean, overfit_risk string, feature_space_delta bigint")


def unmapped_categories(df: DataFrame, column: str, ordinal_mapping: dict[str, float]) -> DataFrame:
    return (column_counts(df, column)
            .filter(~col(column).cast("string").isin(list(ordinal_mapping)))
            .select(col(column).alias("category"), F.col(count_name(column)).alias("n")))
