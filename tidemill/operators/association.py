"""Association between columns: one report row per column pair."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.functions.columns import categorical_columns, col, numeric_columns
from tidemill.functions.durable import side_by_side, stage
from tidemill.functions.lookup import lookup_join
from tidemill.functions.moments import ratio
from tidemill.functions.tails import f_upper_tail
from tidemill.operators.ordered import SLICE, global_index, in_slices, running_total
from tidemill.operators.valuecounts import column_counts, count_name

# Numbers of categories a column may have to be compared
MIN_CATEGORIES, MAX_CATEGORIES = 2, 20
PAIRS_PER_PASS = 250


def _pair_frame(df: DataFrame, cells: list[Column]) -> DataFrame:
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


def _shifted_sums(pairs: list[tuple[str, str]], x: dict[str, Column]) -> list[Column]:
    cells = []
    for a, b in pairs:
        both = x[a].isNotNull() & x[b].isNotNull()
        u, v = F.when(both, x[a]), F.when(both, x[b])
        cells.append(F.struct(
            F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.count_if(both).alias("n"),
            *[F.sum(e).alias(n) for n, e in (("su", u), ("sv", v), ("suu", u * u), ("svv", v * v),
                                            ("suv", u * v))]))
    return cells


def _r(frame: DataFrame) -> Column:
    n = F.col("n")
    cov = F.col("suv") - ratio(F.col("su") * F.col("sv"), n)
    vu = F.col("suu") - ratio(F.col("su") * F.col("su"), n)
    vv = F.col("svv") - ratio(F.col("sv") * F.col("sv"), n)
    # sums of squares this far below the raw ones are rounding noise of a constant column
    flat = (vu <= F.col("suu") * 1e-14) | (vv <= F.col("svv") * 1e-14)
    return F.when(~flat, F.greatest(F.lit(-1.0), F.least(
        F.lit(1.0), ratio(cov, F.sqrt(F.greatest(vu, F.lit(0.0))) * F.sqrt(F.greatest(vv, F.lit(0.0)))))))


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_1, feature_2, n, r) over the rows where both are known; unrounded."""
    pairs = list(combinations(columns, 2))
    means = df.agg(*[F.avg(col(c).cast("double")) for c in columns]).first()
    x = {c: col(c).cast("double") - F.lit(m) for c, m in zip(columns, means)}
    out = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        frame = _pair_frame(df, _shifted_sums(pairs[start:start + PAIRS_PER_PASS], x))
        part = frame.select("feature_1", "feature_2", "n", _r(frame).alias("r"))
        out = part if out is None else out.unionByName(part)
    return out


def _report(frame: DataFrame, method: str) -> DataFrame:
    return frame.select("feature_1", "feature_2", F.round("r", 4).alias("value"),
                        F.round(F.abs("r"), 4).alias("abs_value"),
                        F.col("n").alias("sample_size"), F.lit(method).alias("method"))


def correlation(df: DataFrame, method: str = "pearson", columns: list[str] | None = None) -> DataFrame:
    columns = columns or numeric_columns(df)
    made = {"pearson": pearson_pairs, "spearman": spearman_pairs, "kendall": kendall_pairs}
    return _report(made[method](df, columns), method)


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, _n, _rank): the mean 1-based position of each distinct value."""
    n = count_name(column)
    sliced = in_slices(column_counts(df, column), [column])
    before = running_total(sliced, [column], n, "_before_all")
    return before.select(col(column), F.col(n).alias("_n"),
                         (F.col("_before_all") + (F.col(n) + 1) / 2.0).alias("_rank"))


def _with_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    def ranks(i: int) -> DataFrame:
        return stage(average_ranks(df, columns[i]).withColumnRenamed("_rank", f"_rank{i}"), "ranks")

    for c, found in zip(columns, side_by_side(ranks, range(len(columns)))):
        df = lookup_join(df, found, c, "_n")
    return df


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of ranks. Pairs with gaps are ranked again over the rows where both are known."""
    data = df.select(*map(col, columns))
    gaps = data.agg(*[F.count_if(col(c).isNull()) for c in columns]).first()
    whole = [c for c, g in zip(columns, gaps) if g == 0]
    out = None

    def ranked(frame: DataFrame, names: list[str]) -> DataFrame:
        ranks = _with_ranks(frame, names).select(
            *[F.col(f"_rank{i}").alias(c) for i, c in enumerate(names)])
        return pearson_pairs(ranks, names)

    if len(whole) > 1:
        out = ranked(data.select(*map(col, whole)), whole)
    def with_gaps(pair: tuple[str, str]) -> DataFrame:
        a, b = pair
        return ranked(data.select(col(a), col(b)).filter(col(a).isNotNull() & col(b).isNotNull()), [a, b])

    gappy = [(a, b) for a, b in combinations(columns, 2) if not (a in whole and b in whole)]
    for part in side_by_side(with_gaps, gappy):
        out = part if out is None else out.unionByName(part)
    return out


def kendall_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    out = None
    for part in side_by_side(lambda pair: _kendall(df, *pair), combinations(columns, 2)):
        out = part if out is None else out.unionByName(part)
    return out


def _kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Tau-b by counting, for each bit of the rank of ``a``, the pairs that first differ in that bit.

    Two rows whose ranks share all higher bits and differ in this one are ordered by it, so the
    concordant pairs of a bit are running totals over ``b`` inside each prefix group. Groups are cut
    into ranges of ``b`` and only totals per range are carried over, so no pair is ever formed.
    """
    both = df.select(col(a).alias("x"), col(b).alias("y")).filter("x is not null and y is not null")
    cells = stage(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")), "cells")
    codes = stage(global_index(cells.groupBy("x").agg(F.sum("w").alias("_n")), ["x"], "_code"), "codes")
    bits = max(1, (max((codes.agg(F.max("_code")).first()[0] or 0), 1)).bit_length())
    coded = lookup_join(cells, codes, "x", "_n").select("x", "y", "w", "_code")
    sliced = in_slices(coded, ["y", "x"])
    # rows of one y can reach over two ranges; a range number per y keeps equal y together
    home = sliced.groupBy("y").agg(F.min(SLICE).alias("_home"), F.sum("w").alias("_n"))
    placed = lookup_join(sliced.select("y", "w", "_code"), stage(home, "home"), "y", "_n")

    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("_bit")
    exploded = placed.select("y", "_home", "w", "_code", level)
    one = F.expr("shiftright(_code, _bit) & 1")
    prefix = F.expr("shiftright(_code, _bit + 1)")
    grouped = exploded.groupBy("_bit", prefix.alias("_prefix"), "_home", "y").agg(
        F.sum(F.when(one == 0, F.col("w")).otherwise(0)).cast("double").alias("w0"),
        F.sum(F.when(one == 1, F.col("w")).otherwise(0)).cast("double").alias("w1"))
    inside = Window.partitionBy("_bit", "_prefix", "_home").orderBy("y").rowsBetween(
        Window.unboundedPreceding, -1)
    running = grouped.withColumn("below", F.coalesce(F.sum("w0").over(inside), F.lit(0.0)))
    ranges = running.groupBy("_bit", "_prefix", "_home").agg(
        F.sum(F.col("w1") * F.col("below")).alias("s"), F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    across = Window.partitionBy("_bit", "_prefix").orderBy("_home").rowsBetween(
        Window.unboundedPreceding, -1)  # at most one row per range
    concordant = ranges.withColumn("earlier", F.coalesce(F.sum("w0").over(across), F.lit(0.0))) \
        .agg(F.sum(F.col("s") + F.col("w1") * F.col("earlier"))).first()[0] or 0.0

    def tied(frame: DataFrame, w: str) -> float:
        n = F.col(w).cast("double")
        return frame.agg(F.sum(n * (n - 1) / 2), F.sum(n)).first()

    (tx, n), (ty, _), (txy, _) = (tied(f, w) for f, w in ((codes, "_n"), (
        cells.groupBy("y").agg(F.sum("w").alias("w")), "w"), (cells, "w")))
    n, tx, ty, txy = (v or 0.0 for v in (n, tx, ty, txy))
    pairs = n * (n - 1) / 2
    discordant = pairs - tx - ty + txy - concordant
    scale = ((pairs - tx) * (pairs - ty)) ** 0.5
    tau = (concordant - discordant) / scale if scale else None
    return df.sparkSession.createDataFrame(
        [(a, b, int(n), tau)], "feature_1 string, feature_2 string, n bigint, r double")


def comparable_categories(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Text and boolean columns with 2 to 19 distinct values."""
    columns = columns or categorical_columns(df)
    if not columns:
        return []
    row = df.agg(*[F.count_distinct(col(c)) for c in columns]).first()
    return [c for c, n in zip(columns, row) if MIN_CATEGORIES <= n < MAX_CATEGORIES]


def contingency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per column pair and pair of values, for all pairs in one pass.

    Each pair of compared columns has fewer than 20 x 20 cells.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
                               col(a).cast("string").alias("x"), col(b).cast("string").alias("y"))
                      for a, b in combinations(columns, 2)])
    return (df.select(F.explode(pairs).alias("p")).select("p.*")
            .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
            .groupBy("feature_1", "feature_2", "x", "y").agg(F.count(F.lit(1)).alias("n")))


def categorical_association(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Bias-corrected Cramer's V and mutual information of every pair of category columns."""
    columns = comparable_categories(df, columns)
    cells = contingency(df, columns)
    pair = ["feature_1", "feature_2"]

    def margin(*extra):
        return F.sum("n").over(Window.partitionBy(*pair, *extra))

    m = cells.withColumns({"nx": margin("x"), "ny": margin("y"), "total": margin()})
    expected = F.col("nx") * F.col("ny") / F.col("total")
    p = F.col("n") / F.col("total")
    gap = F.abs(F.col("n") - expected)
    summed = m.groupBy(*pair).agg(
        F.max("total").cast("double").alias("total"), F.count_distinct("x").alias("r"),
        F.count_distinct("y").alias("k"), F.min("nx").cast("double").alias("a"),
        F.min("ny").cast("double").alias("c"), F.max(gap).alias("d"),
        # cells without rows add their expected count; together all expected counts make the total
        (F.sum(F.pow(gap, F.lit(2)) / expected) + F.max("total") - F.sum(expected)).alias("chi2"),
        F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi"))
    n, r, k = F.col("total"), F.col("r").cast("double"), F.col("k").cast("double")
    # a 2 x 2 table has one gap in all four cells, corrected by up to one half
    corrected = F.pow(F.col("d") - F.least(F.lit(0.5), F.col("d")), F.lit(2)) * ratio(
        n * n * n, F.col("a") * (n - F.col("a")) * F.col("c") * (n - F.col("c")))
    chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2), corrected).otherwise(F.col("chi2"))
    phi = F.greatest(F.lit(0.0), chi2 / n - ratio((k - 1) * (r - 1), n - 1))
    narrow = F.least(k - ratio(F.pow(k - 1, F.lit(2)), n - 1), r - ratio(F.pow(r - 1, F.lit(2)), n - 1)) - 1
    v = F.when((F.col("r") < 2) | (F.col("k") < 2) | (narrow <= 0), F.lit(0.0)) \
        .otherwise(F.sqrt(F.try_divide(phi, narrow)))
    return summed.select(*pair, F.round(v, 4).alias("value"), F.round(F.abs(v), 4).alias("abs_value"),
                         n.cast("bigint").alias("sample_size"), F.lit("cramers_v").alias("method"),
                         F.round(F.abs("mi"), 4).alias("mutual_info"))


def numeric_by_category(df: DataFrame, numbers: list[str] | None = None,
                        categories: list[str] | None = None) -> DataFrame:
    """Correlation ratio, F statistic and p-value of every numeric x category pair."""
    numbers = numbers or numeric_columns(df)
    categories = comparable_categories(df, categories)
    means = dict(zip(numbers, df.agg(*[F.avg(col(c).cast("double")) for c in numbers]).first()))
    pairs = F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
                               (col(a).cast("double") - F.lit(means[a])).alias("x"),
                               col(b).cast("string").alias("g"))
                      for a, b in product(numbers, categories)])
    long = df.select(F.explode(pairs).alias("p")).select("p.*") \
        .filter(F.col("x").isNotNull() & F.col("g").isNotNull())
    # fewer than 20 groups per pair
    groups = long.groupBy("feature_1", "feature_2", "g").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    sums = groups.groupBy("feature_1", "feature_2").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum("s").alias("s"),
        F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    n, k = F.col("n"), F.col("k")
    grand = F.col("s") * F.col("s") / n
    between = F.greatest(F.col("b") - grand, F.lit(0.0))
    total = F.greatest(F.col("ss") - grand, F.lit(0.0))
    inner = F.greatest(F.col("ss") - F.col("b"), F.lit(0.0))
    eta = F.when((k <= 1) | (total <= 0), F.lit(0.0)).otherwise(F.sqrt(ratio(between, total)))
    f = F.when(k > 1, F.try_divide(F.try_divide(between, k - 1), F.try_divide(inner, n - k)))
    f = F.when((k > 1) & (inner <= 0) & (between > 0), F.lit(float("inf"))).otherwise(f)
    shown = sums.select("feature_1", "feature_2", eta.alias("eta"), n.cast("bigint").alias("sample_size"),
                        f.alias("f"), (k - 1).alias("d1"), (n - k).alias("d2"))
    p = f_upper_tail(F.col("f"), F.col("d1"), F.col("d2"))
    return shown.select("feature_1", "feature_2", F.round("eta", 4).alias("value"),
                        F.round("eta", 4).alias("abs_value"), "sample_size",
                        F.lit("correlation_ratio").alias("method"),
                        F.round(F.coalesce("f", F.lit(0.0)), 4).alias("anova_f_stat"),
                        F.round(F.coalesce(p, F.lit(1.0)), 6).alias("anova_p_val"))
