"""Merging near-equal category values."""

from __future__ import annotations

from math import ceil, floor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import ColumnError, col, q, require_categorical
from tidemill.functions.durable import stage
from tidemill.functions.lookup import lookup_join
from tidemill.operators.ordered import global_index
from tidemill.operators.subsequence_join import subsequence_pairs
from tidemill.operators.valuecounts import column_counts, count_name

# Fixed value: default score
SCORE = 85
TOPIC_VOCABULARY, TOPIC_BUCKETS = 1 << 18, 1 << 20
METHODS = ("ratio", "partial_ratio", "token_sort_ratio")


def similarity(a: Column, b: Column, partial: bool) -> Column:
    """0-100: twice the longest common subsequence over the summed lengths; ``partial`` takes the best
    placement of the shorter text along the longer one."""
    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        def common(x, y):
            # one bit per character of x; cleared bits mark matched places
            places = {}
            for i, ch in enumerate(x):
                places[ch] = places.get(ch, 0) | 1 << i
            full = (1 << len(x)) - 1
            row = full
            for ch in y:
                met = row & places.get(ch, 0)
                row = ((row + met) | (row - met)) & full
            return len(x) - row.bit_count()

        def ratio(x, y):
            return 200.0 * common(x, y) / (len(x) + len(y)) if x or y else 100.0

        def best(x, y):
            if len(x) > len(y):
                x, y = y, x
            m, n = len(x), len(y)
            if m == 0:
                return 100.0 if n == 0 else 0.0
            windows = {y[max(0, end - m):min(n, end)] for end in range(1, n + m)}
            top = max(ratio(x, w) for w in windows)
            if m == n:
                top = max(top, max(ratio(y, x[max(0, e - n):min(m, e)]) for e in range(1, m + n)))
            return top

        use = best if partial else ratio
        return pd.Series([use(x, y) for x, y in zip(left, right)], dtype="float64")

    return score(a, b)


def shared_run(threshold: float) -> int:
    """Length of a run of characters every pair scoring at least ``threshold`` must share.

    Two texts of summed length L score t only if at most d = (1-t)L characters are unmatched; their
    common subsequence then falls into at most d+1 runs, one of which has this length.
    """
    t = threshold / 100.0
    shortest = 8
    for total in range(2, 400):
        d = floor((1 - t) * total + 1e-9)
        if d:
            shortest = min(shortest, ceil((total - d) / (2 * (d + 1)) - 1e-9))
    return max(1, shortest)


def _grams(text: Column, size: int) -> Column:
    count = F.char_length(text) - size + 1
    return F.when(count >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substr(text, i, F.lit(size))))
    ).otherwise(F.array(text))


def similar_pairs(values: DataFrame, threshold: float, method: str) -> DataFrame:
    """(better, worse) rank pairs of ``values`` (value, _rank) that score at least ``threshold``."""
    text = F.col("value")
    if method == "token_sort_ratio":
        text = F.array_join(F.array_sort(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")), " ")
    keyed = values.select("_rank", text.alias("text"))
    if method != "partial_ratio" and 0 < threshold <= 100:
        keyed = stage(keyed, "keyed")
        a, b = (keyed.select(F.col("_rank").alias(n), F.col("text").alias(x)) for n, x in (("better", "x"), ("worse", "y")))
        met = subsequence_pairs(keyed, threshold).join(a, "better").join(b, "worse")
        return met.filter(similarity(F.col("x"), F.col("y"), False) >= threshold).select("better", "worse")
    short = shared_run(threshold)
    grams = keyed.withColumn("gram", F.explode(_grams(F.col("text"), short)))
    met = (grams.alias("a").join(grams.alias("b"), "gram").filter(F.col("a._rank") < F.col("b._rank"))
           .select(F.col("a._rank").alias("better"), F.col("b._rank").alias("worse"),
                   F.col("a.text").alias("x"), F.col("b.text").alias("y")))
    if method == "partial_ratio" and short > 1:
        met = met.unionByName(_contained(keyed, short))
    return met.distinct().filter(similarity(F.col("x"), F.col("y"), method == "partial_ratio") >= threshold) \
        .select("better", "worse")


def _contained(keyed: DataFrame, short: int) -> DataFrame:
    """Pairs of which one text, of fewer than ``short`` characters, lies whole in the other.

    A text that short scores at all only if no character of it is unmatched, else ``shared_run`` would be as short. It
    meets every piece of its length of the other texts through an equality join.
    """
    length = F.char_length("text")
    pieces = keyed.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(short - 1)), lambda n: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: i + n - 1 <= length),
            lambda i: F.substr("text", i, n)))))))
    whole = keyed.filter((length > 0) & (length < short)).select(F.col("_rank").alias("r"), F.col("text").alias("t"))
    met = whole.join(pieces, (F.col("t") == F.col("gram")) & (F.col("r") != F.col("_rank")))
    first = F.col("r") < F.col("_rank")
    return met.select(F.least("r", "_rank").alias("better"), F.greatest("r", "_rank").alias("worse"),
                      F.when(first, F.col("t")).otherwise(F.col("text")).alias("x"),
                      F.when(first, F.col("text")).otherwise(F.col("t")).alias("y"))


def greedy_centres(ranks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ranks that become centres when values are visited best first and absorb their neighbours.

    A value is a centre once no better neighbour is undecided; its neighbours are then not centres.
    Every round decides at least the best undecided value of each group.
    """
    undecided, pairs = stage(ranks.select("_rank"), "undecided"), stage(pairs, "pairs")
    edges, centres = pairs, None
    while not undecided.isEmpty():
        new = stage(undecided.join(edges, F.col("_rank") == F.col("worse"), "left_anti"), "centres")
        centres = new if centres is None else centres.unionByName(new)
        absorbed = edges.join(new, F.col("better") == F.col("_rank")).select(F.col("worse").alias("_rank"))
        undecided = stage(undecided.join(new, "_rank", "left_anti")
                          .join(absorbed, "_rank", "left_anti"), "undecided")
        open_ends = undecided.select(F.col("_rank").alias("r"))
        edges = stage(edges.join(open_ends, F.col("better") == F.col("r"), "left_semi")
                      .join(open_ends, F.col("worse") == F.col("r"), "left_semi"), "edges")
    return centres


def cluster_map(df: DataFrame, column: str, threshold: float = SCORE, method: str = "ratio",
                max_values: int | None = None, override: dict[str, str] | None = None) -> DataFrame:
    """(value, n, canonical) for every distinct value. ``max_values`` refuses columns with more of them."""
    require_categorical(df, column)
    if method not in METHODS:
        raise ColumnError(f"unknown method {method!r}")
    counts = column_counts(df, column).select(col(column).cast("string").alias("value"), F.col(count_name(column)).alias("n"))
    counts = counts.withColumn("_order", -F.col("n"))
    ranked = stage(global_index(counts, ["_order", "value"], "_rank").drop("_order"), "ranked")
    if max_values is not None and ranked.count() > max_values:
        raise ColumnError(f"column {column!r} has more than {max_values} distinct values")
    pairs = stage(similar_pairs(ranked, threshold, method), "pairs")
    centres = greedy_centres(ranked, pairs)
    if centres is None:
        return ranked.select("value", "n", F.col("value").alias("canonical"))
    # an absorbed value belongs to its best neighbouring centre
    owner = pairs.join(centres, F.col("better") == F.col("_rank"), "left_semi") \
        .groupBy(F.col("worse").alias("_rank")).agg(F.min("better").alias("owner"))
    owner = owner.join(centres, "_rank", "left_anti")
    names = ranked.select(F.col("_rank").alias("owner"), F.col("value").alias("canonical"))
    joined = ranked.join(owner, "_rank", "left").withColumn(
        "owner", F.coalesce("owner", "_rank")).join(names, "owner")
    canonical = F.col("canonical")
    if override:
        given = F.create_map(*[F.lit(x) for pair in override.items() for x in pair])
        canonical = F.coalesce(F.try_element_at(given, F.col("value")), canonical)
    return joined.select("value", "n", canonical.alias("canonical"))


def apply_map(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace values through a (value, n, canonical) table."""
    table = stage(mapping.select(F.col("value").alias("_text"), F.col("n").alias("_n"), "canonical"), "map")
    keyed = df.withColumn("_text", col(column).cast("string"))
    return lookup_join(keyed, table, "_text", "_n").select(
        *[F.coalesce("canonical", "_text").alias(c) if c == column else col(c) for c in df.columns])


def cluster_values(df: DataFrame, column: str, threshold: float = SCORE, method: str = "ratio",
                   max_values: int | None = None, override: dict[str, str] | None = None) -> DataFrame:
    return apply_map(df, column, cluster_map(df, column, threshold, method, max_values, override))


def cluster_report(mapping: DataFrame) -> DataFrame:
    """Clusters of two or more values; a cluster has at most as many members as were compared."""
    return (mapping.groupBy("canonical").agg(
        F.array_sort(F.collect_list("value")).alias("members"), F.sum("n").alias("frequency"),
        F.count(F.lit(1)).alias("size")).filter("size > 1"))


def _word_grams(text: Column, low: int, high: int) -> Column:
    """Distinct character runs of ``low`` to ``high`` letters, the text padded by a space."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    sets = [_grams(padded, n) for n in range(low, high + 1)]
    return F.array_distinct(F.flatten(F.array(*sets)))


def spelling_map(df: DataFrame, column: str, overlap: float = 0.4, grams: tuple[int, int] = (2, 4)) -> DataFrame:
    """Group values whose character runs overlap, directly or in a chain; the most frequent one wins.

    Pairs meet on their rarest runs only: two sets with the wanted overlap must share one of the first
    size - ceil(overlap * size) + 1 runs in order of rarity. Nothing is lost by that.
    """
    require_categorical(df, column)
    counts = stage(column_counts(df, column).select(
        col(column).cast("string").alias("value"), F.col(count_name(column)).alias("n")), "values")
    sets = stage(counts.select("value", _word_grams(F.col("value"), *grams).alias("grams")), "sets")
    flat = sets.select("value", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    rarity = stage(flat.groupBy("gram").agg(F.count(F.lit(1)).alias("_seen"),
                                            F.count(F.lit(1)).alias("_n")), "rarity")
    placed = lookup_join(flat, rarity, "gram", "_n")
    prefix = placed.groupBy("value", "size").agg(  # one group holds the runs of one value
        F.array_sort(F.collect_list(F.struct("_seen", "gram"))).alias("runs"))
    keep = (F.col("size") - F.ceil(F.lit(overlap) * F.col("size")) + 1).cast("int")
    first = prefix.select("value", "size", F.explode(F.slice("runs", F.lit(1), keep)).alias("run")) \
        .select("value", "size", F.col("run.gram").alias("gram"))
    a, b = first.alias("a"), first.alias("b")
    near = a.join(b, "gram").filter(
        (F.col("a.value") < F.col("b.value"))
        & (F.least("a.size", "b.size") >= F.lit(overlap) * F.greatest("a.size", "b.size"))
    ).select(F.col("a.value").alias("x"), F.col("b.value").alias("y")).distinct()
    left, right = sets.select(F.col("value").alias("x"), F.col("grams").alias("gx")), \
        sets.select(F.col("value").alias("y"), F.col("grams").alias("gy"))
    joint = F.size(F.array_intersect("gx", "gy"))
    either = F.size("gx") + F.size("gy") - joint
    edges = near.join(left, "x").join(right, "y").filter(joint >= F.lit(overlap) * either).select("x", "y")
    groups = connected_groups(counts.select("value"), stage(edges, "edges"))
    named = counts.join(groups, "value")
    best = named.groupBy("group").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical"))
    return named.join(best, "group").select("value", "n", "canonical")


def connected_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value, group): the smallest value reachable over the edges, by halving the path each round."""
    both = stage(edges.select("x", "y").unionByName(
        edges.select(F.col("y").alias("x"), F.col("x").alias("y"))), "both")
    label = stage(nodes.select("value", F.col("value").alias("group")), "label")
    while True:
        seen = both.join(label, F.col("y") == F.col("value")).select(F.col("x").alias("value"), "group")
        low = label.unionByName(seen).groupBy("value").agg(F.min("group").alias("group"))
        # follow the label of the label
        up = label.select(F.col("value").alias("group"), F.col("group").alias("higher"))
        new = stage(low.join(up, "group", "left").select(
            "value", F.least("group", F.coalesce("higher", "group")).alias("group")), "label")
        moved = new.join(label.withColumnRenamed("group", "old"), "value") \
            .filter(F.col("group") != F.col("old")).limit(1)
        if moved.isEmpty():
            return new
        label = new


def dedupe_values(df: DataFrame, column: str, overlap: float = 0.4) -> DataFrame:
    return apply_map(df, column, spelling_map(df, column, overlap))


def gram_counts(values: DataFrame, vocabulary: int = TOPIC_VOCABULARY, buckets: int = TOPIC_BUCKETS) -> DataFrame:
    """``values`` with the counts of their runs ``_grams`` as vectors ``_counts``.

    Up to ``vocabulary`` distinct runs get a number each, in their order. More of them would not fit the driver, so they are
    hashed: no run is dropped, and of d runs a share of 1 - exp(-d / ``buckets``) shares its number with another.
    """
    from pyspark.ml.feature import CountVectorizerModel, HashingTF

    runs = stage(values.select(F.explode("_grams").alias("run")).filter("run IS NOT NULL").distinct(), "runs")
    if runs.count() > vocabulary:
        return HashingTF(numFeatures=buckets, inputCol="_grams", outputCol="_counts").transform(values)
    known = sorted(r["run"] for r in runs.collect()) or [""]
    return CountVectorizerModel.from_vocabulary(known, inputCol="_grams", outputCol="_counts").transform(values)


def topic_encode(df: DataFrame, column: str, n_components: int = 10, grams: tuple[int, int] = (2, 4),
                 seed: int = 42, iterations: int = 20, vocabulary: int = TOPIC_VOCABULARY,
                 buckets: int = TOPIC_BUCKETS) -> DataFrame:
    """Non-negative topic activations of each value's character runs, as ``{column}_gap_{i}``.

    Up to ``vocabulary`` distinct runs are told apart exactly; more are hashed to ``buckets`` numbers.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import vector_to_array

    require_categorical(df, column)
    values = stage(column_counts(df, column).select(
        col(column).cast("string").alias("_text"), F.col(count_name(column)).alias("_n"),
        _word_grams(col(column).cast("string"), *grams).alias("_grams")), "values")
    counted = gram_counts(values, vocabulary, buckets)
    model = LDA(k=max(2, n_components), maxIter=iterations, seed=seed, featuresCol="_counts",
                topicDistributionCol="_topics").fit(counted)
    names = [f"{column}_gap_{i}" for i in range(n_components)]
    topics = vector_to_array("_topics")
    table = stage(model.transform(counted).select(
        "_text", "_n", *[topics[i].alias(n) for i, n in enumerate(names)]), "topics")
    keyed = df.withColumn("_text", col(column).cast("string"))
    return lookup_join(keyed, table, "_text", "_n").select(
        *[col(c) for c in df.columns if c != column], *map(q, names))
