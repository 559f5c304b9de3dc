"""Shards cut from a Hilbert curve through several metadata columns.

Each column is quantised into bins of near equal row counts, a row's bins give its place on the curve,
rows are sorted by that place and the sorted run is cut into shards. Neighbours on the curve are neighbours
in every column, so each shard spans a small box of the metadata space, and the bounds of a shard's columns
(`shard_bounds`, or the statistics of its Parquet files) let a filter on any of them skip most shards.

Only ids, metadata, sizes and checksums are sorted. Positions in the sorted run come from row counts of the
range partitions, so no task sees more than its own range; ranges are cut by the whole sort key, so rows
at one place of the curve spread over several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.functions.columns import col, free_name
from tidemill.functions.durable import stage
from tidemill.llm.columns import whole

IN_PARTITION = (1 << 33) - 1
DIMENSIONS = ("lang", "source", "size", "doc_id")


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For state * 2**dims + cell: the next state, and the cell's number along the curve.

    A state is the corner where the curve enters a cube and the direction it leaves in, as entry * dims + direction.
    """
    cells = 1 << dims
    gray = [i ^ (i >> 1) for i in range(cells)]
    along = {g: i for i, g in enumerate(gray)}
    turn = lambda v, by: ((v << (by % dims)) | (v >> (dims - by % dims))) & (cells - 1)
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing one bits
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, cells)]
    leaves = [0] + [ones(i - 1 if i % 2 == 0 else i) % dims for i in range(1, cells)]
    following, number = [], []
    for state in range(cells * dims):
        corner, way = divmod(state, dims)
        for cell in range(cells):
            at = along[turn(cell ^ corner, dims - (way + 1) % dims)]
            number.append(at)
            following.append((corner ^ turn(entry[at], way + 1)) * dims + (way + leaves[at] + 1) % dims)
    return following, number


def curve_index(bins: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell given by its bin, 0 to 2**bits - 1, in each dimension."""
    dims = len(bins)
    following, number = (F.lit(t) for t in curve_tables(dims))

    def step(acc: Column, level: Column) -> Column:
        cell = sum((F.call_function("getbit", b.cast("bigint"), level).cast("int") * (1 << k) for k, b in enumerate(bins)), F.lit(0))
        at = acc["state"] * (1 << dims) + cell + 1
        return F.struct((acc["index"] * (1 << dims) + F.element_at(number, at)).alias("index"),
                        F.element_at(following, at).alias("state"))

    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda acc: acc["index"])


def in_order(df: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """``df`` staged, with ``position`` from 0 in the order of the keys, and ``before``: the weight of all earlier rows."""
    part, seat = F.shiftright("_at", 33), F.col("_at").bitwiseAND(IN_PARTITION)
    rows = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .withColumn("_at", F.monotonically_increasing_id()), "in-order")
    value = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    parts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"), F.sum(value).alias("_weight"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range partition
    parts = parts.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_rows", "_weight")])
    out = rows.withColumn("_part", part).join(F.broadcast(parts), "_part") \
        .withColumn("position", F.col("_rows") + seat)
    if weight:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_weight") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    else:
        out = out.withColumn("before", F.col("position"))
    return out.drop("_at", "_part", "_rows", "_weight")


def bin_starts(df: DataFrame, name: str, bits: int) -> list[tuple[int, object]]:
    """(bin, its smallest value) of the bins in use: at most 2**bits, from the counts of all values.

    A value's bin is where the middle of its rows lies among all rows, so a column of few values keeps them far apart.
    """
    counts = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    ordered = in_order(counts, name, weight="n")
    total = ordered.agg(F.sum("n")).first()[0] or 1
    middle = (F.col("before") * 2 + F.col("n")) / (2 * total)
    bins = ordered.groupBy(F.floor(middle * (1 << bits)).cast("int").alias("bin")).agg(F.min(name).alias("low"))
    return sorted((r["bin"], r["low"]) for r in bins.collect())


def curve_places(narrow: DataFrame, dimensions: list[str], bits: int) -> DataFrame:
    """``narrow`` with ``bins`` (an array) and ``curve``. A null falls in bin 0 of its column."""
    def reached(value: Column):
        return lambda start: start <= value

    bins = []
    for name in dimensions:
        starts = bin_starts(narrow, name, bits)
        if not starts:
            bins.append(F.lit(0))
            continue
        lows, numbers = (F.array(*map(F.lit, part)) for part in ([low for _, low in starts], [k for k, _ in starts]))
        bins.append(F.when(F.col(name).isNull(), F.lit(0)).otherwise(
            F.element_at(numbers, F.greatest(F.lit(1), F.size(F.filter(lows, reached(F.col(name))))))))
    placed = narrow.withColumn("bins", F.array(*bins))
    return placed.withColumn("curve", curve_index([placed["bins"][k] for k in range(len(dimensions))], bits))


def hilbert_shards(docs: DataFrame, shards: int = 24, law: str = "rows", dimensions: tuple[str, ...] = DIMENSIONS,
                   bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, mark, size, crc32, the dimensions, curve, shard and slot.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 8, and may itself be a dimension. ``law``: with
    ``rows`` the shards' row counts are at most one apart; with ``bytes`` the curve is cut at equal shares of
    the total size. A slot is a row's position in its shard, from 0 without gaps. Rows at one place of the curve follow
    each other by size, checksum and id; repeated rows are interchangeable. A null in a dimension counts as
    its smallest value. With fewer rows than shards some shards are empty, with no rows the result is.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be rows or bytes, not {law!r}")
    text = F.encode(whole(docs, text_col), "UTF-8")
    own = {"size": "size", id_col: "id"}
    wide = {f"dim{k}": d for k, d in enumerate(dimensions) if d not in own}
    narrow = stage(docs.select(
        col(id_col).alias("id"), F.xxhash64(whole(docs, text_col)).alias("mark"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("crc32"),
        *[col(d).alias(k) for k, d in wide.items()]), "shard-keys")
    names = [own.get(d, f"dim{k}") for k, d in enumerate(dimensions)]
    placed = curve_places(narrow, names, bits)
    rows = in_order(placed, "curve", "size", "crc32", "id", weight="size" if law == "bytes" else None)
    n_rows, total = narrow.agg(F.count("*"), F.sum("size")).first()
    if law == "rows":
        # whole numbers: the first position of shard s is the ceiling of s * rows / shards
        rows = rows.withColumn("shard", F.expr(f"CAST((position * {shards}) DIV {max(n_rows, 1)} AS INT)"))
        first = F.expr(f"(shard * CAST({n_rows} AS BIGINT) + {shards - 1}) DIV {shards}")
        out = rows.withColumn("slot", F.col("position") - first)
    else:
        rows = rows.withColumn("shard", F.expr(
            f"CAST(least({shards - 1}, ((2 * before + size) * {shards}) DIV {2 * max(total or 0, 1)}) AS INT)"))
        firsts = rows.groupBy("shard").agg(F.min("position").alias("first"))
        out = rows.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("position") - F.col("first"))
    return out.select("id", "mark", "size", "crc32", *[F.col(n).alias(f"d_{d}") for n, d in zip(names, dimensions)],
                      "curve", "shard", F.col("slot").cast("bigint").alias("slot"))


def shard_bounds(placed: DataFrame) -> DataFrame:
    """Smallest and largest value of each dimension for each shard: what a filter needs to skip shards."""
    dims = [c for c in placed.columns if c.startswith("d_")]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[
        f(c).alias(f"{n}_{c[2:]}") for c in dims for n, f in (("min", F.min), ("max", F.max))])


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """``docs`` below ``path`` as folders of Parquet, one for each shard, each in the order of its slots.

    Gives the name of the shard column, which is prefixed where ``docs`` has a column ``shard``. Rows that repeat an id and
    text go to the shard of one of them.
    """
    shard, slot, mark, own = (free_name(docs, n) for n in ("shard", "_slot", "_mark", "_own"))
    place = placed.select(F.col("id").alias(own), F.col("mark").alias(mark + "_r"), F.col("shard").alias(shard), F.col("slot").alias(slot)) \
        .dropDuplicates([own, mark + "_r"])
    marked = docs.withColumn(mark, F.xxhash64(whole(docs, text_col)))
    both = marked.join(place, marked[id_col].eqNullSafe(place[own]) & (marked[mark] == place[mark + "_r"]))
    both.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot) \
        .select(*map(col, docs.columns), shard).write.partitionBy(shard).parquet(path)
    return shard


def op2_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return hilbert_shards(docs).select(
        F.col("id").alias("doc_id"), "size", F.col("crc32").alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
