"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get the same integer name, different
blocks different ones, by sorting the blocks themselves. Then adjacent names are paired and the pairs are
named the same way, until each document is down to one name. Names come from comparing content, never
from a hash alone (hashes only say where content is compared), so two documents share an identity if
and only if their texts are equal.

How it scales: blocks cross the network once. A block with more than ``WARM_ROWS`` occurrences (or
a millionth of all) is collapsed before the shuffle instead, and its names are joined back by a join whose
skewed side the adaptive planner splits. Each naming round halves the names, so all rounds together
move less than the first, and the number of rounds is the logarithm of the longest text's blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.functions.columns import col, free_name
from tidemill.functions.durable import release, stage
from tidemill.llm.columns import lower_ascii, same_row, whole

BLOCK_BYTES = 4096
WARM_ROWS, WARM_KEYS = 1000, 1_000_000


def _blocks(docs: DataFrame, text: Column, block_bytes: int) -> DataFrame:
    cut = docs.select("id", F.xxhash64(text).alias("mark"), F.encode(text, "UTF-8").alias("bytes")) \
        .withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block_bytes)).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                         lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    return cut.select("id", "mark", "n", F.posexplode(pieces).alias("pos", "block")) \
        .withColumn("h", F.xxhash64("block"))


def _name_blocks(blocks: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, mark, n, pos, name): ``hashes`` (h) holds the hash of each block occurrence."""
    total = hashes.count()
    warm = stage(hashes.groupBy("h").count()
                 .filter(F.col("count") > max(WARM_ROWS, total // WARM_KEYS)).select("h"), "warm")
    # at most WARM_KEYS rows of eight bytes: each stands for more than a millionth of all occurrences
    order = ["h", "block", "id", "mark", "pos"]
    sorted_rows = blocks.join(F.broadcast(warm), "h", "left_anti").repartition("h").sortWithinPartitions(*order) \
        .withColumn("rank", F.monotonically_increasing_id())
    cold = sorted_rows.select("id", "mark", "n", "pos",
                              (F.min("rank").over(Window.partitionBy("h", "block")) * 2).alias("name"))
    if warm.isEmpty():
        return stage(cold, "names")
    often = blocks.join(F.broadcast(warm), "h", "left_semi")
    names = stage(often.select("h", "block").distinct().sortWithinPartitions("h", "block")
                  .withColumn("name", F.monotonically_increasing_id() * 2 + 1), "warm-names")
    return stage(cold.unionByName(often.join(names, ["h", "block"]).select("id", "mark", "n", "pos", "name")), "names")


def _name_pairs(state: DataFrame) -> DataFrame:
    """One round: adjacent names become pairs, pairs become names."""
    even = F.col("pos") % 2 == 0
    pairs = stage(state.filter("n > 1").groupBy("id", "mark", F.floor(F.col("pos") / 2).cast("int").alias("half")).agg(
        F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
        F.ceil(F.max("n") / 2).cast("int").alias("n")).withColumnRenamed("half", "pos"), "pairs")
    names = stage(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
                  .withColumn("name", F.monotonically_increasing_id()), "pair-names")
    return stage(pairs.join(names, ["a", "b"]).select("id", "mark", "n", "pos", "name"), "names")


def text_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: id, row (a number of its own), sha256 and the identity of its text.

    Texts are equal when they are identical after lower-casing A-Z. Null counts as the empty text, which is
    one block of no bytes. Rows with a null id, and rows that repeat an id, are rows like any other.
    Other columns of ``docs`` are not looked at. An empty table gives an empty result.
    """
    text = lower_ascii(whole(docs, text_col))
    rows = docs.select(col(id_col).alias("id"), text.alias("text"))
    base = rows.select("id", F.xxhash64("text").alias("mark"), F.sha2(F.col("text"), 256).alias("sha256"),
                       F.encode("text", "UTF-8").alias("bytes")) \
        .withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block_bytes)).cast("int"))
    hashed = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.xxhash64(
        F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes))))
    narrow = stage(base.select("id", "mark", "sha256", "n", hashed.alias("hashes"),
                               F.monotonically_increasing_id().alias("row")), "texts")
    longest = narrow.agg(F.max("n")).first()[0] or 1
    state = _name_blocks(_blocks(rows, F.col("text"), block_bytes), narrow.select(F.explode("hashes").alias("h")))
    done, used, level = [], [state], 0
    while True:
        done.append(state.filter("n = 1").select("id", "mark", (F.col("name") * 64 + level).alias("identity")))
        if 2 ** level >= longest:
            break
        state, level = _name_pairs(state), level + 1
        used.append(state)
    named = reduce(DataFrame.unionByName, done).groupBy("id", "mark").agg(F.max("identity").alias("identity"))
    out = stage(narrow.join(named, same_row(narrow, named, "id", "mark")).select(
        narrow["id"], "row", "sha256", "identity"), "identities")
    release(narrow, *used)
    return out


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: id, keep_id, group_size, kept, sha256 of the normalised text.

    Of equal texts the row with the largest id stays; a null id is smaller than any other. Exactly one row of a
    group is kept, also where rows repeat an id.
    """
    members = text_identities(docs, id_col, text_col, block_bytes)
    # staged, so that the planner can split the side of a large group's members
    groups = stage(members.groupBy("identity").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("group_size")), "groups")
    return members.join(groups, "identity").select(
        "id", F.col("top.id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "sha256")


def drop_equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns as they were."""
    keep, mark = free_name(docs, "_keep"), free_name(docs, "_sha256")
    kept = duplicate_groups(docs, id_col, text_col, block_bytes).filter("kept") \
        .select(F.col("id").alias(keep), F.col("sha256").alias(mark))
    marked = docs.withColumn(mark, F.sha2(lower_ascii(whole(docs, text_col)), 256))
    matched = marked.join(kept, marked[id_col].eqNullSafe(kept[keep]) & (marked[mark] == kept[mark]), "left_semi")
    return matched.dropDuplicates([id_col, mark]).drop(mark)


def op1_block_naming(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return duplicate_groups(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                                         F.col("sha256").alias("text_sha256"))


OP1_SQL = """WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS s FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
        doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, sha256(s) AS text_sha256 FROM t"""
