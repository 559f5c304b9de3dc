"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

A document goes to the fullest open bin that has room for it and holds no other document of its source or of its
duplicate cluster. Bins are kept in the order of their room; the search starts at the tightest bin that has room
and goes on to its successors until one is compatible. Each bin carries a bitmap of the sources and one of the
clusters in it. Documents longer than a bin are cut into full bins and a rest, and no token is lost.

Documents are dealt into blocks of about ``BLOCK_ROWS`` rows by a hash of their row, so that a hot source or cluster
is spread over all blocks, and each block is packed on its own: bins never cross blocks, and a block leaves at most its
last bins part empty. Only ids, lengths, sources and clusters move, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import col
from tidemill.functions.durable import stage
from tidemill.llm.columns import lower_ascii, whole

CAPACITY = 2048
BLOCK_ROWS = 20_000
PLACES = "id string, row long, size long, piece int, start long, length long, block int, bin int, slot int, room int"


def pack(items: Iterable[tuple[int, int, int]], capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Place items (length, source, cluster), in order; sources and clusters are small integers from 0.

    Gives each item's (bin, slot) and each bin's room. Bins with room sit in one list for each amount of room, and the
    amounts in use in one bitmap, whose bits are walked from the tightest upward. Bins of one room that hold the same
    source stand in one group, so a hot source passes over all of them at once.
    """
    placed: list[tuple[int, int]] = []
    room: list[int] = []
    held: list[list[int]] = []  # of each bin: source bitmap, cluster bitmap, number of items
    by_room: dict[int, dict[int, list[int]]] = {}  # room -> source bitmap -> its bins, ascending
    used = 0  # bit r: some bin has room r
    for length, source, cluster in items:
        mine, copies, found = 1 << source, 1 << cluster, -1
        rest = used >> length << length
        while rest and found < 0:
            at = (rest & -rest).bit_length() - 1
            fits = [bins for sources, bins in by_room[at].items() if not sources & mine]
            found = min((b for bins in fits for b in _first_without(bins, held, copies)), default=-1)
            rest &= rest - 1
        if found < 0:
            found = len(room)
            room.append(capacity)
            held.append([0, 0, 0])
        else:
            groups = by_room[room[found]]
            group = groups[held[found][0]]
            del group[bisect_left(group, found)]
            if not group:
                del groups[held[found][0]]
            if not groups:
                del by_room[room[found]]
                used &= ~(1 << room[found])
        placed.append((found, held[found][2]))
        room[found] -= length
        held[found] = [held[found][0] | mine, held[found][1] | copies, held[found][2] + 1]
        if room[found] > 0:
            insort(by_room.setdefault(room[found], {}).setdefault(held[found][0], []), found)
            used |= 1 << room[found]
    return placed, room


def _first_without(bins: list[int], held: list[list[int]], copies: int) -> list[int]:
    for b in bins:
        if not held[b][1] & copies:
            return [b]
    return []


def _pack_block(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["size", "row"], ascending=[False, True], kind="stable")
    out, items = [], []
    full = 0
    for one, row, size, block in zip(rows["id"], rows["row"], rows["size"], rows["block"]):
        whole_bins, rest = divmod(size, capacity)
        for piece in range(whole_bins):
            out.append((one, row, size, piece, piece * capacity, capacity, block, full, 0, 0))
            full += 1
        if rest:
            items.append((one, row, size, whole_bins, whole_bins * capacity, rest, block))
    codes = {c: pd.factorize(rows.set_index("row")[c])[0] for c in ("source", "cluster")}
    seat = {row: k for k, row in enumerate(rows["row"])}
    items.sort(key=lambda x: (-x[5], x[1]))
    # null sources and clusters (code -1) conflict with nothing: each gets a number of its own
    free = {c: int(codes[c].max(initial=-1)) + 1 for c in codes}
    todo = []
    for x in items:
        pair = []
        for c in ("source", "cluster"):
            code = int(codes[c][seat[x[1]]])
            if code < 0:
                code, free[c] = free[c], free[c] + 1
            pair.append(code)
        todo.append((x[5], *pair))
    placed, room = pack(todo, capacity)
    out += [(*x, full + b, slot, room[b]) for x, (b, slot) in zip(items, placed)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in PLACES.split(", ")])


def best_fit(items: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pack ``items`` (id, size, source, cluster): one row for each piece of each row.

    Result: id, row (the input row's own number), size, piece, start, length, block, bin, slot (position in the bin) and
    room (what the bin has left). (block, bin) names a bin. A size of null or 0 or less takes no room and gives
    no row. A null source or cluster conflicts with nothing. Repeated rows are packed each on its own. Two
    pieces of one document never share a bin, as all but its last fill theirs.
    """
    rows = stage(items.select("id", F.col("size").cast("bigint").alias("size"), F.col("source").cast("string").alias("source"),
                              F.col("cluster").cast("string").alias("cluster"),
                              F.monotonically_increasing_id().alias("row")).filter("size > 0"), "items")
    blocks = max(1, -(-rows.count() // block_rows))
    kind = dict(items.dtypes)["id"]
    dealt = rows.withColumn("id", F.col("id").cast("string")) \
        .withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    packed = dealt.groupBy("block").applyInPandas(lambda block: _pack_block(block, capacity), PLACES)
    return packed.withColumn("id", F.col("id").cast(kind))


def document_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source, cluster): words of the whole text plus one for the end of the document; equal texts are a cluster."""
    text = whole(docs, text_col)
    words = F.size(F.filter(F.split(text, "[ \t-\r]+", -1), lambda w: w != ""))
    return docs.select(col(id_col).alias("id"), (words + 1).alias("size"), col(source_col).alias("source"),
                       F.sha2(lower_ascii(text), 256).alias("cluster"))


def bins(packed: DataFrame) -> DataFrame:
    """One row for each bin: block, bin, pieces, used."""
    return packed.groupBy("block", "bin").agg(F.count("*").alias("pieces"), F.sum("length").alias("used"))


def op6_best_fit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return best_fit(document_items(docs)).select(F.col("id").alias("doc_id"), "size", "piece", "start", "length", "block",
                                                 "bin", "slot", "room")
