"""Lines that repeat across documents, dropped everywhere but in the first document that holds them.

Lines are exploded, normalised and hashed; documents are counted by hash; lines over the threshold are
looked up again by hash and each document is put together from the lines that stay, by position. Only
hashes, ids and positions are shuffled to count and to mark; a text moves once, to meet the positions it loses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import col, free_name, q
from tidemill.functions.durable import release, stage
from tidemill.llm.columns import BLANKS, lower_ascii, same_row, whole

MIN_POINTS, MIN_DOCS = 10, 2
SECOND_HASH = 0x5DEECE66D


def _line_keys(docs: DataFrame, id_col: str, text_col: str, min_points: int) -> DataFrame:
    """(id, mark, pos, h1, h2) of each line long enough to count. Two hashes of 64 bits name a key."""
    lines = docs.select(col(id_col).alias("id"), F.xxhash64(whole(docs, text_col)).alias("mark"),
                        F.posexplode(F.split(whole(docs, text_col), "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "mark", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")) \
        .filter(F.char_length("line") >= min_points).withColumn("key", lower_ascii(F.col("line")))
    return keys.select("id", "mark", "pos", F.xxhash64("key").alias("h1"),
                       F.xxhash64(F.lit(SECOND_HASH), "key").alias("h2"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS,
                  min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, mark, dropped): sorted positions of the lines that a document loses, for documents that lose any."""
    lines = stage(_line_keys(docs, id_col, text_col, min_points), "lines")
    often = stage(lines.groupBy("h1", "h2").agg(
        (F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("docs"), F.min("id").alias("first"))
        .filter(F.col("docs") >= min_docs).drop("docs"), "often")
    out = stage(lines.join(often, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("first")))
                .groupBy("id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("dropped")), "dropped")
    release(lines, often)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS,
                min_docs: int = MIN_DOCS, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with its columns, the text rebuilt from the lines that stay, and two counts of lines.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least ``min_points``
    code points that ``min_docs`` documents hold loses its lines, all of them, but for the document with the
    smallest id. Documents are told apart by id: rows that repeat an id count once and fare alike. All null ids
    count as one document that comes last. A null or empty text is one empty line and comes out as the empty
    text; a text that loses all its lines becomes empty too; the row stays in any case. The two counts take
    free names where ``docs`` has columns of theirs.
    """
    n_lines, n_dropped = free_name(docs, n_lines), free_name(docs, n_dropped)
    lost = dropped_lines(docs, id_col, text_col, min_points, min_docs)
    mark, row_id, gone = (free_name(docs, n) for n in ("_mark", "_row_id", "_gone"))
    lost = lost.select(F.col("id").alias(row_id), F.col("mark").alias(mark + "_r"), F.col("dropped").alias(gone))
    marked = docs.withColumn(mark, F.xxhash64(whole(docs, text_col)))
    both = marked.join(lost, marked[q(id_col)].eqNullSafe(lost[row_id]) & (marked[mark] == lost[mark + "_r"]), "left")
    lines = F.split(whole(docs, text_col), "\n", -1)
    # between two dropped positions lies one slice of lines that stay
    bounds = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(lines)))
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(gone) + 1), lambda j: F.slice(
        lines, F.element_at(bounds, j) + 2, F.element_at(bounds, j + 1) - F.element_at(bounds, j) - 1))), "\n")
    text = F.when(F.col(gone).isNull(), whole(docs, text_col)).otherwise(kept)
    return both.select(*[text.alias(c) if c == text_col else col(c) for c in docs.columns],
                       F.size(lines).cast("long").alias(n_lines),
                       F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINES_SQL = """SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs})"""
KEY_SQL = """translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz')"""
OP10_SQL = f"""WITH lines AS ({LINES_SQL.format(docs="documents")}),
    keyed AS (SELECT *, {KEY_SQL} AS key FROM lines),
    often AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key
        HAVING count(DISTINCT doc_id) >= 2),
    marked AS (SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.first_id AS dropped
        FROM keyed k LEFT JOIN often o ON k.key = o.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""
