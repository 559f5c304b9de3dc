"""Fill-in-the-middle: each text is cut into prefix, middle and suffix, and put together again behind sentinels.

The cuts and the form come from a hash of the document's id, worked out by Spark. The cutting itself is a chain of
``pyarrow.compute`` calls on stretches of a batch's text: units (code points) become list arrays over the batch's own buffer,
are flattened with the index of the document they came from, get their ordinal in it, are filtered by role, made lists
again and joined to one piece a document. A stretch has a bounded number of bytes, so a very long text needs memory for
itself and its output, not for a row per code point. Rows stay where they are: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemill.functions.columns import col, free_name
from tidemill.llm.columns import whole

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values of the output format
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
STRETCH = 1 << 18  # bytes whose units are looked at at once


def _role_pieces(units: pa.Array, parents: pa.Array, keep: pa.Array, docs: int) -> pa.Array:
    """The kept units of each document as one text: filtered, made lists again and joined."""
    owners = parents.filter(keep).to_numpy(zero_copy_only=False)
    offsets = np.searchsorted(owners, np.arange(docs + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), units.filter(keep)), "")


def _together(parts: list[tuple[int, pa.Array]], docs: int) -> pa.Array:
    """One text a document from the pieces (first document, texts) of all stretches, in order."""
    if not parts:
        return pa.array([""] * docs, pa.string())
    owners = np.concatenate([np.arange(first, first + len(texts)) for first, texts in parts])
    texts = pa.concat_arrays([texts for _, texts in parts])
    offsets = np.searchsorted(owners, np.arange(docs + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts), "")


def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Prefix, middle and suffix of each text (no nulls): the first cut units, those up to the second cut, the rest."""
    texts = pa.concat_arrays([texts.cast(pa.string())])  # offsets from 0
    docs = len(texts)
    _, where, data = texts.buffers()
    ends = np.frombuffer(where, np.int32)[texts.offset:texts.offset + docs + 1].astype(np.int64) if docs else np.zeros(1, np.int64)
    begin, total = int(ends[0]), int(ends[-1])
    found, seen = ([], [], []), np.zeros(docs, np.int64)  # pieces by role; units of each document seen so far
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = begin
    while at < total:
        stop = min(total, at + STRETCH)
        while stop < total and bytes_[stop] & 0xC0 == 0x80:
            stop += 1
        raw = pa.UInt8Array.from_buffers(pa.uint8(), stop - at, [None, data.slice(at, stop - at)])
        leads = pc.not_equal(pc.bit_wise_and(raw, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8()))
        starts = pc.indices_nonzero(leads).to_numpy().astype(np.int32)
        # documents of this stretch and where they begin in it; a text's first byte starts a unit, whatever it is
        low, high = int(np.searchsorted(ends, at, "right")) - 1, int(np.searchsorted(ends, stop, "left"))
        edges = np.clip(ends[low:high + 1] - at, 0, stop - at).astype(np.int32)
        own = edges[:-1][edges[:-1] < edges[1:]]
        if len(np.setdiff1d(own, starts, assume_unique=True)):
            starts = np.union1d(starts, own).astype(np.int32)
        bounds = pa.array(np.append(starts, np.int32(stop - at)))
        units = pa.StringArray.from_buffers(len(starts), bounds.buffers()[1], data.slice(at, stop - at))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, edges).astype(np.int32)), units)
        units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
        counts = np.diff(lists.offsets.to_numpy())
        before = pa.array(lists.offsets.to_numpy()[:-1] - seen[low:high])
        ordinals = pc.subtract(pa.array(np.arange(len(units))), pc.take(before, parents))
        seen[low:high] += counts
        in_prefix = pc.less(ordinals, pc.take(first.slice(low, high - low), parents))
        in_suffix = pc.greater_equal(ordinals, pc.take(second.slice(low, high - low), parents))
        in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
        for parts, keep in zip(found, (in_prefix, in_middle, in_suffix)):
            parts.append((low, _role_pieces(units, parents, keep, high - low)))
        at = stop
    # a document at the end of one stretch and the start of the next is in both: its pieces join in order
    return tuple(_together(parts, docs) for parts in found)


def _number(digest: Column, group: int) -> Column:
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("bigint")


def fill_middle(docs: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
                sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and n, form, prefix_chars, middle_chars and output, one row for each row.

    The first four groups of 8 hex digits of sha256(``seed``:id) decide: two cuts among 0 to n, the form ``plain``
    where the third modulo 100 reaches ``plain_from``, else ``spm`` (suffix first) where the fourth modulo 100 is
    below ``spm_below``, else ``psm``. An empty or null text and a text that holds a sentinel are plain: the output is
    the text (empty for null) and the piece lengths are null. A null id is hashed as the empty id; rows that repeat an id
    are cut at the same fractions of their own texts, so repeated rows come out alike. An empty table gives no rows.
    The text column comes back as text, empty where it was null. Names that ``docs`` has already are prefixed.
    """
    made = {name: free_name(docs, name) for name in ("n", "form", "prefix_chars", "middle_chars", "output")}
    digest = free_name(docs, "_digest")
    text, n = whole(docs, text_col), F.col(made["n"])
    rows = docs.select(*[text.alias(c) if c == text_col else col(c) for c in docs.columns]) \
        .withColumn(made["n"], F.char_length(col(text_col)).cast("bigint")) \
        .withColumn(digest, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit(""))), 256))
    h = [_number(F.col(digest), k) for k in range(4)]
    marked = reduce(lambda a, b: a | b, (F.contains(col(text_col), F.lit(s)) for s in sentinels))
    form = F.when((n == 0) | marked | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    cuts, moved = [h[0] % (n + 1), h[1] % (n + 1)], F.col(made["form"]) != "plain"
    rows = rows.withColumn(made["form"], form).withColumn(made["prefix_chars"], F.when(moved, F.least(*cuts))) \
        .withColumn(made["middle_chars"], F.when(moved, F.greatest(*cuts) - F.least(*cuts))).drop(digest)
    mark_p, mark_s, mark_m = sentinels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, kind, first, length = (batch.column(c) for c in
                                        (text_col, made["form"], made["prefix_chars"], made["middle_chars"]))
            here = pc.not_equal(kind, "plain")
            first = first.filter(here)
            prefix, middle, suffix = cut(own.filter(here), first, pc.add(first, length.filter(here)))
            psm = pc.binary_join_element_wise(mark_p, prefix, mark_s, suffix, mark_m, middle, "")
            spm = pc.binary_join_element_wise(mark_s, suffix, mark_p, prefix, mark_m, middle, "")
            output = pc.replace_with_mask(own, here, pc.if_else(pc.equal(kind.filter(here), "spm"), spm, psm))
            yield pa.RecordBatch.from_arrays([*batch.columns, output], [*batch.schema.names, made["output"]])

    sent = T.StructType([*rows.schema.fields, T.StructField(made["output"], T.StringType())])
    return rows.mapInArrow(run, sent)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of the form was made from: sentinels occur in no text that was cut."""
    def pieces(first: str, second: str) -> list[Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        rest = F.substring_index(body, second, -1)
        return [F.substring_index(body, second, 1), F.substring_index(rest, sentinels[2], 1), F.substring_index(rest, sentinels[2], -1)]

    (prefix, suffix, middle), (suffix2, prefix2, middle2) = pieces(*sentinels[:2]), pieces(sentinels[1], sentinels[0])
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)) \
        .otherwise(F.concat(prefix2, middle2, suffix2))


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = """WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS d FROM documents),
    numbers AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1,
        CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3,
        CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM hashed),
    formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
    pieces AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM formed)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256 FROM pieces"""
