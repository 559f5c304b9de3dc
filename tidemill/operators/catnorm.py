"""Surface clean-up and synonym mapping of category text."""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from io import StringIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import ColumnError, col, free_name, q, require_categorical
from tidemill.functions.durable import release, stage
from tidemill.functions.lookup import lookup_join
from tidemill.operators.valuecounts import column_counts, count_name

# Letters and marks that do not decompose into a base letter and an accent
PLAIN_LETTERS = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O",
    "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ı": "i",
    "ħ": "h", "Ħ": "H", "ŋ": "ng", "Ŋ": "NG", "ĸ": "k", "ŧ": "t", "Ŧ": "T",
    "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "«": "<<", "»": ">>",
    "–": "-", "—": "--", "‐": "-", "‑": "-", "…": "...", "•": "*", "€": "EUR", "£": "PS", "©": "(c)",
    "®": "(r)", "™": "tm", "°": "deg", "×": "x", "÷": "/", "¿": "?", "¡": "!",
}

STEPS = ("unicode_normalize", "strip_accents", "fix_unicode", "strip_whitespace", "lowercase")


def _fold_characters(values: Column, compose: bool, accents: bool) -> Column:
    table = PLAIN_LETTERS if accents else {}

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        import unicodedata

        def one(text):
            if text is None:
                return None
            if compose:
                text = unicodedata.normalize("NFKC", text)
            if accents:
                text = "".join(table.get(ch, ch) for ch in text)
                parts = unicodedata.normalize("NFKD", text)
                text = unicodedata.normalize("NFC", "".join(
                    ch for ch in parts if not unicodedata.combining(ch)))
            return text

        return texts.map(one)

    return fold(values)


def normalize_text(df: DataFrame, column: str, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """Clean a text column. Character folding runs once per distinct value that is not plain ASCII."""
    require_categorical(df, column)
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ColumnError(f"unknown steps: {unknown}")
    out, text = df, col(column).cast("string")
    if "unicode_normalize" in steps or "strip_accents" in steps:
        unusual = column_counts(df, column).filter(text.rlike(r"[^\x00-\x7F]"))
        folded = stage(unusual.select(q(column), F.col(count_name(column)).alias("_n"), _fold_characters(
            text, "unicode_normalize" in steps, "strip_accents" in steps).alias("_folded")), "folded")
        out = lookup_join(df, folded, column, "_n")
        text = F.coalesce(F.col("_folded"), text)
    if "fix_unicode" in steps:
        text = F.regexp_replace(text, r"[\r\n\x0B\x0C\x{85}\x{2028}\x{2029}]+", " ")
        text = F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F\x7F-\x{9F}\x{FEFF}\x{200B}-\x{200D}]", "")
    if "strip_whitespace" in steps:
        text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ +| +$", "")
    if "lowercase" in steps:
        text = F.lower(text)
    return out.select(*[text.alias(c) if c == column else col(c) for c in df.columns])


# Characters that make a longer word of the one they touch
WORD_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
EXPRESSION_WORDS = 200  # words up to which a map is one regular expression in the JVM
AUTOMATON_BYTES = 32 * 1024 * 1024  # text of a map that a task holds as one automaton
STRETCH_BYTES = 1024 * 1024  # text that a worker holds as Python objects, in whole rows
WINDOW = 64 * 1024  # characters that are searched at once, and hits that are unpacked at once
Hit = tuple[int, int, str]  # start, stop, canonical


def _synonym_table(synonyms: dict[str, list[str]], fold: Callable[[str], str]) -> dict[str, str]:
    table: dict[str, str] = {}
    for canonical, words in synonyms.items():
        for word in [*words, canonical]:
            if word and word.strip():
                table[fold(word.strip())] = canonical
    return table


def _fold_case(text: str) -> str:
    """Lower case that keeps the number of characters, so that places in it are places in the text."""
    if text.isascii():
        return text.lower()
    return "".join(low if len(low := ch.lower()) == 1 else ch for ch in text).replace("ς", "σ")


def harmonized(text: Column, synonyms: dict[str, list[str]], case_sensitive: bool = False) -> Column:
    """Replace whole-word synonyms by their canonical value: longest first, in a single pass."""
    table = _synonym_table(synonyms, str if case_sensitive else str.lower)
    if not table:
        return text
    words = "|".join(re.escape(w) for w in sorted(table, key=lambda w: (-len(w), w)))
    pattern = f"{'' if case_sensitive else '(?iu)'}(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    swapped = F.transform(hits, lambda h: F.coalesce(
        F.try_element_at(lookup, h if case_sensitive else F.lower(h)), h))
    between = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(between, F.concat(swapped, F.array(F.lit(""))),
                                   lambda a, b: F.concat(a, b)), "")


def _table_parts(table: dict[str, str], limit: int) -> list[dict[str, str]]:
    parts, size = [{}], 0
    for word, canonical in table.items():
        width = len(word.encode()) + len(canonical.encode())
        if parts[-1] and size + width > limit:
            parts.append({})
            size = 0
        parts[-1][word] = canonical
        size += width
    return parts


def _searcher(table: dict[str, str], fold: Callable[[str], str]) -> Callable[[str], Iterator[Hit]]:
    """A function from a text to its whole-word hits from the left, the longest at each start.

    A long text is searched window by window, each with the length of the longest word beyond its end: no more hits are
    held at once than begin in one window.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, canonical in table.items():
        automaton.add_word(word, (len(word), canonical))
    automaton.make_automaton()
    reach = max(map(len, table))
    step = max(WINDOW, 4 * reach)

    def hits(text):
        for at in range(0, len(text), step):
            longest = {}
            for last, (width, canonical) in automaton.iter(fold(text[at:at + step + reach])):
                stop = at + last + 1
                start = stop - width
                if start >= at + step or start and text[start - 1] in WORD_CHARACTERS \
                        or stop < len(text) and text[stop] in WORD_CHARACTERS:
                    continue
                longest[start] = stop, canonical  # ends come in rising order
            for start in sorted(longest):
                yield start, *longest[start]

    return hits


def _replaced(text: str, hits: Iterable[Hit]) -> str:
    """The text with its hits replaced from the left; a hit that overlaps one taken before it is passed over."""
    out, done = StringIO(), 0
    for start, stop, canonical in hits:
        if start >= done:
            out.write(text[done:start])
            out.write(canonical)
            done = stop
    out.write(text[done:])
    return out.getvalue()


def _stretches(sizes: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of rows of about ``STRETCH_BYTES``: what a batch of Spark holds may be
    many times more than a worker has memory for as Python objects."""
    total = np.cumsum(np.asarray(pc.fill_null(sizes, 0), np.int64))
    first = np.flatnonzero(np.diff(total // STRETCH_BYTES, prepend=-1))
    return zip(first.tolist(), np.diff(first, append=len(total)).tolist())


def _replaced_words(df: DataFrame, table: dict[str, str], fold: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function from a text column to the texts with the words of ``table`` replaced.

    The map is broadcast as words; each task builds the automaton from it once and reads every text once. Hits are used
    as they are found and never gathered.
    """
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("string")
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hits = _searcher(shared.value, fold)
        for texts in batches:
            for at, n in _stretches(pc.binary_length(texts)):
                yield pa.array([None if t is None else _replaced(t, hits(t)) for t in texts.slice(at, n).to_pylist()], pa.string())

    return replace


def _packed(hits: Iterable[Hit]) -> bytes:
    """Hits as three rows of small numbers (gap to the start before, length, name), then each canonical value once. Packs
    can be put one after another."""
    places, names, last = array("i"), {}, 0
    for start, stop, canonical in hits:
        places.extend((start - last, stop - start, names.setdefault(canonical, len(names))))
        last = start
    table = np.array(places, np.int32).reshape(-1, 3).T
    kind, words = np.min_scalar_type(int(table.max(initial=0))), json.dumps(list(names)).encode()
    return struct.pack("=iii", table.shape[1], kind.itemsize, len(words)) + table.astype(kind).tobytes() + words


def _unpacked(packs: bytes) -> Iterator[Hit]:
    """The hits of all packs from the left, the longest first."""
    tables, names, at = [], [], 0
    while at < len(packs):
        n, size, width = struct.unpack_from("=iii", packs, at)
        gap, length, name = np.frombuffer(packs, f"u{size}", 3 * n, at + 12).reshape(3, n).astype(np.int32)
        start = np.cumsum(gap, dtype=np.int32)
        tables.append([start, start + length, name + len(names)])
        at += 12 + 3 * n * size + width
        names += json.loads(packs[at - width:at])
    start, stop, name = np.concatenate(tables, axis=1)
    order = np.lexsort((-stop, start))
    for k in range(0, len(order), WINDOW):
        some = order[k:k + WINDOW]
        for a, b, which in zip(start[some].tolist(), stop[some].tolist(), name[some].tolist()):
            yield a, b, names[which]


def _found_words(df: DataFrame, table: dict[str, str], fold: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function from a text column to its packed hits, for a map in several parts; the rest as in ``_replaced_words``."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("binary")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hits = _searcher(shared.value, fold)
        for texts in batches:
            for at, n in _stretches(pc.binary_length(texts)):
                yield pa.array([None if t is None else _packed(hits(t)) for t in texts.slice(at, n).to_pylist()], pa.binary())

    return find


def _swapped(values: Column, hits: Column) -> Column:
    """Texts with the packed hits of all parts of a map replaced."""
    @F.arrow_udf("string")
    def swap(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, packs in batches:
            for at, n in _stretches(pc.add(pc.binary_length(texts).cast("int64"), pc.binary_length(packs))):
                rows = zip(texts.slice(at, n).to_pylist(), packs.slice(at, n).to_pylist())
                yield pa.array([None if t is None else _replaced(t, _unpacked(p)) for t, p in rows], pa.string())

    return swap(values, hits)


def harmonize_values(df: DataFrame, column: str, synonyms: dict[str, list[str]], case_sensitive: bool = False,
                     expression_words: int = EXPRESSION_WORDS, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Replace whole-word synonyms by their canonical value: from the left, longest first, in a single pass.

    A map of at most ``expression_words`` words becomes one expression. A larger one becomes an Aho-Corasick automaton, in time
    linear in the text whatever the number of words. Of a map above ``automaton_bytes`` no task holds more than
    one part of that size: the parts are looked for one after another, with the hits so far staged beside the rows,
    at most two such tables at a time.
    A worker turns over about ``STRETCH_BYTES`` of text at once, however many rows Spark's batches have.
    Null stays null; the empty text and an empty map change nothing.
    """
    require_categorical(df, column)
    text = col(column).cast("string")
    fold = str if case_sensitive else _fold_case
    table = _synonym_table(synonyms, fold)
    if len(table) <= expression_words:
        made = harmonized(text, synonyms, case_sensitive)
        return df.select(*[made.alias(c) if c == column else col(c) for c in df.columns])
    parts = _table_parts(table, automaton_bytes)
    if len(parts) == 1:
        made = _replaced_words(df, table, fold)(text)
        return df.select(*[made.alias(c) if c == column else col(c) for c in df.columns])
    hits, out = free_name(df, "_hits"), df
    for k, part in enumerate(parts):
        found = _found_words(df, part, fold)(text)
        last, out = out, stage(out.withColumn(hits, F.concat(col(hits), found) if k else found), "hits")
        if k:
            release(last)
    made = _swapped(text, col(hits))
    return out.select(*[made.alias(c) if c == column else col(c) for c in df.columns])


def change_report(before: DataFrame, after_column: Column, column: str, samples: int = 5) -> DataFrame:
    """What a text change does to a column: counted on its distinct values, weighted by their rows."""
    counts = column_counts(before, column).select(
        col(column).cast("string").alias("before"), F.col(count_name(column)).alias("n"), after_column.alias("after"))
    return change_summary(counts, samples)


def change_summary(counts: DataFrame, samples: int = 5) -> DataFrame:
    """Totals of (before, n, after) rows, with the most frequent changes as samples."""
    changed = F.col("before") != F.col("after")
    shown = counts.filter(changed).orderBy(F.desc("n"), F.asc("before")).limit(samples).collect()
    pairs = [F.struct(F.lit(r["before"]).alias("before"), F.lit(r["after"]).alias("after")) for r in shown]
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_affected"),
        F.coalesce(F.sum(F.when(changed, F.col("n"))), F.lit(0)).alias("values_changed"),
        F.count_distinct("before").alias("unique_before"), F.count_distinct("after").alias("unique_after"),
    ).withColumn("sample_changes", F.array(*pairs).cast("array<struct<before:string,after:string>>"))
