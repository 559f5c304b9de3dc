"""Secret scans kept in a ledger of content-addressed blobs.

Every version of every text is a blob, named by the SHA-256 of its UTF-8 bytes. The ledger holds one row for each
blob, rule and rule version ever scanned, with the spans found. A scan lists the blobs of its paths, takes
away the pairs of blob and rule version that the ledger has, scans what is left, each blob once however many paths
have it, and appends it to the ledger. Findings are then joined back to all paths by blob.

Only names and spans are shuffled, and one text of each blob that has something to scan. A path's text is found by a join that is
broadcast where few blobs are new, behind a check of their number. Findings meet a blob with very many paths
in a join whose skewed side the adaptive planner splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.functions.columns import col, free_name
from tidemill.functions.durable import fresh_path, stage
from tidemill.llm.columns import whole

BROADCAST_BLOBS = 500_000
SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has at least ``least`` characters.

    ``words``: lower-case texts one of which each match holds, so that a text without any needs no search.
    """
    name: str
    version: int
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    words: tuple[str, ...] = ()

    def finder(self):
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

        def spans(text: str, low: str) -> list[tuple[int, int]]:
            if self.words and not any(w in low for w in self.words):
                return []
            return [m.span() for m in found.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]
        return spans


RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True,
         ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16, words=("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 32),
)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; a ledger that has not been written yet is empty. A row written twice counts once."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path) \
        .dropDuplicates(["blob", "rule", "version"])


def _scan(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finders = [(r, r.finder()) for r in rules]
        for batch in batches:
            rows = []
            for blob, text, todo in zip(batch["blob"], batch["text"], batch["todo"]):
                low = text.lower()
                rows += [(blob, rule.name, rule.version, [{"start": s, "end": e} for s, e in spans(text, low)])
                         for k, (rule, spans) in enumerate(finders) if todo >> k & 1]
            yield pd.DataFrame(rows, columns=["blob", "rule", "version", "spans"])

    return texts.select("blob", "text", "todo").mapInPandas(run, LEDGER)


def update(docs: DataFrame, own: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Scan what the ledger at ``ledger`` lacks of ``docs``, whose `paths` are ``own``; all findings: (blob, rule, spans).

    What is scanned is appended to the ledger as a folder of its own that appears whole or not at all.
    """
    spark = docs.sparkSession
    names = [f"{r.name}@{r.version}" for r in rules]
    known = open_ledger(spark, ledger)
    seen = known.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("seen"))
    blobs = own.groupBy("blob").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    # one bit for each rule that has not seen the blob
    lacking = sum((F.when(F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), n), 0).otherwise(1 << k)
                   for k, n in enumerate(names)), F.lit(0))
    unseen = stage(blobs.join(seen, "blob", "left").select(F.xxhash64("blob").alias("name"), F.col("first.id").alias("id"),
                                                           lacking.alias("todo")).filter("todo > 0"), "unseen")
    few = unseen.count() <= BROADCAST_BLOBS  # of two numbers and a bit map each
    texts = docs.select(col(id_col).alias("own"), whole(docs, text_col).alias("text")) \
        .withColumn("blob", F.sha2("text", 256)).withColumnRenamed("own", "id").withColumn("name", F.xxhash64("blob"))
    chosen = texts.join(F.broadcast(unseen) if few else unseen,
                        texts["id"].eqNullSafe(unseen["id"]) & (texts["name"] == unseen["name"])).select("blob", "text", "todo")
    if not unseen.isEmpty():
        _scan(chosen, rules).write.parquet(f"{ledger}/{fresh_path(spark, 'scan').rsplit('/', 1)[1]}")
    current = F.concat_ws("@", "rule", F.col("version").cast("string")).isin(names)
    return open_ledger(spark, ledger).filter(current & (F.size("spans") > 0)).drop("version")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, blob, rule, spans) for each row of ``docs`` and each rule that finds something in its text.

    A null text is the empty text. Rows without an id and repeated rows are paths like any other; a row without findings
    gives no row. Other columns of ``docs`` are not looked at.
    """
    own = paths(docs, id_col, text_col)
    return own.join(update(docs, own, ledger, rules, id_col, text_col), "blob").select("id", "blob", "rule", "spans")


def paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob): the blob of each row's text."""
    return stage(docs.select(col(id_col).alias("id"), F.sha2(whole(docs, text_col), 256).alias("blob")), "paths")


def by_blob(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Of findings by blob: (blob, each rule's number of findings, spans as ``kind:start:end`` by start, then kind as listed)."""
    kinds = [r.name for r in rules]
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("rule")).cast("int")
    each = found.select("blob", "rule", rank.alias("rank"), F.explode("spans").alias("s"))
    spans = F.transform(F.array_sort(F.collect_list(F.struct("s.start", "rank", "s.end", "rule"))), lambda x: F.concat_ws(
        ":", x["rule"], x["start"].cast("string"), x["end"].cast("string")))
    return each.groupBy("blob").agg(
        *[F.count_if(F.col("rule") == k).alias(f"n_{k}") for k in kinds], F.array_join(spans, ",").alias("spans"))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
           text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of text that findings cover replaced by ``mark``; overlapping findings are one stretch."""
    blob, cover = free_name(docs, "_blob"), free_name(docs, "_cover")
    found = update(docs, paths(docs, id_col, text_col), ledger, rules, id_col, text_col)
    spans = found.select("blob", F.explode("spans").alias("s")).groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("all"))
    # (end of the stretch so far, what to keep: from, length): sorted spans, one pass
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from:int,size:int>>").alias("keep"))
    merged = F.aggregate("all", start, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["end"]).alias("end"),
        F.when((s["start"] >= acc["end"]), F.concat(acc["keep"], F.array(F.struct(
            acc["end"].alias("from"), (s["start"] - acc["end"]).alias("size"))))).otherwise(acc["keep"]).alias("keep")))
    gaps = stage(spans.select(F.col("blob").alias(blob), merged.alias(cover)), "gaps")
    pieces = gaps.agg(F.sum(F.size(F.col(cover)["keep"]) + 8)).first()[0] or 0
    gaps = F.broadcast(gaps) if pieces <= BROADCAST_BLOBS else gaps  # measured: eight bytes a piece and a name each
    marked = docs.withColumn(blob, F.sha2(whole(docs, text_col), 256)).join(gaps, blob, "left")
    text = whole(docs, text_col)
    kept = F.transform(F.col(cover)["keep"], lambda k: F.substring(text, k["from"] + 1, k["size"]))
    tail = F.substring(text, F.col(cover)["end"] + 1, F.char_length(text))
    clean = F.when(F.col(cover).isNull(), col(text_col)).otherwise(F.array_join(F.concat(kept, F.array(tail)), mark))
    return marked.select(*[clean.alias(c) if c == text_col else col(c) for c in docs.columns])


def op9_secret_ledger(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = paths(docs)
    found = by_blob(update(docs, own, fresh_path(spark, "ledger")))
    spans = F.coalesce("spans", F.lit(""))
    return own.join(found, "blob", "left").select(
        F.col("id").alias("doc_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))
