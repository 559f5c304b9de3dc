"""From raw documents to packed training sequences, one table after another.

Each stage takes all documents its predecessor kept; its result is written as Parquet below the session's checkpoint
folder and read again as the next stage's documents, so a lost executor never costs more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.functions.columns import col
from tidemill.functions.durable import fresh_path, stage
from tidemill.llm.best_fit import best_fit, document_items
from tidemill.llm.line_dedup import dedup_lines
from tidemill.llm.near_dups import drop_near_copies
from tidemill.llm.secret_ledger import redact
from tidemill.llm.weak_labels import keep_good


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars as the text is now."""
    return docs.select(*[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier calls good."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds too."""
    return _counted(dedup_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Documents without words are in no group and stay."""
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret found."""
    return _counted(redact(docs, fresh_path(spark, "ledger")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences."""
    return best_fit(document_items(docs)).select(
        F.col("id").alias("doc_id"), "size", "piece", "start", "length", "block", "bin", "slot", "room")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near_duplicates),
          ("secret scan", secrets), ("best-fit packing", packing)]

ORACLE_SQL = None  # the classifier, the signatures and the packing are not for SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
