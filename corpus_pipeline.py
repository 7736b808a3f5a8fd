"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

Every stage takes the documents that its predecessor kept and, but for the last, returns the
columns of ``documents``. Rows without doc_id are kept, unless a stage's decision is about them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from procflow.llm.common import id_or_last, stage, table  # noqa: E402
from procflow.llm.decontaminate import find_benchmark  # noqa: E402
from procflow.llm.jaccard_join import jaccard_components  # noqa: E402
from procflow.llm.line_dedup import SPACE, dedup_lines  # noqa: E402
from procflow.llm.packing import pack_documents  # noqa: E402
from procflow.llm.quality import THRESHOLD, fit, score_texts  # noqa: E402
from procflow.llm.queries import PACK_END  # noqa: E402
from procflow.llm.tokens import encoder_path  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; learned from the labels of these documents."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, model).where(F.col("score") >= THRESHOLD).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that a smaller doc_id holds; n_chars follows the text.

    A document that held nothing else is a copy of what other documents keep, and goes whole; one
    that had no text before stays as it was.
    """
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        length = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", length)
    emptied = (F.size("gone") > 0) & (F.btrim("kept", F.lit(SPACE)) == "")
    return dedup_lines(docs).where(~emptied).select(row.alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows: the one with the smallest doc_id, rows without one last.

    Each row of the written input is a node of its own, whatever its doc_id; of rows that share the
    smallest doc_id the order of the text hashes, then of the rows, decides. Texts without words are
    linked with nothing and stay.
    """
    row = F.monotonically_increasing_id()
    # Written with their numbers, so that all later reads see the same ones.
    rows = stage(docs.select(row.alias("row_id"), F.struct(*docs.columns).alias("row")), "numbered-rows")
    found = jaccard_components(rows.select(F.col("row_id").alias("doc_id"), "row.text"))
    found = stage(found.select(F.col("doc_id").alias("row_id"), "component_id"), "row-components")
    order = F.struct(id_or_last("row.doc_id").alias("id"), F.xxhash64("row.text").alias("text"), "row_id")
    # Only groups of several rows are ordered.
    linked = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = stage(found.join(linked, "component_id", "left_semi"), "linked-rows")
    ordered = stage(rows.select("row_id", order.alias("place")).join(linked, "row_id"), "ordered-rows")
    first = ordered.groupBy("component_id").agg(F.min("place")["row_id"].alias("row_id"))
    gone = stage(linked.select("row_id").join(first, "row_id", "left_anti"), "near-duplicates")
    return rows.join(gone, "row_id", "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place in its document and in its sequence, and its ids."""
    return pack_documents(docs, encoder_path(), PACK_END)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: A learned classifier and a packing have no counterpart in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
