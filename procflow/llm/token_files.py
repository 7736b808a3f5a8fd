"""Token ids in Parquet list columns that can be read selectively.

Documents are range-partitioned and sorted by doc_id, encoded, and written with their metadata.
Ids are dictionary-coded (a vocabulary has fewer than 2^16 entries, so an id takes two bytes or
less before compression), row groups and pages have a fixed size, and as the files ascend in
doc_id, row-group statistics and the page index let a reader take a range of documents, or the
metadata without the ids.

Defined cases: a null or empty text has the end id alone; rows without doc_id come last; rows that
share a doc_id lie next to each other in the order of their texts; an empty table gives no rows;
columns other than doc_id and text are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procflow.llm.common import id_or_last, text_bytes
from procflow.llm.tokens import WordTokens, encoded_pieces

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: Parquet writer settings: row groups of about 32 MB, pages of at most 256 KB and 512 documents.
LAYOUT = {
    "compression": "zstd",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
}


def write_tokens(docs: DataFrame, target: str, vocabulary: str, end_id: int) -> None:
    """Encode every text of ``docs`` and write the ids below ``target`` in ascending doc_id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.of_worker(vocabulary)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece, ids, bounds in encoded_pieces(words, batch.column(1), end_id):
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.start, n),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(start + bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))),
                    ],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                start += int(bounds[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    rows = rows.repartitionByRange(id_or_last()).sortWithinPartitions(id_or_last(), "text")
    rows.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(target)


def read_tokens(spark: SparkSession, target: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the written documents, or of a range of doc_id.

    ``start`` counts the ids of all documents before; it needs the metadata columns only.
    """
    files = spark.read.schema(SCHEMA).parquet(target)
    # One row per written file: a table that the writer's partition count bounds.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    if first is not None:
        files = files.where(F.col("doc_id") >= first)
    if last is not None:
        files = files.where(F.col("doc_id") <= last)
    rows = files.join(F.broadcast(parts), "part")
    return rows.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): each document's ids as read, checked as little-endian bytes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            lengths = pa.array(np.diff(bounds), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lengths, pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = tokens.select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")
