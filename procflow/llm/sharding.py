"""Sharding by extendible hashing (DataFrame functions only).

A document's address is the bit string of its key's hash. The directory is indexed by the first
bits; a bucket whose bytes exceed the limit splits on its next bit, the others stay. All splits
are found without moving documents: bytes are summed once per cell (a prefix so long that a cell
is a small part of the limit), the cells are rolled up to all shorter prefixes, and a document
belongs to the shortest prefix of its address that fits. Cells that still do not fit are taken
through the next bits, until every bucket fits or holds one row.

After the 64 bits of the key hash, 64 bits of a row number follow, so rows with one key split too.

``write_shards`` then moves the documents: each finds its shard in the directory by its address and
is dealt by shard, one folder and file each. No shard exceeds the limit but for a single row, so no
task is hot.

Defined cases: a null key hashes like the text 'null'; a null text has 0 bytes and its row lies in the
shard of its address like any other; repeated rows are rows of their own; a row that is larger than the
limit gets a shard of its own, which exceeds it (a very long text stays whole); an empty table gives no
rows, no shards and an empty directory; other columns, whatever their names, are written as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StringType, StructType
from pyspark.sql import functions as F

from procflow.llm.common import new_folder, stage

KEY_BITS = 64
ALL_BITS = 128


def key_bits(key: Column) -> Column:
    """64 bits as text: the first half of the key's MD5."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    halves = [F.conv(F.substring(F.md5(text), i, 8), 16, 2) for i in (1, 9)]
    return F.concat(*[F.lpad(h, 32, "0") for h in halves])


@dataclass
class Sharding:
    """``rows``: (key, n_bytes, shard, depth), one per input row; ``shards``: (shard, depth, n_rows, n_bytes)."""

    rows: DataFrame
    shards: DataFrame

    def directory(self) -> DataFrame:
        """(slot, shard): each prefix of the global depth and the shard that it points to."""
        deepest = self.shards.agg(F.max("depth")).first()[0] or 0
        free = F.lit(deepest) - F.col("depth")
        slots = self.shards.select(
            "shard", free.alias("free"), F.explode(F.sequence(F.lit(0), F.pow(2, free).cast("long") - 1)).alias("i")
        )
        tail = F.lpad(F.conv(F.col("i").cast("string"), 10, 2), ALL_BITS, "0")
        tail = tail.substr(F.lit(ALL_BITS + 1) - F.col("free"), F.col("free"))
        return slots.select(F.concat("shard", tail).alias("slot"), "shard")


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For cells (prefix of ``high`` bits, n, bytes): the shortest prefix that fits, else null."""
    up = cells.select("cell", "n", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d"))
    up = up.select("cell", "d", F.col("cell").substr(F.lit(1), F.col("d")).alias("prefix"), "n", "bytes")
    sums = up.groupBy("prefix").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    fits = sums.where((F.col("bytes") <= limit) | (F.col("n") == 1)).select("prefix")
    best = up.join(fits, "prefix", "left_semi").groupBy("cell").agg(F.min("d").alias("depth"))
    return cells.select("cell").join(best, "cell", "left")


def _levels(rows: DataFrame, limit: int, low: int, high: int, top: int, step: int) -> list[tuple[int, DataFrame]]:
    """The directory of the staged table (n_bytes, bits), as tables (cell, depth) for growing cell lengths.

    A cell without a depth does not fit as a whole; its rows go on to the next length, up to ``top``.
    """
    levels = []
    while True:
        high = min(high, top)
        named = rows.withColumn("cell", F.substring("bits", 1, high))
        cells = named.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"))
        leaves = _leaves(stage(cells, "shard-cells"), low, high, limit)
        if high == ALL_BITS:
            leaves = leaves.withColumn("depth", F.coalesce("depth", F.lit(ALL_BITS)))
        leaves = stage(leaves, "shard-leaves")
        levels.append((high, leaves))
        too_large = leaves.where("depth is null").select("cell")
        if high == top or not too_large.limit(1).count():
            return levels
        rows = named.join(too_large, "cell", "left_semi").drop("cell")
        low, high = high + 1, high + step


def _placed(rows: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` with ``depth`` and ``shard``; both null where no level has a place for the address."""
    depths = []
    for i, (bits, leaves) in enumerate(levels):
        rows = rows.withColumn("_cell", F.substring("bits", 1, bits))
        rows = rows.join(leaves.select(F.col("cell").alias("_cell"), F.col("depth").alias(f"_{i}")), "_cell", "left")
        rows, depths = rows.drop("_cell"), [*depths, f"_{i}"]
    rows = rows.withColumn("depth", F.coalesce(*depths)).drop(*depths)
    return rows.withColumn("shard", F.col("bits").substr(F.lit(1), F.col("depth")))


def _first_bits(rows: DataFrame, limit: int, spare_bits: int) -> int:
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    return (math.ceil(math.log2(total / limit)) if total > limit else 0) + spare_bits


def _n_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")


def _row_bits() -> Column:
    return key_bits(F.monotonically_increasing_id())


def shard_documents(docs: DataFrame, limit: int, key: str = "doc_id", spare_bits: int = 4) -> Sharding:
    """Shards of at most ``limit`` bytes of text, by the hash of column ``key``."""
    address = F.concat(key_bits(F.col(key)), _row_bits()).alias("bits")
    rows = stage(docs.select(F.col(key).alias("key"), _n_bytes(), address), "shard-rows")
    levels = _levels(rows, limit, 0, _first_bits(rows, limit, spare_bits), ALL_BITS, spare_bits * 2)
    out = stage(_placed(rows, levels).select("key", "n_bytes", "shard", "depth"), "shard-places")
    return Sharding(out, _sizes(out))


def _sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("shard", "depth").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))


@dataclass
class ShardFiles:
    """Documents in one folder per shard below ``folder``; ``column`` names the folders' column."""

    spark: SparkSession
    folder: str
    schema: StructType
    column: str

    def read(self, shard: str | None = None) -> DataFrame:
        """The documents of all shards, or of one, with their shard's bits in ``column``."""
        held = self.spark.read.schema(self.schema).parquet(self.folder)
        if shard is not None:
            held = held.where(F.col(self.column) == MARK + shard)
        return held.withColumn(self.column, F.substring(self.column, len(MARK) + 1, ALL_BITS))

    def sharding(self, key: str = "doc_id") -> Sharding:
        """Rows, sizes and directory as found in the files."""
        shard = F.col(self.column)
        rows = self.read().select(F.col(key).alias("key"), _n_bytes(), shard.alias("shard"), F.length(shard).alias("depth"))
        return Sharding(rows, _sizes(rows))


#: Begins the name of a shard in folder names, which cannot be empty.
MARK = "b"


def write_shards(
    docs: DataFrame, limit: int, key: str = "doc_id", spare_bits: int = 4, folder: str | None = None
) -> ShardFiles:
    """Write the documents by shard, one file each, to ``folder`` (by default one in the shared folder).

    Texts are shuffled once. Only rows whose key alone exceeds the limit are copied first, with a number
    that tells them apart; a lost executor then cannot change it.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    addressed = docs.select(
        F.col(key).alias("key"), _n_bytes(), key_bits(F.col(key)).alias("bits"), F.struct("*").alias("doc")
    )
    rows = stage(addressed.select("n_bytes", "bits"), "shard-rows")
    levels = _levels(rows, limit, 0, _first_bits(rows, limit, spare_bits), KEY_BITS, spare_bits * 2)
    placed = _placed(addressed, levels)
    bits, last = levels[-1]
    if bits == KEY_BITS and last.where("depth is null").limit(1).count():
        large = last.where("depth is null").select(F.col("cell").alias("bits"))
        numbered = addressed.join(large, "bits", "left_semi").withColumn("bits", F.concat("bits", _row_bits()))
        numbered = stage(numbered.select(*addressed.columns), "shard-large-keys")
        parts = _levels(numbered.select("n_bytes", "bits"), limit, KEY_BITS + 1, KEY_BITS + spare_bits, ALL_BITS, spare_bits * 2)
        placed = placed.where("depth is not null").unionByName(_placed(numbered, parts))
    column, taken = "shard", {c.lower() for c in docs.columns}
    while column in taken:
        column = f"_{column}"
    moved = placed.select("doc.*", F.concat(F.lit(MARK), "shard").alias(column))
    moved.repartition(column).write.partitionBy(column).parquet(folder)
    schema = StructType([*docs.schema.fields]).add(column, StringType())
    return ShardFiles(spark, folder, schema, column)
