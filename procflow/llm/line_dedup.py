"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

The state is a set of runs, each a bucketed and sorted table (key, owner): the 128-bit hash of a
line key and the smallest doc_id that holds it. A new batch is reduced to its distinct keys with
their smallest document, which merge-anti-join the runs; what is left becomes a run of level 0.
Once a level holds ``fanout`` runs they are merged into one run of the next level. Buckets make a
batch the only thing that is shuffled: runs are read in key order as they lie.

A key is a line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lowered, of at least
``min_chars`` code points; shorter lines always stay. Batches must come in ascending order of
doc_id for the smallest document of all batches to keep a line.

Defined cases: a null or empty text is one empty line; rows without doc_id count as one document
after all others of their batch; rows that share a doc_id are one document, and each keeps its
lines if that document owns them; a line repeated inside its owner stays every time; an empty
table gives no rows; other columns are passed through, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.llm.common import id_or_last, new_folder

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
RUN_COLUMNS = "key BINARY, owner BIGINT"


def line_key(line: Column) -> Column:
    """Stripped line in lower case; only A-Z are lowered, so plain ASCII may take the fast way."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity() -> list[Column]:
    """What tells one document text from another, also without or with repeated doc_id."""
    return [id_or_last().alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")]


def keyed_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(_d, _h, pos, key) of every line long enough to have a key."""
    lines = docs.select(*_identity(), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("_d", "_h", "pos", line_key(F.col("line")).alias("line"))
    lines = lines.where(F.char_length("line") >= min_chars)
    return lines.select("_d", "_h", "pos", F.unhex(F.md5("line")).alias("key"))


def without_positions(lines: Column, gone: Column) -> Column:
    """``lines`` without the ascending positions ``gone``: the slices between them, joined."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))

    def piece(i: Column) -> Column:
        before, after = F.element_at(edges, i), F.element_at(edges, i + 1)
        return F.slice(lines, before + 2, after - before - 1)

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(gone) + 1), piece))


@dataclass
class LineRuns:
    """The levelled runs below ``folder``; ``LineRuns(spark, folder)`` reopens what is there."""

    spark: SparkSession
    folder: str
    fanout: int = 3
    buckets: int = 0
    min_chars: int = 10
    levels: list[list[str]] = field(default_factory=list)
    written: int = 0

    def __post_init__(self):
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str, fanout: int = 3, min_chars: int = 10) -> LineRuns:
        """The runs as of the last complete commit below ``folder``."""
        log = spark.read.parquet(f"{folder}/commits")
        newest = log.agg(F.max("version")).first()[0]
        rows = log.where(F.col("version") == newest).orderBy("level", "position").collect()
        runs = cls(spark, folder, fanout, rows[0]["buckets"], min_chars, written=newest)
        for row in rows:
            while len(runs.levels) <= row["level"]:
                runs.levels.append([])
            if row["run"] is not None:
                runs.levels[row["level"]].append(row["run"])
        return runs

    def _table(self, run: str) -> str:
        """The catalogue's name of a run; its folder is registered when it is not known yet."""
        # Of the whole path, so that runs of two folders never share a table.
        name = "line_run_" + hashlib.sha256(f"{self.folder}/{run}".encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({RUN_COLUMNS}) USING parquet CLUSTERED BY (key) "
            f"SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'"
        )
        return name

    def run(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run))

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame, level: int) -> str:
        self.written += 1
        # A name never used before: the folder of a run that broke off is not written to again.
        run = f"level{level}-{uuid.uuid4().hex}"
        writer = rows.select("key", "owner").write.format("parquet").mode("append")
        writer.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(self._table(run))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return run

    def _commit(self) -> None:
        """Record which runs count; runs of an add that broke off are in no record."""
        rows = ", ".join(
            f"({self.written}L, {level}, {i}, {f"'{run}'" if run else 'NULL'}, {self.buckets})"
            for level, runs in enumerate(self.levels)
            for i, run in enumerate(runs or [None])
        )
        columns = "version, level, position, run, buckets"
        log = self.spark.sql(f"SELECT version, level, position, CAST(run AS STRING) run, buckets FROM VALUES {rows} AS t({columns})")
        log.write.mode("append").parquet(f"{self.folder}/commits")

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                merged = self.run(old[0])
                for run in old[1:]:
                    merged = merged.unionAll(self.run(run))
                self._write(merged.repartition(self.buckets, "key"), level + 1)
            level += 1

    def ingest(self, docs: DataFrame) -> str:
        """Take in the keys of a batch that no run has; returns the new run."""
        fresh = keyed_lines(docs, self.min_chars).groupBy("key").agg(F.min("_d").alias("owner"))
        for run in self.runs():
            fresh = fresh.join(self.run(run).select("key"), "key", "left_anti")
        mine = self._write(fresh, 0)
        self._compact()
        self._commit()
        return mine

    def add(self, docs: DataFrame) -> DataFrame:
        """Take in a batch; returns it with ``lines`` (all), ``gone`` (dropped positions), ``kept``."""
        return self._cleaned(docs, self.run(self.ingest(docs)))

    def clean(self, docs: DataFrame) -> DataFrame:
        """The same for documents that are all in the runs: one pass, however many batches they came in."""
        held = [self.run(run) for run in self.runs()]
        return self._cleaned(docs, reduce(DataFrame.unionAll, held))

    def _cleaned(self, docs: DataFrame, mine: DataFrame) -> DataFrame:
        lines = keyed_lines(docs, self.min_chars)
        owned = mine.select("key", F.col("owner").alias("_d"))
        gone = lines.join(owned, ["key", "_d"], "left_anti").groupBy("_d", "_h")
        gone = gone.agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
        row = docs.select(*_identity(), F.struct("*").alias("row"))
        both = row.join(gone, ["_d", "_h"], "left").select(
            "row",
            split_lines(F.col("row.text")).alias("lines"),
            F.coalesce("_gone", F.array().cast("array<int>")).alias("gone"),
        )
        kept = F.when(F.size("gone") == 0, F.coalesce("row.text", F.lit(""))).otherwise(
            F.concat_ws("\n", without_positions(F.col("lines"), F.col("gone")))
        )
        return both.select("row", "lines", "gone", kept.alias("kept"))


def batches_by_id(docs: DataFrame, batches: int) -> list[DataFrame]:
    """``docs`` cut at doc_id quantiles into at most ``batches`` parts in ascending order.

    The cuts only balance the batches; any cuts give the same kept lines.
    """
    ids = docs.select(F.col("doc_id").cast("double").alias("id"))
    cuts = ids.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    d = id_or_last()
    edges = [None, *cuts, None]
    parts = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = docs
        if low is not None:
            part = part.where(d > low)
        if high is not None:
            part = part.where(d <= high)
        parts.append(part)
    return parts


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 3, min_chars: int = 10) -> DataFrame:
    """All of ``docs`` through fresh runs, batch by batch: (row, lines, gone, kept)."""
    spark = docs.sparkSession
    runs = LineRuns(spark, new_folder(spark, "line-runs"), fanout, min_chars=min_chars)
    for part in batches_by_id(docs, batches):
        runs.ingest(part)
    return runs.clean(docs)
