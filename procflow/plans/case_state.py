"""Milestones of a growing log: a mergeable state per case, in buckets, with committed versions.

The state has one row per case: the time of each step so far, the smallest segment keys, the closing
time. All of these are minima or maxima, so a later batch of events is combined with them and gives
what all events together would give, in whatever order the batches come and however often one is
repeated. Cases lie in buckets by a hash of their id. A batch reads the buckets that hold its cases,
writes these anew, and leaves all others as they are.

Each write goes to a folder of its own with a name never used before. A last, single small file
records which folder holds each bucket; a version counts once that file is there. A run that breaks off
leaves folders that no version names, and the next run starts from the last version. One writer at a
time; readers keep the version they opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.constants import P2P_STEPS, SEGMENTS, Params, Segment, Step, ts_col
from procflow.plans.model import CaseModel, case_rows, finished_cases
from procflow.sources.staging import COMPRESSION, small_tasks, stage
from procflow.sources.star import Star

BUCKET = "bucket"
_LOG = "versions"
#: Files that a task holds open; with rows of more buckets it sorts the rest.
MOST_WRITERS = 32


@dataclass(frozen=True)
class CaseState:
    """The cases below ``folder`` as of one version; ``add`` returns the next one."""

    spark: SparkSession
    folder: str
    buckets: int
    steps: tuple[Step, ...] = P2P_STEPS
    segments: tuple[Segment, ...] = SEGMENTS
    collation: str | None = None
    version: int = 0
    #: Folder of each bucket that has cases.
    places: tuple[tuple[int, str], ...] = ()

    @classmethod
    def create(cls, spark: SparkSession, folder: str, buckets: int = 64, **more) -> CaseState:
        """An empty state; ``buckets`` is fixed from then on. The folder must not hold one yet."""
        state = cls(spark, folder.rstrip("/"), buckets, **more)
        state._commit("errorifexists")
        return state

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str, **more) -> CaseState:
        """The last committed version; steps, segments and collation are those it was created with."""
        base = folder.rstrip("/")
        log = spark.read.parquet(f"{base}/{_LOG}")
        newest = log.agg(F.max("version")).first()[0]
        rows = log.filter(F.col("version") == newest).collect()
        places = tuple(sorted((r[BUCKET], r["place"]) for r in rows if r["place"] is not None))
        return cls(spark, base, rows[0]["buckets"], version=newest, places=places, **more)

    def _commit(self, mode: str = "append") -> None:
        """One file, so a version is there whole or not at all."""
        rows = ", ".join(
            f"({self.version}, {self.buckets}, {bucket}, {'NULL' if place is None else repr(place)})"
            for bucket, place in self.places or ((-1, None),)
        )
        columns = f"version, buckets, {BUCKET}, place"
        listed = self.spark.sql(f"SELECT version, buckets, {BUCKET}, CAST(place AS STRING) place FROM VALUES {rows} AS t({columns})")
        listed.coalesce(1).write.mode(mode).parquet(f"{self.folder}/{_LOG}")

    def _columns(self, batch: DataFrame) -> list[Column]:
        """How each column of two states of one case is combined."""
        least = {s.column for s in self.segments} | {ts_col(s.name) for s in self.steps if s.pick == "first"}
        values = [c for c in batch.columns if c not in ("Case_ID", BUCKET)]
        return [(F.min if c in least else F.max)(c).alias(c) for c in values]

    def _read(self, places: Sequence[tuple[int, str]]) -> DataFrame | None:
        paths = [f"{self.folder}/{place}/{BUCKET}={bucket}" for bucket, place in places]
        if not paths:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def add(self, star: Star) -> CaseState:
        """Take in the events, case attributes and core milestones of a batch; commits a new version."""
        about, aggregates = case_rows(star, self.collation, self.steps, self.segments)
        cases = about.groupBy(F.col("case_id").alias("Case_ID")).agg(*aggregates)
        bucket = F.pmod(F.xxhash64("Case_ID"), F.lit(self.buckets)).cast("int")
        batch = stage(cases.withColumn(BUCKET, bucket), "case-batch")
        # At most ``buckets`` numbers.
        touched = {r[BUCKET] for r in batch.select(BUCKET).distinct().collect()}
        if not touched:
            return self
        held = self._read([(b, p) for b, p in self.places if b in touched])
        merged = batch.drop(BUCKET)
        if held is not None:
            merged = merged.unionByName(held, allowMissingColumns=True)
        # One shuffle for the merge and the files: ranges hold equal cases and few buckets each, so there are
        # about as many files as reducers and buckets together, and no task holds a bucket whole.
        merged = merged.withColumn(BUCKET, bucket).repartitionByRange(BUCKET, "Case_ID")
        if held is not None:
            merged = merged.groupBy(BUCKET, "Case_ID").agg(*self._columns(merged)).select(*merged.columns)
        place = f"cases-{uuid.uuid4().hex}"
        written = merged.write.option("compression", COMPRESSION).partitionBy(BUCKET)
        with small_tasks(self.spark, writers=min(self.buckets, MOST_WRITERS)):
            written.parquet(f"{self.folder}/{place}")
        places = {**dict(self.places), **dict.fromkeys(touched, place)}
        grown = replace(self, version=self.version + 1, places=tuple(sorted(places.items())))
        grown._commit()
        return grown

    def cases(self) -> DataFrame:
        """The case table of ``plans.model.case_table`` over all batches."""
        held = self._read(self.places)
        if held is None:
            raise ValueError(f"no batch was added to {self.folder}")
        return finished_cases(held, self.steps, self.segments)

    def milestones(self, required: Sequence[str] = ("PO",)) -> DataFrame:
        """One row per case with the time of each step, as ``operators.milestones.milestones``."""
        reached = self.cases()
        for name in required:
            reached = reached.filter(F.col(ts_col(name)).isNotNull())
        return reached.select("Case_ID", *[ts_col(s.name) for s in self.steps])

    def model(self, dim_spend_area: DataFrame | None = None, params: Params = Params()) -> CaseModel:
        """All reports over the state. The as-of date is the latest first step of all batches."""
        cases = self.cases()
        as_of = stage(cases.agg(F.max(ts_col(self.steps[0].name)).alias("As_of_Date")), "as_of")
        return CaseModel(cases, as_of, dim_spend_area, params, self.steps, self.segments)
