"""Intermediate tables written once to the cluster's shared folder.

A table that many reports read (one row per case) is written as Parquet, which cuts its lineage:
a lost executor costs a re-read, not a re-run of the log scan and its shuffle, and later
reports read only the columns they need.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

V = TypeVar("V")

#: Codec of the tables that are written here.
COMPRESSION = "zstd"

_local_folders: dict[str, str] = {}
_staged: dict[tuple[str, ...], tuple[SparkSession, tuple, object]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder in local mode.

    On a cluster without the setting there is no folder every executor can reach, and computing
    a table again for each report would cost a pass over the log each time: that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _local_folders:
        _local_folders[sc.applicationId] = tempfile.mkdtemp(prefix="procflow-")
    return _local_folders[sc.applicationId]


def staging_folder(spark: SparkSession) -> str:
    """Where this application's staged tables lie."""
    return f"{shared_folder(spark)}/procflow/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the staging folder that nothing uses yet."""
    return f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_staged(spark: SparkSession) -> None:
    """Delete every table this application has staged; models that read them end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    app = spark.sparkContext.applicationId
    for slot in [s for s in _staged if s[0] == app]:
        del _staged[slot]


@contextmanager
def reducers(spark: SparkSession, n: int | None) -> Iterator[None]:
    """Plan shuffles with ``n`` reducers inside the block; ``None`` keeps the session's number.

    Adaptive execution merges small reducers but never splits those of an aggregation, so a large
    log needs more of them than the default.
    """
    with _settings(spark, {} if n is None else {"spark.sql.shuffle.partitions": n}):
        yield


@contextmanager
def _settings(spark: SparkSession, values: Mapping[str, object]) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: Bytes of files that one task reads while a table is written, or one row group where that is larger.
TASK_BYTES = 16 << 20
_READ, _WRITERS = "spark.sql.files.maxPartitionBytes", "spark.sql.maxConcurrentOutputFileWriters"


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


@contextmanager
def small_tasks(spark: SparkSession, writers: int = 0) -> Iterator[None]:
    """Run what is written inside the block in tasks that read ``TASK_BYTES`` of files at most.

    Keys of a log are nearly unique per task (cases), so combining before a shuffle keeps about one entry
    per row read: a task over 128 MB of compressed columns outgrows its memory and writes
    all of it to disk first. Tasks of this size do not, however large the table. A smaller setting of the
    session stays. ``writers``: folders that a task may write side by side, without sorting its rows by
    them.
    """
    values = {_READ: min(TASK_BYTES, _bytes(spark.conf.get(_READ)))}
    with _settings(spark, {**values, _WRITERS: writers} if writers else values):
        yield


def stage(df: DataFrame, name: str, folders: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a scan of what was written.

    Rows are laid in folders by the columns ``folders``, which must be the last ones: a condition on
    them leaves out whole folders.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with small_tasks(spark):
        df.write.option("compression", COMPRESSION).partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Number, size, newest change and names of the files below ``path``; content is not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "modificationTime", "length")
    )
    row = files.agg(
        F.count(F.lit(1)),
        F.sum("length"),
        F.max("modificationTime").cast("string"),
        F.bit_xor(F.xxhash64("path", "modificationTime", "length")),
    ).first()
    return tuple(row)


def once_per_input(spark: SparkSession, path: str, name: str, build: Callable[[], V]) -> V:
    """``build()`` once per session and state of the files below ``path``.

    When a file is added, removed or rewritten, the next call builds again.
    """
    slot = (spark.sparkContext.applicationId, name, path)
    state = fingerprint(spark, path)
    held = _staged.get(slot)
    if held is None or held[0] is not spark or held[1] != state:
        held = _staged[slot] = (spark, state, build())
    return held[2]
