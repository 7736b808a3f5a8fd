"""Helpers shared by the operators: table reading, staging in the shared folder, checked broadcasts."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stands for a missing doc_id inside an operator: such rows come after all others.
NO_ID = 2**63 - 1
#: Tables of ids up to so many rows (8 bytes each) may be broadcast; larger ones are shuffled.
BROADCAST_IDS = 2_000_000
#: Whether Spark deletes the shuffle files of a query as soon as the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="procflow-llm-")
    return _local[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that does not exist yet, below this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_staged(spark: SparkSession) -> None:
    """Delete all that the operators staged in this application; results that read it end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside leave no shuffle files; otherwise these stay until the driver collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a scan: lineage and shuffle files end here."""
    path = new_folder(df.sparkSession, name)
    with _freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_or_last(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; a missing text is an empty one."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def carried_text(docs: DataFrame, carry: list[str]) -> bool:
    """Whether the rows that an operator carries hold the texts, as strings."""
    return "text" in carry and docs.columns.count("text") == 1 and docs.schema["text"].dataType == StringType()


def keep_ids(df: DataFrame, ids: DataFrame, key: str, most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the staged table ``ids``.

    The size of ``ids`` is counted first: up to ``most`` rows it is broadcast, so that ``df`` is
    filtered where it is read; a larger one takes part in a shuffle join. Same rows either way.
    """
    ids = ids.select(key).distinct()
    if ids.count() <= most:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def power_of_two(n: float, least: int = 1) -> int:
    """The smallest power of two that is at least ``n`` and ``least``."""
    return 1 << max(0, math.ceil(math.log2(max(n, least, 1))))
