"""Reading a flat event log from files: any column names, any time format."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from procflow.sources.schema import event_log_schema
from procflow.sources.staging import COMPRESSION, small_tasks


def read_log(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    columns: Mapping[str, str] | None = None,
    timestamp_format: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """The log at ``path`` with the columns of the declared event log, as far as the files have them.

    ``columns`` maps names of the declared log (``case_id``, ``activity``, ``timestamp``, ...) to
    those of the files; names of the files that it does not mention keep theirs and are read too,
    so that they can serve as attributes. Text times are read by ``timestamp_format`` (e.g.
    ``dd-MM-yyyy HH:mm``), or as ISO 8601 without one. A time that does not fit, or is missing, is
    NULL: such events mark no milestone. Case, activity and time must be there.
    """
    defaults = {"header": "true"} if fmt == "csv" else {}
    log = raw_log(spark, path, fmt, columns, options)
    return typed_log(log, timestamp_format)


def raw_log(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    columns: Mapping[str, str] | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """The log at ``path`` under the declared names, its times as they are in the files."""
    defaults = {"header": "true"} if fmt == "csv" else {}
    found = spark.read.format(fmt).options(**{**defaults, **(options or {})}).load(path)
    renamed = {theirs: ours for ours, theirs in (columns or {}).items()}
    log = found.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in found.columns])
    missing = {"case_id", "activity", "timestamp"} - set(log.columns)
    if missing:
        raise ValueError(f"the log at {path} has no column for {', '.join(sorted(missing))}")
    return log


def typed_log(log: DataFrame, timestamp_format: str | None = None) -> DataFrame:
    """A raw log with the declared types."""
    typed = {
        f.name: F.col(f.name).cast(f.dataType)
        for f in event_log_schema()
        if f.name in log.columns and f.name != "timestamp"
    }
    moment = F.col("timestamp")
    if dict(log.dtypes)["timestamp"] == "string":
        moment = zone_free_time(moment, timestamp_format)
    return log.withColumns({**typed, "timestamp": moment.cast("timestamp_ntz")})


def zone_free_time(text: Column, timestamp_format: str | None = None) -> Column:
    """A text as a time without zone, NULL if it cannot be read.

    Never a zoned time in between: an hour that the session's zone skips in spring stays as it is.
    """
    if timestamp_format is None:
        return text.try_cast("timestamp_ntz")
    fmt = F.lit(timestamp_format)
    readable = F.call_function("try_to_timestamp", text, fmt).isNotNull()
    return F.when(readable, F.to_timestamp_ntz(text, fmt))


#: What becomes of a row of a log: its reason, by the first that holds.
KEPT = "kept"
NO_CASE, NO_ACTIVITY, NO_TIME, BAD_TIME = "no case", "no activity", "no time", "unreadable time"


@dataclass(frozen=True)
class CheckedLog:
    """A log sorted into rows that can be used and rows that cannot, both written."""

    folder: str
    kept: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        """(reason, rows): how many rows were kept, and rejected for which reason."""
        every = self.kept.select(F.lit(KEPT).alias("reason")).unionAll(self.rejected.select("reason"))
        return every.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def check_log(log: DataFrame, folder: str, timestamp_format: str | None = None) -> CheckedLog:
    """Sort the rows of a raw log in one pass and write them, by reason, below ``folder``.

    Rejected are rows without a case, without an activity (a text of blanks is none), without a time,
    or with a time that cannot be read. ``kept`` has the declared types; ``rejected`` has the rows as
    they came, their time as text, and the reason.
    """
    typed = typed_log(log, timestamp_format)
    names = [c for c in typed.columns if c != "timestamp"]
    given = log.select(*names, F.col("timestamp").cast("string").alias("_given"), F.col("timestamp").alias("_raw"))
    moment = F.col("_raw")
    if dict(log.dtypes)["timestamp"] == "string":
        moment = zone_free_time(moment, timestamp_format)

    def blank(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""

    read = given.withColumn("timestamp", moment.cast("timestamp_ntz"))
    reason = (
        F.when(blank("case_id"), NO_CASE)
        .when(blank("activity"), NO_ACTIVITY)
        .when(blank("_given"), NO_TIME)
        .when(F.col("timestamp").isNull(), BAD_TIME)
        .otherwise(KEPT)
    )
    sorted_out = read.drop("_raw").withColumn("reason", reason)
    # A task writes all five folders side by side: sorting its rows by reason would spill a large log whole.
    with small_tasks(log.sparkSession, writers=5):
        sorted_out.write.option("compression", COMPRESSION).partitionBy("reason").parquet(folder)
    schema = StructType([*read.drop("_raw").schema.fields, StructField("reason", StringType())])
    rows = log.sparkSession.read.schema(schema).parquet(folder)
    kept = rows.filter(F.col("reason") == KEPT).select(*names, "timestamp")
    declared = {f.name: F.col(f.name).cast(f.dataType) for f in event_log_schema() if f.name in names}
    rejected = rows.filter(F.col("reason") != KEPT).select(*names, F.col("_given").alias("timestamp"), "reason")
    return CheckedLog(folder, kept.withColumns(declared).select(*log.columns), rejected)
