"""Writing report results for further use."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "json", "orc")


def _writer_options(fmt: str) -> dict[str, str]:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}: use one of {', '.join(FORMATS)}")
    return {"header": "true"} if fmt == "csv" else {}


def write_outputs(
    results: Mapping[str, DataFrame],
    folder: str,
    fmt: str = "parquet",
    single_file: Iterable[str] = (),
) -> dict[str, str]:
    """Write each result to ``folder/<name>`` and return the paths.

    Names in ``single_file`` are reports of a few rows, written as one file for spreadsheets (the
    write alone runs in one task); all others keep the partitioning Spark computed them in.
    """
    options, paths, single = _writer_options(fmt), {}, set(single_file)
    for name, df in results.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        out = df.repartition(1) if name in single else df
        out.write.mode("overwrite").format(fmt).options(**options).save(paths[name])
    return paths


#: Below a publication folder: which versions are complete, and where they lie.
_PUBLISHED = "published"


def publish_outputs(
    results: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", single_file: Iterable[str] = ()
) -> dict[str, str]:
    """Write a set of results that replaces the one before as a whole; returns its paths.

    Every run writes to a folder of its own. A last, single small file then names it as the current
    version: readers find either the whole old set or the whole new one, and a run that fails
    leaves the old set as it was. Older versions stay until they are deleted. One writer at a time.
    """
    base = folder.rstrip("/")
    spark = next(iter(results.values())).sparkSession
    # Listing only: an earlier set may be absent.
    newest = _newest(spark, base)
    version = 1 if newest is None else newest[0] + 1
    place = f"version-{version:06d}-{uuid.uuid4().hex}"
    paths = write_outputs(results, f"{base}/{place}", fmt, single_file)
    rows = ", ".join(f"({version}, '{place}', '{name}', '{fmt}')" for name in results)
    listed = spark.sql(f"SELECT * FROM VALUES {rows} AS t(version, place, name, format)")
    listed.coalesce(1).write.mode("append").parquet(f"{base}/{_PUBLISHED}")
    return paths


def _newest(spark: SparkSession, base: str) -> tuple[int, list] | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{_PUBLISHED}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    log = spark.read.parquet(f"{base}/{_PUBLISHED}")
    version = log.agg(F.max("version")).first()[0]
    # One row per result of the set.
    return version, log.filter(F.col("version") == version).collect()


def published(spark: SparkSession, folder: str) -> dict[str, tuple[str, str]]:
    """Path and format of each result of the current version."""
    base = folder.rstrip("/")
    newest = _newest(spark, base)
    if newest is None:
        raise ValueError(f"nothing has been published to {folder}")
    return {r["name"]: (f"{base}/{r['place']}/{r['name']}", r["format"]) for r in newest[1]}


def read_output(spark: SparkSession, path: str, like: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Read back a written result with the column types of ``like``."""
    return spark.read.schema(like.schema).format(fmt).options(**_writer_options(fmt)).load(path)
