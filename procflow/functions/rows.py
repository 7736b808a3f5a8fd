"""Row-level helpers shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: In a counted table, the number of cases that a row stands for.
COUNT = "_n"


def counted(df: DataFrame) -> list[str]:
    """The count column of a counted table, nothing for a table with one row per case."""
    return [c for c in df.columns if c == COUNT]


def cases(df: DataFrame | None = None) -> Column:
    """Aggregate: number of cases. Case tables have one row per case and no case without an id, so
    this counts rows without reading the id column, the widest of the table. The rows of a counted
    table ``df`` stand for as many cases as their count says."""
    if df is None or not counted(df):
        return F.count(F.lit(1))
    return F.coalesce(F.sum(COUNT), F.lit(0))


def cases_if(condition: Column, df: DataFrame | None = None) -> Column:
    """Aggregate: number of cases for which ``condition`` holds."""
    if df is None or not counted(df):
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(COUNT))), F.lit(0))


def report_rows(df: DataFrame) -> DataFrame:
    """Bring the rows of a finished report into one partition.

    Only for aggregates whose size the calendar or a fixed list bounds (periods, buckets, stages).
    The window and the sort that follow then need no shuffle and no sampling job of their own.
    """
    return df.repartition(1)
