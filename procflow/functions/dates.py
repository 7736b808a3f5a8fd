"""Calendar expressions over zone-free timestamps (``TIMESTAMP_NTZ``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procflow.constants import day_col, ts_col


def day_of(df: DataFrame, time: str, day: str) -> Column:
    """The day of a moment: column ``day`` where ``df`` has it, else derived from ``time``.

    Staged tables carry days next to times. A DATE is half as wide, compresses to its few
    distinct values, and a condition on it skips row groups and pages of a Parquet file, which
    Spark does not do for zone-free timestamps.
    """
    return F.col(day) if day in df.columns else F.col(time).cast("date")


def step_day(df: DataFrame, step: str) -> Column:
    """The day a step was reached, NULL when it was not."""
    return day_of(df, ts_col(step), day_col(step))


def day_span(start: Column, end: Column) -> Column:
    """Calendar-day boundaries crossed from ``start`` to ``end``; NULL when either is NULL.

    23:59 to 00:01 of the next day is 1, so the two-argument ``datediff`` is needed: the
    three-argument SQL form counts whole 24-hour spans.
    """
    return F.datediff(end, start)


def months_before(ts: Column, months: int) -> Column:
    """``ts`` moved back by calendar months; clips to the month end and keeps the time of day."""
    return ts - F.make_ym_interval(F.lit(0), F.lit(months))


def first_of_month(ts: Column, months_back: int) -> Column:
    """First day (DATE) of the month ``months_back`` months before ``ts``."""
    return F.trunc(F.add_months(ts.cast("date"), -months_back), "MM")


def period_label(ts: Column, period: str = "month", iso_year: bool = False) -> Column:
    """``YYYY-MM`` (``"month"``) or ``YYYY-WW`` (``"iso_week"``).

    Weeks pair the ISO week number with the *calendar* year by default, so 2018-12-31 is
    ``2018-01``; ``iso_year=True`` pairs it with the ISO year (``2019-01``).
    """
    if period == "month":
        return F.date_format(ts, "yyyy-MM")
    if period == "iso_week":
        year = F.extract(F.lit("YEAROFWEEK"), ts) if iso_year else F.year(ts)
        week = F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
        return F.concat_ws("-", year.cast("string"), week)
    raise ValueError(f"unknown period {period!r}: use 'month' or 'iso_week'")
