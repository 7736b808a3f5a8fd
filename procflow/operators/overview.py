"""SLA view: closed lead times and open-case ages, their risk classes and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procflow.constants import (
    BUCKET_EDGES,
    CLOSED,
    LEVELS,
    OPEN,
    RISK_STATUSES,
    TREND_STATUSES,
    Params,
)
from procflow.functions.classify import (
    bucket_labels,
    duration_bucket,
    position,
    risk_status,
    trend_status,
)
from procflow.functions.dates import day_of, day_span, months_before, period_label
from procflow.functions.numeric import clean_double, ratio
from procflow.functions.percentiles import histogram, percentiles
from procflow.functions.rows import COUNT, cases, cases_if, counted, report_rows


def case_overview(spans: DataFrame, as_of: Column, snapshot: bool = False) -> DataFrame:
    """Duration of each case: start to end when closed, start to ``as_of`` while open.

    ``spans`` has ``Case_ID, Start_Time, End_Time`` and may have ``Start_Day, End_Day``; a case is
    closed when it has an end. By default an end after ``as_of`` counts too; ``snapshot=True``
    treats such a case as open. ``Start_Day`` is carried along for the operators that follow.
    """
    end, end_day = F.col("End_Time"), day_of(spans, "End_Time", "End_Day")
    if snapshot:
        known = F.col("End_Time") <= as_of
        end, end_day = F.when(known, end), F.when(known, end_day)
    start_day = day_of(spans, "Start_Time", "Start_Day")
    return spans.select(
        "Case_ID",
        "Start_Time",
        end.alias("End_Time"),
        day_span(start_day, F.coalesce(end_day, as_of.cast("date"))).alias("Duration_Days"),
        F.when(end_day.isNotNull(), CLOSED).otherwise(OPEN).alias("Duration_Type"),
        start_day.alias("Start_Day"),
    )


def without_start_day(overview: DataFrame) -> DataFrame:
    """``overview`` without the day column that repeats its start time."""
    return overview.drop("Start_Day")


def counted_overview(overview: DataFrame, since: Column) -> DataFrame:
    """``overview`` counted per start day, type and duration: as many rows as the calendar allows.

    All reports below take this table in place of the cases. They tell days apart, but for one moment:
    those that look back to ``since`` leave out cases started earlier on the day it lies in. The cases
    after it are therefore counted apart, and each row has the latest start of its cases.
    """
    day = day_of(overview, "Start_Time", "Start_Day").alias("Start_Day")
    after = (F.col("Start_Time") > since).alias("_after")
    counts = overview.groupBy(day, after, "Duration_Type", "Duration_Days").agg(
        F.max("Start_Time").alias("Start_Time"), cases(overview).alias(COUNT)
    )
    return counts.drop("_after")


def case_classification(
    overview: DataFrame,
    start: Column,
    edges: Sequence[int] = BUCKET_EDGES,
    labels: Sequence[str] = RISK_STATUSES,
) -> DataFrame:
    """Cases started on or after the day ``start`` with their duration bucket and risk status.

    ``labels`` names the statuses: one per edge and one for durations above the last edge. A counted
    overview keeps its counts and has no case ids.
    """
    days = F.col("Duration_Days")
    return overview.filter(day_of(overview, "Start_Time", "Start_Day") >= start).select(
        *(counted(overview) or ["Case_ID"]),
        "Start_Time",
        "Duration_Days",
        "Duration_Type",
        duration_bucket(days, edges).alias("Distribution_Buckets"),
        risk_status(days, edges, labels).alias("Risk_Status"),
    )


def with_share(counts: DataFrame, within: Sequence[str]) -> DataFrame:
    """Add ``Ratio``: the percentage of ``Amount`` in its ``within`` group."""
    whole = F.sum("Amount").over(Window.partitionBy(*within))
    return counts.withColumn("Ratio", ratio(F.col("Amount"), whole))


def share_of(df: DataFrame, keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Rows per ``keys`` as ``Amount`` and their percentage of the ``within`` group as ``Ratio``.

    The window runs over the counts, one row per key combination, never over the cases. The keys
    are classes and periods, so the counts are few.
    """
    counts = df.groupBy(*keys).agg(cases(df).alias("Amount"))
    return with_share(report_rows(counts), within)


def sla_distribution(
    classified: DataFrame, edges: Sequence[int] = BUCKET_EDGES
) -> DataFrame:
    """Cases per duration bucket, within closed and open cases."""
    keys = ["Duration_Type", "Distribution_Buckets", "Risk_Status"]
    return share_of(classified, keys, ["Duration_Type"]).orderBy(
        F.col("Duration_Type").desc(),
        position(F.col("Distribution_Buckets"), bucket_labels(edges)),
    )


def sla_trend(
    overview: DataFrame,
    kind: str,
    period: str = "month",
    since: Column | None = None,
    params: Params = Params(),
) -> DataFrame:
    """Risk mix per start period for closed (``"Lead Time"``) or open (``"Age days"``) cases.

    ``since`` keeps cases started strictly after that moment; the condition on the day is implied
    and lets the scan skip earlier ones. Monthly trends cover all history.

    Cases are counted per start day, and only the days are formatted and added up to periods.
    """
    day = day_of(overview, "Start_Time", "Start_Day")
    chosen = overview.filter(F.col("Duration_Type") == kind)
    if since is not None:
        chosen = chosen.filter((day >= since.cast("date")) & (F.col("Start_Time") > since))
    status = trend_status(F.col("Duration_Days"), params.target_days, params.watch_days)
    daily = chosen.groupBy(day.alias("_day"), status.alias("Risk_Status")).agg(
        cases(chosen).alias("_cases")
    )
    label = period_label(F.col("_day"), period, params.iso_year)
    counts = (
        report_rows(daily)
        .groupBy(
            label.alias("Time_Period"), F.lit(kind).alias("Cases_Status"), F.col("Risk_Status")
        )
        .agg(F.sum("_cases").alias("Amount"))
    )
    return with_share(counts, ["Time_Period"]).orderBy(
        F.col("Time_Period").desc(), position(F.col("Risk_Status"), TREND_STATUSES)
    )


def trend_cutoff(as_of: Column, months: int = 3) -> Column:
    """Moment after which the weekly trends start; keeps the time of day of ``as_of``."""
    return months_before(as_of, months)


def backlog_total(classified: DataFrame) -> DataFrame:
    """One row: open cases in the analysis window."""
    opened = cases_if(F.col("Duration_Type") == OPEN, classified)
    return classified.agg(opened.alias("Total_Number_Of_Open_Cases"))


def backlog_aged_share(classified: DataFrame, aged_days: int = 90) -> DataFrame:
    """Open cases older than ``aged_days`` and their percentage of all open cases.

    No row when there is no such case.
    """
    aged = cases_if(F.col("Duration_Days") > aged_days, classified)
    return (
        classified.filter(F.col("Duration_Type") == OPEN)
        .groupBy(F.col("Duration_Type").alias("Backlog"))
        .agg(aged.alias("Amount"), cases(classified).alias("_open"))
        .filter(F.col("Amount") > 0)
        .select("Backlog", "Amount", ratio(F.col("Amount"), F.col("_open")).alias("Ratio"))
    )


def backlog_aged_overview(
    classified: DataFrame, aged_days: int = 90, edges: Sequence[int] = BUCKET_EDGES
) -> DataFrame:
    """Aged open cases per bucket: number, whole-day average age, percentage of all open cases.

    One pass: every open case is counted per bucket, so the counts also give the total.
    """
    is_aged = F.col("Duration_Days") > aged_days
    days = F.col("Duration_Days")
    for count in counted(classified):
        days = days * F.col(count)
    counts = (
        classified.filter(F.col("Duration_Type") == OPEN)
        .groupBy("Duration_Type", "Distribution_Buckets", "Risk_Status")
        .agg(
            cases_if(is_aged, classified).alias("Amount"),
            F.sum(F.when(is_aged, days)).alias("_days"),
            cases(classified).alias("_open"),
        )
    )
    total = F.sum("_open").over(Window.partitionBy("Duration_Type"))
    return (
        report_rows(counts)
        .withColumn("_total", total)
        .filter(F.col("Amount") > 0)
        .select(
            "Duration_Type",
            "Distribution_Buckets",
            "Risk_Status",
            "Amount",
            F.call_function("div", "_days", "Amount").cast("int").alias("Avg_Duration_Days"),
            ratio(F.col("Amount"), F.col("_total")).alias("Ratio"),
        )
        .orderBy(position(F.col("Distribution_Buckets"), bucket_labels(edges)))
    )


def sla_duration_percentiles(
    classified: DataFrame, target_days: int = 75, levels: Sequence[tuple[str, float]] = LEVELS
) -> DataFrame:
    """Percentiles of the durations up to and above the target.

    The rows are named after lead times, but ages of open cases count as well: the split is on
    the duration only.
    """
    labels = [f"Lead Time <= {target_days} days", f"Lead Time > {target_days} days"]
    stage = F.when(F.col("Duration_Days") <= target_days, labels[0]).otherwise(labels[1])
    hist = histogram(
        classified.select(stage.alias("Stage"), "Duration_Days", *counted(classified)),
        "Stage",
        "Duration_Days",
    )
    out = percentiles(hist, ["Stage"], "Duration_Days", dict(levels))
    return report_rows(out).select(
        "Stage", *[clean_double(F.col(c)).alias(c) for c, _ in levels]
    ).orderBy(position(F.col("Stage"), labels))
