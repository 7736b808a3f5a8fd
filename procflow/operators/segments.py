"""Segment view: which vendors, spend areas and companies hold the delayed cases, and where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procflow.constants import LEVELS, P2P_STEPS, SEGMENTS, Segment, Step, day_col, ts_col
from procflow.functions.classify import delay_flag
from procflow.functions.dates import day_span, step_day
from procflow.functions.numeric import ratio, to_int, to_percent
from procflow.functions.ordered import By, dense_ranks, ranged_sum
from procflow.functions.percentiles import COUNT, histogram, percentiles, selected_percentiles
from procflow.functions.rows import cases as case_count
from procflow.functions.rows import cases_if, report_rows
from procflow.operators.stages import (
    share_histogram,
    stage_days,
    stage_position,
    stage_rows,
    valid_above,
)


def delay_base(
    cases: DataFrame,
    start: Column,
    threshold: int = 75,
    steps: Sequence[Step] = P2P_STEPS,
    segments: Sequence[Segment] = SEGMENTS,
) -> DataFrame:
    """Closed cases started on or after ``start`` with lead time, delay flag and segment keys.

    ``cases`` has the milestones and the segment keys (see ``plans.model.case_table``). Negative
    lead times stay in, with flag 0.
    """
    first, last = steps[0].name, steps[-1].name
    begin, end = step_day(cases, first), step_day(cases, last)
    lead = day_span(begin, end)
    return cases.filter((begin >= start) & end.isNotNull()).select(
        "Case_ID",
        ts_col(first),
        ts_col(last),
        lead.alias("Lead_Time"),
        delay_flag(lead, threshold).alias("Delay_Flag"),
        *[F.col(s.column).alias(s.key) for s in segments],
    )


def segment_counts(base: DataFrame, segment: Segment) -> DataFrame:
    """Cases and delayed cases per segment key; cases without a segment form one row."""
    return base.groupBy(segment.key).agg(
        case_count().alias("Total_cases"), cases_if(F.col("Delay_Flag") == 1).alias("_delayed")
    )


def total_delayed(counts: DataFrame) -> Column:
    """Delayed cases of all segments together, as a scalar subquery.

    Every segment has a case, so the filter keeps them all. It keeps the case count in the plan:
    the subquery then needs exactly the shuffle the ranking needs, and Spark runs it once
    instead of scanning the cases a second time.
    """
    return counts.filter(F.col("Total_cases") > 0).agg(F.sum("_delayed").alias("n")).scalar()


def segment_rates(base: DataFrame, segment: Segment, min_cases: int = 100) -> DataFrame:
    """Cases, delayed cases, delay rate and share of all delays per segment of enough cases.

    The share is of *all* delayed cases, those of small segments and without a segment included.
    Cases without a segment form a row of their own whose delayed cases count as 0.
    """
    key = F.col(segment.key)
    counts = segment_counts(base, segment)
    known = F.when(key.isNull(), F.lit(0)).otherwise(F.col("_delayed"))
    kept = counts.filter(F.col("Total_cases") >= min_cases).select(
        key, "Total_cases", known.alias("Delay_cases")
    )
    delay = F.col("Delay_cases")
    return kept.select(
        "*",
        ratio(delay, F.col("Total_cases")).alias("Delayed_Rate"),
        ratio(delay, total_delayed(counts)).alias("Impact_Share"),
    )


# Rank order: impact, then rate, then delayed cases. Impact and rate are percentages of two
# decimals. At most 20,000 segments can hold 0.005% or more of all delayed cases, and a segment
# below that has impact 0.00 and one of 10,001 rates: so there are at most 30,001 (impact, rate)
# pairs however many segments there are. They are the coarse part of the order.
_COARSE = [By("Impact_Share", descending=True), By("Delayed_Rate", descending=True)]
_FINE = [By("Delay_cases", descending=True)]


def segment_ranking(base: DataFrame, segment: Segment, min_cases: int = 100) -> DataFrame:
    """Segments of at least ``min_cases`` cases with their dense rank by impact."""
    rates = segment_rates(base, segment, min_cases)
    return dense_ranks(rates, _COARSE, _FINE, segment.rank)


def in_rank_order(ranking: DataFrame, segment: Segment) -> DataFrame:
    return ranking.orderBy(segment.rank, F.col(segment.key).asc_nulls_last())


def top_segments(
    base: DataFrame, segment: Segment, top: int, min_cases: int = 100
) -> DataFrame:
    """The first ``top`` segments by rank (ties at the cut: smaller key first), with their rank.

    Selecting before ranking needs no ranking of the other segments: within the first rows of
    the rank order the dense rank is the same as over all of them.
    """
    rates = segment_rates(base, segment, min_cases)
    order = [b.column for b in (*_COARSE, *_FINE)]
    first = rates.orderBy(*order, F.col(segment.key).asc_nulls_last()).limit(top)
    return first.withColumn(segment.rank, F.dense_rank().over(Window.orderBy(*order)))


def segment_base(
    cases: DataFrame,
    top: DataFrame,
    segment: Segment,
    start: Column,
    extra: Sequence[str] = (),
    steps: Sequence[Step] = P2P_STEPS,
) -> DataFrame:
    """Complete cases (every milestone, first on or after ``start``) of the segments in ``top``.

    ``extra`` names columns of ``top`` to carry along. ``top`` has at most as many rows as its
    limit, so it is broadcast: a segment with a third of all cases is never shuffled by its key.
    """
    days = [day_col(s.name) for s in steps]
    keyed = cases.filter(step_day(cases, steps[0].name) >= start).select(
        "Case_ID",
        F.col(segment.column).alias(segment.key),
        *[step_day(cases, s.name).alias(d) for s, d in zip(steps, days)],
    )
    chosen = F.broadcast(top.select(segment.key, segment.rank, *extra))
    return stage_days(keyed.dropna(subset=days).join(chosen, segment.key), steps).drop(*days)


def segment_duration(
    seg_base: DataFrame,
    segment: Segment,
    extra: Sequence[str] = (),
    threshold: int = 75,
    steps: Sequence[Step] = P2P_STEPS,
    levels: Sequence[tuple[str, float]] = LEVELS,
) -> DataFrame:
    """Percentiles of the days per stage and segment, on-time and delayed cases apart.

    ``Cases_Number`` counts the segment's cases with a valid value for the stage, both groups
    together.
    """
    ids = [segment.key, segment.rank, *extra]
    flagged = seg_base.withColumn("Delay_flag", delay_flag(F.col("Lead_Time"), threshold))
    rows = stage_rows(flagged, [*ids, "Delay_flag"], steps).filter(F.col("Days") >= 0)
    keys = ["Stage", *ids, "Delay_flag"]
    groups = percentiles(histogram(rows, *keys, "Days"), keys, "Days", dict(levels))
    both = F.sum(COUNT).over(Window.partitionBy("Stage", segment.key))
    return report_rows(groups).select(
        *keys,
        both.alias("Cases_Number"),
        *[to_int(F.col(c)).alias(c) for c, _ in levels],
    ).orderBy(segment.rank, stage_position(steps=steps), segment.key, "Delay_flag")


def segment_bottleneck(
    seg_base: DataFrame,
    segment: Segment,
    extra: Sequence[str] = (),
    threshold: int = 75,
    steps: Sequence[Step] = P2P_STEPS,
) -> DataFrame:
    """Median percentage of the lead time per stage and segment, over delayed valid cases.

    Shares are not rounded, so a segment can have as many distinct ones as cases: the median is
    selected by rank.
    """
    ids = [segment.key, segment.rank, *extra]
    hist = share_histogram(seg_base.filter(valid_above(threshold, steps)), ids, None, steps)
    out = selected_percentiles(hist, ["Stage", *ids], "Share", {"_median": 0.5})
    return report_rows(out).select(
        "Stage",
        *ids,
        F.col(COUNT).alias("Cases_Number"),
        to_percent(F.col("_median")).alias("Median_Bottleneck"),
    ).orderBy(segment.rank, stage_position(steps=steps), segment.key)


def pareto(ranking: DataFrame, segment: Segment, delayed: Column) -> DataFrame:
    """Add the running number of delayed cases in rank order and its share of all ``delayed``.

    The ranking is computed here, into the shared folder, in ranges of its order.
    """
    order = [*_COARSE, *_FINE, By(segment.key)]
    counted = ranking.withColumn("_delayed", delayed)
    summed = ranged_sum(counted, "Delay_cases", order, "Cumulative_Delay_cases")
    share = ratio(F.col("Cumulative_Delay_cases"), F.col("_delayed"))
    return summed.withColumn("Cumulative_Share", share).drop("_delayed")
