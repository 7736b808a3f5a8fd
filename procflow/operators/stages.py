"""Stage view: days between adjacent milestones, gaps in them, each stage's part of the whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procflow.constants import (
    ISSUE_ORDER,
    LEVELS,
    NORMAL,
    P2P_STEPS,
    Step,
    day_col,
    stage_cols,
    stage_pairs,
    ts_col,
)
from procflow.functions.classify import position
from procflow.functions.dates import day_span, step_day
from procflow.functions.numeric import clean_double, day_share, ratio, to_percent
from procflow.functions.percentiles import COUNT, histogram, percentile_of, percentiles
from procflow.functions.rows import cases, cases_if, report_rows


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def stage_days(ms: DataFrame, steps: Sequence[Step] = P2P_STEPS) -> DataFrame:
    """Add the days of every stage and ``Lead_Time`` (first to last step).

    A value is NULL when either end is missing and negative when the ends are out of order. The
    stages of a complete case add up to its lead time.
    """
    day = {s.name: step_day(ms, s.name) for s in steps}
    spans = [day_span(day[a], day[b]).alias(f"{a}_{b}_Days") for a, b in stage_pairs(steps)]
    lead = day_span(day[steps[0].name], day[steps[-1].name])
    return ms.select("*", *spans, lead.alias("Lead_Time"))


def stage_base(ms: DataFrame, start: Column, steps: Sequence[Step] = P2P_STEPS) -> DataFrame:
    """Open and closed cases whose first step is on or after the day ``start``, with stage days.

    The days of the steps are carried along for the operators that follow.
    """
    first = step_day(ms, steps[0].name)
    kept = ms.filter(first >= start).select(
        "Case_ID",
        *[ts_col(s.name) for s in steps],
        *[step_day(ms, s.name).alias(day_col(s.name)) for s in steps],
    )
    return stage_days(kept, steps)


def without_days(df: DataFrame, steps: Sequence[Step] = P2P_STEPS) -> DataFrame:
    """``df`` without the day columns that repeat its times."""
    return df.drop(*[day_col(s.name) for s in steps])


# Populations: named row conditions over a stage base.


def valid_stages(steps: Sequence[Step] = P2P_STEPS) -> Column:
    """Every stage present and not negative."""
    return _all([F.col(c) >= 0 for c in stage_cols(steps)])


def every_case() -> Column:
    return F.lit(True)


def lead_within(limit: int = 75) -> Column:
    """A lead time of 1 to ``limit`` days."""
    return (F.col("Lead_Time") <= limit) & (F.col("Lead_Time") > 0)


def lead_above(limit: int = 75) -> Column:
    """A lead time of more than ``limit`` days."""
    return F.col("Lead_Time") > limit


def valid_within(limit: int = 75, steps: Sequence[Step] = P2P_STEPS) -> Column:
    """Valid closed cases that took 1 to ``limit`` days."""
    return lead_within(limit) & valid_stages(steps)


def valid_above(limit: int = 75, steps: Sequence[Step] = P2P_STEPS) -> Column:
    """Valid closed cases that took more than ``limit`` days."""
    return lead_above(limit) & valid_stages(steps)


def stage_rows(
    sb: DataFrame, keep: Sequence[str], steps: Sequence[Step] = P2P_STEPS
) -> DataFrame:
    """One row per case and stage: ``keep`` columns, ``Stage``, ``Days`` (may be NULL)."""
    return sb.unpivot(list(keep), stage_cols(steps), "Stage", "Days")


def stage_position(stage: str = "Stage", steps: Sequence[Step] = P2P_STEPS) -> Column:
    return position(F.col(stage), stage_cols(steps))


def duration_profile(
    sb: DataFrame,
    population: Column,
    label: str = "Stage",
    steps: Sequence[Step] = P2P_STEPS,
    levels: Sequence[tuple[str, float]] = LEVELS,
) -> DataFrame:
    """Percentiles of the days per stage over a population; negative and missing stages left out.

    All stages in one pass. A stage without cases gives no row.
    """
    rows = stage_rows(sb.filter(population), [], steps).filter(F.col("Days") >= 0)
    return counted_durations(histogram(rows, "Stage", "Days"), every_case(), label, steps, levels)


def stage_counts(sb: DataFrame, steps: Sequence[Step] = P2P_STEPS) -> DataFrame:
    """Cases counted per ``Stage``, its ``Days`` and, for valid closed cases, their ``Lead_Time``.

    Stages that are missing or negative are left out. As many rows as the calendar allows; the
    duration and contribution profiles read nothing else.
    """
    lead = F.when(valid_stages(steps), F.col("Lead_Time"))
    rows = stage_rows(sb.withColumn("Lead_Time", lead), ["Lead_Time"], steps)
    return histogram(rows.filter(F.col("Days") >= 0), "Stage", "Days", "Lead_Time")


def counted_durations(
    counts: DataFrame,
    population: Column,
    label: str = "Stage",
    steps: Sequence[Step] = P2P_STEPS,
    levels: Sequence[tuple[str, float]] = LEVELS,
) -> DataFrame:
    """:func:`duration_profile` from :func:`stage_counts`; ``population`` is a condition on them."""
    out = percentiles(counts.filter(population), ["Stage"], "Days", dict(levels))
    return report_rows(out).select(
        F.col("Stage").alias(label),
        *[clean_double(F.col(c)).alias(c) for c, _ in levels],
    ).orderBy(stage_position(label, steps))


def stage_status(sb: DataFrame, steps: Sequence[Step] = P2P_STEPS) -> DataFrame:
    """Add ``<stage>_Status``: missing milestone, invalid order, or normal.

    A stage blames the earlier of its two milestones that is missing, so a gap shows in the stage
    after it as well.
    """
    out = []
    for i, (a, b) in enumerate(stage_pairs(steps)):
        start, end = step_day(sb, a), step_day(sb, b)
        status = F.when(end.isNull(), f"Missing_{b}")
        if i > 0:
            status = F.when(start.isNull(), f"Missing_{a}").when(end.isNull(), f"Missing_{b}")
        status = status.when(F.col(f"{a}_{b}_Days") < 0, f"Invalid_{a}_{b}").otherwise(NORMAL)
        out.append(status.alias(f"{a}_{b}_Status"))
    return sb.select("*", *out)


def primary_issue(flags: DataFrame, steps: Sequence[Step] = P2P_STEPS) -> DataFrame:
    """Add ``Primary_Issue``: the first status in process order that is not normal."""
    statuses = [F.col(f"{a}_{b}_Status") for a, b in stage_pairs(steps)]
    first = F.coalesce(*[F.when(s != NORMAL, s) for s in statuses], F.lit(NORMAL))
    return flags.withColumn("Primary_Issue", first)


def stage_flags(sb: DataFrame, steps: Sequence[Step] = P2P_STEPS) -> DataFrame:
    return primary_issue(stage_status(sb, steps), steps)


def flag_counts(flags: DataFrame, steps: Sequence[Step] = P2P_STEPS) -> DataFrame:
    """Cases counted per statuses and steps reached: a few dozen rows that stand for all cases.

    Each row has one of the days of its cases for every step that they reached.
    """
    statuses = [f"{a}_{b}_Status" for a, b in stage_pairs(steps)]
    reached = [step_day(flags, s.name).isNotNull().alias(f"_{s.name}") for s in steps]
    days = [F.min(step_day(flags, s.name)).alias(day_col(s.name)) for s in steps]
    counts = flags.groupBy(*statuses, "Primary_Issue", *reached).agg(*days, cases(flags).alias(COUNT))
    return counts.drop(*[f"_{s.name}" for s in steps])


def primary_issue_share(flags: DataFrame) -> DataFrame:
    """Cases per primary issue and their percentage of all cases; ``flags`` may be counted."""
    counts = flags.groupBy("Primary_Issue").agg(cases(flags).alias("Amount"))
    # One row per status: the whole-table window sees at most seven rows.
    total = F.sum("Amount").over(Window.partitionBy())
    return report_rows(counts).withColumn("Ratio", ratio(F.col("Amount"), total)).orderBy(
        position(F.col("Primary_Issue"), ISSUE_ORDER), "Primary_Issue"
    )


def local_missingness(flags: DataFrame, steps: Sequence[Step] = P2P_STEPS) -> DataFrame:
    """Per stage: cases whose end is missing, as a percentage of those that reached its start.

    All stages are counted in one pass over the cases; a status nobody has gives no row. ``flags`` may
    be counted.
    """
    aggs, rows = [], []
    for i, (a, b) in enumerate(stage_pairs(steps)):
        missing = f"Missing_{b}"
        hit = F.col(f"{a}_{b}_Status") == missing
        reached = F.lit(True) if i == 0 else step_day(flags, a).isNotNull()
        aggs += [
            cases_if(hit, flags).alias(f"_hit{i}"),
            cases_if(reached, flags).alias(f"_all{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(i).alias("_pos"),
                F.lit(missing).alias("Missing"),
                F.col(f"_hit{i}").alias("Amount"),
                ratio(F.col(f"_hit{i}"), F.col(f"_all{i}")).alias("Ratio"),
            )
        )
    return (
        flags.agg(*aggs)
        .select(F.inline(F.array(*rows)))
        .filter(F.col("Amount") > 0)
        .orderBy("_pos")
        .drop("_pos")
    )


def stage_share(
    sb: DataFrame, scale: int | None = 4, steps: Sequence[Step] = P2P_STEPS
) -> DataFrame:
    """Closed valid cases with each stage's percentage of the lead time (NULL at lead time 0)."""
    shares = [
        day_share(F.col(c), F.col("Lead_Time"), scale).alias(c.replace("_Days", "_Share"))
        for c in stage_cols(steps)
    ]
    closed = sb.filter(F.col("Lead_Time").isNotNull() & valid_stages(steps))
    return closed.select("Case_ID", "Lead_Time", *shares)


def share_histogram(
    sb: DataFrame, keys: Sequence[str], scale: int | None, steps: Sequence[Step] = P2P_STEPS
) -> DataFrame:
    """Histogram of stage shares per ``keys`` and stage over closed valid cases.

    The cases are counted per (days, lead time) on plain integers; the decimal share is then
    worked out once per pair instead of once per case and stage.
    """
    closed = sb.filter(F.col("Lead_Time").isNotNull() & valid_stages(steps))
    pairs = histogram(
        stage_rows(closed, [*keys, "Lead_Time"], steps), *keys, "Stage", "Lead_Time", "Days"
    )
    return _shares(pairs, keys, scale)


def _shares(pairs: DataFrame, keys: Sequence[str], scale: int | None) -> DataFrame:
    share = day_share(F.col("Days"), F.col("Lead_Time"), scale)
    return pairs.select(*keys, "Stage", share.alias("Share"), COUNT)


def contribution_profile(
    sb: DataFrame,
    population: Column,
    label: str = "Stage",
    scale: int | None = 4,
    steps: Sequence[Step] = P2P_STEPS,
) -> DataFrame:
    """Median percentage of the lead time spent in each stage, over closed valid cases."""
    return _median_shares(share_histogram(sb.filter(population), [], scale, steps), label, steps)


def counted_contribution(
    counts: DataFrame,
    population: Column,
    label: str = "Stage",
    scale: int | None = 4,
    steps: Sequence[Step] = P2P_STEPS,
) -> DataFrame:
    """:func:`contribution_profile` from :func:`stage_counts`; ``population`` is a condition on them."""
    closed = counts.filter(F.col("Lead_Time").isNotNull() & population)
    return _median_shares(_shares(closed, [], scale), label, steps)


def _median_shares(hist: DataFrame, label: str, steps: Sequence[Step]) -> DataFrame:
    median = hist.groupBy("Stage").agg(percentile_of("Share", 0.5).alias("_median"))
    return report_rows(median).select(
        F.col("Stage").alias(label), to_percent(F.col("_median")).alias("Median")
    ).orderBy(stage_position(label, steps))
