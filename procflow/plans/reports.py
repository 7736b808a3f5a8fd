"""The reports: each a function of the case model, returning one result table.

Those of the SLA, backlog and bottleneck sections read the model's counted tables, which are written
at their first use; the others read the case table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procflow.constants import CLOSED, COMPANY, OPEN, SPEND_AREA, VENDOR, Segment
from procflow.operators import overview as ov
from procflow.operators import segments as sg
from procflow.operators import stages as st
from procflow.operators.quality import quality_check
from procflow.plans.model import CaseModel

Report = Callable[[CaseModel], DataFrame]

SPEND_TEXT = "Spend_area_sub"
SPEND_CLASS = "Spend_class"

# --- SLA and backlog


def sla_distribution(m: CaseModel) -> DataFrame:
    return ov.sla_distribution(m.classification_counts, m.params.bucket_edges)


def sla_monthly_closed(m: CaseModel) -> DataFrame:
    return ov.sla_trend(m.sla_counts, CLOSED, params=m.params)


def sla_monthly_open(m: CaseModel) -> DataFrame:
    return ov.sla_trend(m.sla_counts, OPEN, params=m.params)


def _weekly(m: CaseModel, kind: str) -> DataFrame:
    return ov.sla_trend(m.sla_counts, kind, "iso_week", m.trend_cutoff, m.params)


def sla_weekly_closed(m: CaseModel) -> DataFrame:
    return _weekly(m, CLOSED)


def sla_weekly_open(m: CaseModel) -> DataFrame:
    return _weekly(m, OPEN)


def backlog_total(m: CaseModel) -> DataFrame:
    return ov.backlog_total(m.classification_counts)


def backlog_aged_share(m: CaseModel) -> DataFrame:
    return ov.backlog_aged_share(m.classification_counts, m.params.aged_days)


def backlog_aged_overview(m: CaseModel) -> DataFrame:
    return ov.backlog_aged_overview(
        m.classification_counts, m.params.aged_days, m.params.bucket_edges
    )


def sla_duration_percentiles(m: CaseModel) -> DataFrame:
    return ov.sla_duration_percentiles(
        m.classification_counts, m.params.target_days, m.params.levels
    )


# --- Bottlenecks


def _durations(m: CaseModel, population: Column, label: str) -> DataFrame:
    return st.counted_durations(m.stage_counts, population, label, m.steps, m.params.levels)


def stage_duration_all(m: CaseModel) -> DataFrame:
    return _durations(m, st.every_case(), "Stage_All_Cases")


def stage_duration_within(m: CaseModel) -> DataFrame:
    limit = m.params.target_days
    return _durations(m, st.lead_within(limit), f"Stage_LT_Within_{limit}")


def stage_duration_above(m: CaseModel) -> DataFrame:
    limit = m.params.target_days
    return _durations(m, st.lead_above(limit), f"Stage_LT_Without_{limit}")


def primary_issue_share(m: CaseModel) -> DataFrame:
    return st.primary_issue_share(m.flag_counts)


def local_missingness(m: CaseModel) -> DataFrame:
    return st.local_missingness(m.flag_counts, m.steps)


def contribution_all(m: CaseModel) -> DataFrame:
    return st.counted_contribution(m.stage_counts, st.every_case(), steps=m.steps)


def contribution_within(m: CaseModel) -> DataFrame:
    limit = m.params.target_days
    return st.counted_contribution(
        m.stage_counts, F.col("Lead_Time") <= limit, f"Stage_Within_{limit}", steps=m.steps
    )


def contribution_above(m: CaseModel) -> DataFrame:
    limit = m.params.target_days
    return st.counted_contribution(
        m.stage_counts, F.col("Lead_Time") > limit, f"Stage_Without_{limit}", steps=m.steps
    )


# --- Segments


def segment_ranking(m: CaseModel, segment: Segment) -> DataFrame:
    """Segments in rank order; ``segment`` may be any of the model's."""
    return sg.in_rank_order(_ranking(m, segment), segment)


def _ranking(m: CaseModel, segment: Segment) -> DataFrame:
    return sg.segment_ranking(m.delay_base, segment, m.params.min_cases)


def _spend_texts(m: CaseModel) -> DataFrame:
    if m.dim_spend_area is None:
        raise ValueError("the star has no dim_spend_area to name spend areas from")
    return m.dim_spend_area.select(
        F.col("spend_area_key").alias(SPEND_AREA.key),
        F.col("sub_spend_area_text").alias(SPEND_TEXT),
        F.col("spend_classification_text").alias(SPEND_CLASS),
    )


def vendor_ranking(m: CaseModel) -> DataFrame:
    return segment_ranking(m, VENDOR)


def company_ranking(m: CaseModel) -> DataFrame:
    return segment_ranking(m, COMPANY)


def spend_area_ranking(m: CaseModel) -> DataFrame:
    texts = _spend_texts(m).drop(SPEND_CLASS)
    named = _ranking(m, SPEND_AREA).join(texts, SPEND_AREA.key, "left")
    ordered = named.select(
        SPEND_AREA.key,
        SPEND_TEXT,
        "Total_cases",
        "Delay_cases",
        "Delayed_Rate",
        "Impact_Share",
        SPEND_AREA.rank,
    )
    return sg.in_rank_order(ordered, SPEND_AREA)


def segment_cases(
    m: CaseModel, segment: Segment, top: int, texts: DataFrame | None = None
) -> DataFrame:
    """Complete cases of the ``top`` segments; ``texts`` has names of the segments by their key."""
    chosen = sg.top_segments(m.delay_base, segment, top, m.params.min_cases)
    extra: list[str] = []
    if texts is not None:
        chosen = chosen.join(texts, segment.key, "left")
        extra = [c for c in texts.columns if c != segment.key]
    return sg.segment_base(m.in_window, chosen, segment, m.start, extra, m.steps)


def segment_durations(
    m: CaseModel, base: DataFrame, segment: Segment, extra: tuple[str, ...] = ()
) -> DataFrame:
    return sg.segment_duration(
        base, segment, extra, m.params.target_days, m.steps, m.params.levels
    )


def segment_bottlenecks(
    m: CaseModel, base: DataFrame, segment: Segment, extra: tuple[str, ...] = ()
) -> DataFrame:
    return sg.segment_bottleneck(base, segment, extra, m.params.target_days, m.steps)


def vendor_base(m: CaseModel) -> DataFrame:
    return segment_cases(m, VENDOR, m.params.top_vendors)


def spend_area_base(m: CaseModel) -> DataFrame:
    return segment_cases(m, SPEND_AREA, m.params.top_spend_areas, _spend_texts(m))


def vendor_stage_duration(m: CaseModel) -> DataFrame:
    return segment_durations(m, vendor_base(m), VENDOR)


def vendor_bottleneck(m: CaseModel) -> DataFrame:
    return segment_bottlenecks(m, vendor_base(m), VENDOR)


def spend_area_stage_duration(m: CaseModel) -> DataFrame:
    return segment_durations(m, spend_area_base(m), SPEND_AREA, (SPEND_TEXT, SPEND_CLASS))


def spend_area_bottleneck(m: CaseModel) -> DataFrame:
    return segment_bottlenecks(m, spend_area_base(m), SPEND_AREA, (SPEND_TEXT, SPEND_CLASS))


# --- Concentration and data quality


def _pareto(m: CaseModel, segment: Segment) -> DataFrame:
    delayed = sg.total_delayed(sg.segment_counts(m.delay_base, segment))
    curve = sg.pareto(_ranking(m, segment), segment, delayed)
    return sg.in_rank_order(curve, segment)


def vendor_pareto(m: CaseModel) -> DataFrame:
    return _pareto(m, VENDOR)


def spend_area_pareto(m: CaseModel) -> DataFrame:
    return _pareto(m, SPEND_AREA)


def company_pareto(m: CaseModel) -> DataFrame:
    return _pareto(m, COMPANY)


def stage_quality_check(m: CaseModel) -> DataFrame:
    return quality_check(m.stage_base, m.steps)


REPORTS: dict[str, Report] = {
    f.__name__: f
    for f in (
        sla_distribution,
        sla_monthly_closed,
        sla_monthly_open,
        sla_weekly_closed,
        sla_weekly_open,
        backlog_total,
        backlog_aged_share,
        backlog_aged_overview,
        sla_duration_percentiles,
        stage_duration_all,
        stage_duration_within,
        stage_duration_above,
        primary_issue_share,
        local_missingness,
        contribution_all,
        contribution_within,
        contribution_above,
        vendor_ranking,
        vendor_stage_duration,
        vendor_bottleneck,
        spend_area_ranking,
        spend_area_stage_duration,
        spend_area_bottleneck,
        company_ranking,
        vendor_pareto,
        spend_area_pareto,
        company_pareto,
        stage_quality_check,
    )
}


def reports(model: CaseModel) -> dict[str, DataFrame]:
    """Every report of the model, by name, as a plan that runs when it is written or shown.

    The counted tables that they share are written here."""
    return {name: build(model) for name, build in REPORTS.items()}
