"""Every report and operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.constants import P2P_STEPS, Params
from procflow.operators.milestones import as_of_date, core_milestones, milestones
from procflow.operators.overview import without_start_day
from procflow.operators.stages import stage_share, without_days
from procflow.plans import reports as rp
from procflow.plans.case_state import CaseState
from procflow.plans.model import CaseModel, build_model
from procflow.plans.order_line_model import order_line_model
from procflow.sources.flat_log import check_log, raw_log
from procflow.sources.order_lines import (
    dim_spend_area,
    fact_cases,
    fact_events,
    flat_log,
    order_line_log,
    order_line_star,
    read_lines,
)
from procflow.sources.sinks import publish_outputs, published, read_output, write_outputs
from procflow.sources.staging import new_folder, once_per_input
from procflow.sources.star import Star, build_star, load_star, save_star
from procflow.sources.user_events import COHORT, JOURNEY, journey_star

Query = Callable[[SparkSession, str], DataFrame]


def _on_model(build: Callable[[CaseModel], DataFrame]) -> Query:
    return lambda spark, folder: build(order_line_model(spark, folder))


def _core_milestones(spark: SparkSession, folder: str) -> DataFrame:
    star = order_line_star(spark, folder)
    return core_milestones(star.fact_events, star.dim_activity)


def _milestones(spark: SparkSession, folder: str) -> DataFrame:
    star = order_line_star(spark, folder)
    return milestones(star.fact_events, star.dim_activity)


def _grown_state(spark: SparkSession, folder: str) -> CaseState:
    """The order lines in two batches: those of even orders, then the others and a few of the first again."""

    def build() -> CaseState:
        lines, star = read_lines(spark, folder), order_line_star(spark, folder)
        even = F.col("l_orderkey") % 2 == 0
        state = CaseState.create(spark, new_folder(spark, "case-state"), buckets=16)
        for part in (lines.filter(even), lines.filter(~even | (F.col("l_orderkey") % 10 == 0))):
            state = state.add(replace(star, fact_events=fact_events(part), fact_cases=fact_cases(part)))
        return state

    return once_per_input(spark, f"{folder.rstrip('/')}/lineitem.parquet", "grown_state", build)


def _milestones_incremental(spark: SparkSession, folder: str) -> DataFrame:
    return _grown_state(spark, folder).milestones()


def _on_grown_state(build: Callable[[CaseModel], DataFrame]) -> Query:
    return lambda spark, folder: build(_grown_state(spark, folder).model(dim_spend_area(spark)))


def _as_of_date(spark: SparkSession, folder: str) -> DataFrame:
    star = order_line_star(spark, folder)
    core = core_milestones(star.fact_events, star.dim_activity, P2P_STEPS[:1])
    return as_of_date(core, star.dim_activity)


def _collated_milestones(spark: SparkSession, folder: str) -> DataFrame:
    """Core milestones where the dimension spells the activities in capitals with blanks after."""
    star = order_line_star(spark, folder)
    spelled = F.concat(F.upper("activity"), F.lit("  ")).alias("activity")
    activities = star.dim_activity.select("activity_key", spelled)
    return core_milestones(star.fact_events, activities, collation="UTF8_LCASE_RTRIM")


def _on_snapshot(build: Callable[[CaseModel], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        model = order_line_model(spark, folder)
        return build(replace(model, params=replace(model.params, snapshot=True)))

    return run


def _journey_model(spark: SparkSession, folder: str) -> CaseModel:
    """Three steps of user events, delayed above 20 days, ranked by cohort."""
    return once_per_input(
        spark,
        f"{folder.rstrip('/')}/events.parquet",
        "journey_model",
        lambda: build_model(
            journey_star(spark, folder),
            Params(target_days=20, min_cases=5),
            steps=JOURNEY,
            segments=(COHORT,),
        ),
    )


def _on_journeys(build: Callable[[CaseModel], DataFrame]) -> Query:
    return lambda spark, folder: build(_journey_model(spark, folder))


def _cohort_bottleneck(m: CaseModel) -> DataFrame:
    return rp.segment_bottlenecks(m, rp.segment_cases(m, COHORT, 5), COHORT)


def _analysis_window(m: CaseModel) -> DataFrame:
    return m.as_of_row.select(
        m.start.alias("Start_Date"),
        "As_of_Date",
        m.trend_cutoff.alias("Trend_Cutoff"),
    )


def _built_star(spark: SparkSession, folder: str) -> Star:
    return once_per_input(
        spark,
        f"{folder.rstrip('/')}/lineitem.parquet",
        "order_line_built_star",
        lambda: build_star(order_line_log(spark, folder)),
    )


def _star_table(name: str) -> Query:
    return lambda spark, folder: _built_star(spark, folder).tables()[name]


def _saved_star_model(spark: SparkSession, folder: str) -> CaseModel:
    """A model read from star tables on disk, its core milestone table included."""

    def build() -> CaseModel:
        star = order_line_star(spark, folder)
        core = core_milestones(star.fact_events, star.dim_activity)
        star = replace(star, fact_case_milestones_core=core)
        target = new_folder(spark, "star")
        save_star(star, target)
        return build_model(load_star(spark, target))

    lines = f"{folder.rstrip('/')}/lineitem.parquet"
    return once_per_input(spark, lines, "saved_star_model", build)


def _on_saved_star(build: Callable[[CaseModel], DataFrame]) -> Query:
    return lambda spark, folder: build(_saved_star_model(spark, folder))


def _grown_star(spark: SparkSession, folder: str) -> Star:
    """A star over all orders that keeps the keys of one over the first orders."""

    def build() -> Star:
        lines = read_lines(spark, folder)
        first = build_star(flat_log(lines.filter(F.col("l_orderkey") < 40)))
        return build_star(flat_log(lines), known=first.dimensions())

    return once_per_input(spark, f"{folder.rstrip('/')}/lineitem.parquet", "grown_star", build)


def _collated_star(spark: SparkSession, folder: str) -> Star:
    """A star of the log with half of its cases spelling activities and attributes in capitals."""

    def build() -> Star:
        log = order_line_log(spark, folder)
        odd = F.substring("case_id", -1, 1).isin("1", "3", "5", "7")
        texts = ["activity", "vendor", "company", "sub_spend_area", "spend_classification"]
        spelled = {c: F.when(odd, F.concat(F.upper(c), F.lit(" "))).otherwise(F.lower(c)) for c in texts}
        return build_star(log.withColumns(spelled), collation="UTF8_LCASE_RTRIM")

    return once_per_input(spark, f"{folder.rstrip('/')}/lineitem.parquet", "collated_star", build)


def _star_collated_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Case facts of the collated star with the names that their keys stand for, in capitals."""
    star = _collated_star(spark, folder)
    named = star.fact_cases
    for dim, key in ((star.dim_vendor, "vendor_key"), (star.dim_company, "company_key")):
        named = named.join(dim, key, "left")
    names = [F.rtrim(F.upper(c)).alias(c) for c in ("vendor", "company")]
    return named.select("case_id", *names)


def _rejected_events(spark: SparkSession, folder: str) -> DataFrame:
    """The order-line log as text with faults in it, by what becomes of its rows."""
    log = order_line_log(spark, folder)
    number = F.substring("case_id", 2, 20).cast("long")
    text = F.date_format("timestamp", "dd-MM-yyyy HH:mm")
    faulty = log.withColumns(
        {
            "timestamp": F.when(number % 83 == 0, "31-02-2018 00:00").when(number % 79 != 0, text),
            "activity": F.when(number % 89 == 0, F.lit(" ")).otherwise(F.col("activity")),
        }
    )
    raw, target = new_folder(spark, "raw-log"), new_folder(spark, "checked-log")
    faulty.write.parquet(raw)
    return check_log(raw_log(spark, raw, "parquet"), target, "dd-MM-yyyy HH:mm").counts()


def _report_published(spark: SparkSession, folder: str) -> DataFrame:
    """A report published twice, read as its readers find it."""
    model = order_line_model(spark, folder)
    target, name = new_folder(spark, "published"), "sla_distribution"
    publish_outputs({"backlog_total": rp.backlog_total(model)}, target)
    report = rp.sla_distribution(model)
    publish_outputs({name: report}, target, single_file=[name])
    path, fmt = published(spark, target)[name]
    return read_output(spark, path, report, fmt)


def _report_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Write a report through the sink and read the written file."""
    report = rp.sla_distribution(order_line_model(spark, folder))
    target = new_folder(spark, "reports")
    paths = write_outputs({"sla_distribution": report}, target, single_file=["sla_distribution"])
    return read_output(spark, paths["sla_distribution"], report)


QUERIES: dict[str, Query] = {
    **{name: _on_model(build) for name, build in rp.REPORTS.items()},
    "core_milestones": _core_milestones,
    "milestones": _milestones,
    "as_of_date": _as_of_date,
    "analysis_window": _on_model(_analysis_window),
    "case_overview": _on_model(lambda m: without_start_day(m.overview)),
    "case_classification": _on_model(lambda m: m.classification),
    "stage_base": _on_model(lambda m: without_days(m.stage_base)),
    "stage_flags": _on_model(lambda m: without_days(m.stage_flags)),
    "stage_contribution": _on_model(lambda m: stage_share(m.stage_base)),
    "delay_base": _on_model(lambda m: m.delay_base),
    "vendor_base": _on_model(rp.vendor_base),
    "spend_area_base": _on_model(rp.spend_area_base),
    "star_dim_activity": _star_table("dim_activity"),
    "star_dim_vendor": _star_table("dim_vendor"),
    "star_dim_company": _star_table("dim_company"),
    "star_dim_spend_area": _star_table("dim_spend_area"),
    "star_fact_cases": _star_table("fact_cases"),
    "star_fact_events": _star_table("fact_events"),
    "star_sla_distribution": _on_saved_star(rp.sla_distribution),
    "star_vendor_ranking": _on_saved_star(rp.vendor_ranking),
    "report_sink": _report_sink,
    "report_published": _report_published,
    "rejected_events": _rejected_events,
    "star_keys_after_growth": lambda spark, folder: _grown_star(spark, folder).dim_vendor,
    "star_collated_cases": _star_collated_cases,
    "core_milestones_collated": _collated_milestones,
    "snapshot_sla_distribution": _on_snapshot(rp.sla_distribution),
    "snapshot_stage_duration_all": _on_snapshot(rp.stage_duration_all),
    "snapshot_primary_issue_share": _on_snapshot(rp.primary_issue_share),
    "snapshot_vendor_ranking": _on_snapshot(rp.vendor_ranking),
    "milestones_incremental": _milestones_incremental,
    "incremental_sla_distribution": _on_grown_state(rp.sla_distribution),
    "incremental_vendor_ranking": _on_grown_state(rp.vendor_ranking),
    "journey_stage_duration": _on_journeys(rp.stage_duration_all),
    "journey_stage_duration_above": _on_journeys(rp.stage_duration_above),
    "journey_cohort_ranking": _on_journeys(lambda m: rp.segment_ranking(m, COHORT)),
    "journey_cohort_bottleneck": _on_journeys(_cohort_bottleneck),
}

def _counted_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    m = order_line_model(spark, folder)
    return [m.sla_counts, m.stage_counts, m.flag_counts]


#: What the queries share, built at its first use.
PREPARED: dict[str, Callable[[SparkSession, str], object]] = {
    "order_line_model": order_line_model,
    "counted_tables": _counted_tables,
    "built_star": _built_star,
    "saved_star_model": _saved_star_model,
    "journey_model": _journey_model,
    "grown_state": _grown_state,
    "grown_star": _grown_star,
    "collated_star": _collated_star,
}
