"""The case model: what all reports read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procflow.constants import P2P_STEPS, SEGMENTS, Params, Segment, Step, day_col, ts_col
from procflow.operators.milestones import (
    activity_rows,
    analysis_start,
    as_of_date,
    step_events,
    step_times,
)
from procflow.operators.overview import (
    case_classification,
    case_overview,
    counted_overview,
    trend_cutoff,
)
from procflow.operators.segments import delay_base
from procflow.operators.stages import flag_counts, stage_base, stage_counts, stage_flags
from procflow.sources.staging import reducers, stage
from procflow.sources.star import Star


#: Closing time from the core milestone table, where there is one.
END_COLUMN = "_end"
#: First day of the month of a case's first step: the folders of the staged case table.
START_MONTH = "Start_month"


def case_table(
    star: Star,
    collation: str | None = None,
    steps: Sequence[Step] = P2P_STEPS,
    segments: Sequence[Segment] = SEGMENTS,
) -> DataFrame:
    """One row per case with a milestone: milestone times and days, its end, the segment keys.

    The rows about a case lie in up to three tables: its events, its attributes (one row, or the
    smallest key of several), and its closing time in the core milestone table, which the SLA
    reports use; without that table the last step closes the case. The tables are
    stacked and aggregated by case: one shuffle for all of them, rows combined before it, and
    neither the sorts of a merge join nor the in-memory tables of a hash join.
    """
    about, aggregates = case_rows(star, collation, steps, segments)
    cases = about.groupBy(F.col("case_id").alias("Case_ID")).agg(*aggregates)
    return finished_cases(cases, steps, segments)


def case_rows(
    star: Star,
    collation: str | None = None,
    steps: Sequence[Step] = P2P_STEPS,
    segments: Sequence[Segment] = SEGMENTS,
) -> tuple[DataFrame, list[Column]]:
    """All rows about the cases, stacked, and the aggregates over the rows of one case."""
    keys = [s.column for s in segments]
    about = step_events(star.fact_events, star.dim_activity, steps, collation)
    attributes = star.fact_cases.filter(F.col("case_id").isNotNull()).select("case_id", *keys)
    about = about.unionByName(attributes, allowMissingColumns=True)
    aggregates = [*step_times(steps), *[F.min(k).alias(k) for k in keys]]
    core = star.fact_case_milestones_core
    if core is not None:
        ends = activity_rows(core, star.dim_activity, steps[-1].activity, collation)
        known = ends.filter(F.col("case_id").isNotNull())
        about = about.unionByName(
            known.select("case_id", F.col("milestone_ts").alias(END_COLUMN)), allowMissingColumns=True
        )
        aggregates.append(F.max(END_COLUMN).alias(END_COLUMN))
    return about, aggregates


def finished_cases(
    cases: DataFrame, steps: Sequence[Step] = P2P_STEPS, segments: Sequence[Segment] = SEGMENTS
) -> DataFrame:
    """The case table from the aggregated rows: cases with a milestone, their end, the days."""
    return with_days(ended_cases(cases, steps, segments), steps)


def ended_cases(
    cases: DataFrame, steps: Sequence[Step] = P2P_STEPS, segments: Sequence[Segment] = SEGMENTS
) -> DataFrame:
    """The case table without the days, which follow from its times."""
    times = [ts_col(s.name) for s in steps]
    end = F.col(END_COLUMN if END_COLUMN in cases.columns else times[-1])
    reached = cases.filter(F.coalesce(*[F.col(t) for t in times]).isNotNull())
    return reached.select("Case_ID", *times, end.alias("End_ts"), *[s.column for s in segments])


def with_days(timed: DataFrame, steps: Sequence[Step] = P2P_STEPS) -> DataFrame:
    names = [*[s.name for s in steps], "End"]
    return timed.withColumns({day_col(n): F.col(ts_col(n)).cast("date") for n in names})


@dataclass(frozen=True)
class CaseModel:
    """The staged case table with the as-of date and the parameters of the analysis."""

    cases: DataFrame
    as_of_row: DataFrame
    dim_spend_area: DataFrame | None = None
    params: Params = Params()
    steps: tuple[Step, ...] = P2P_STEPS
    segments: tuple[Segment, ...] = SEGMENTS

    @cached_property
    def as_of(self) -> Column:
        """The as-of date as a scalar subquery: nothing is collected to build a report."""
        return self.as_of_row.scalar()

    def _moment(self, derived: Column) -> Column:
        """A moment derived from the as-of date, as a scalar subquery of its own.

        The derivation then runs once and not per case, and the scan gets a plain comparison,
        which it can hold against the statistics of each row group. (An aggregate, because
        Spark would merge a projection with the as-of subquery into one struct-valued subquery,
        whose fields it does not push into the scan.)
        """
        return self.as_of_row.agg(F.max(derived).alias("moment")).scalar()

    @cached_property
    def start(self) -> Column:
        """First day of the analysis window."""
        return self._moment(analysis_start(F.col("As_of_Date"), self.params.months_back))

    @cached_property
    def trend_cutoff(self) -> Column:
        """The weekly trends cover cases started after this moment."""
        return self._moment(trend_cutoff(F.col("As_of_Date"), self.params.lookback_months))

    @cached_property
    def seen(self) -> DataFrame:
        """The cases as the reports see them: for a snapshot, without steps after the as-of date."""
        if not self.params.snapshot:
            return self.cases
        names = [*[s.name for s in self.steps], "End"]
        known = {n: F.col(ts_col(n)) <= self.as_of for n in names}
        return self.cases.withColumns(
            {c(n): F.when(known[n], F.col(c(n))) for n in names for c in (ts_col, day_col)}
        )

    @cached_property
    def started(self) -> DataFrame:
        """Cases that have a first step."""
        return self.seen.filter(F.col(day_col(self.steps[0].name)).isNotNull())

    @cached_property
    def in_window(self) -> DataFrame:
        """Cases that may lie in the analysis window: those of its months.

        The window starts on the first of a month. On a table that lies in folders by month, earlier
        files are not even opened; other tables are returned whole, as every operator applies the
        exact condition itself.
        """
        if START_MONTH not in self.cases.columns:
            return self.seen
        return self.seen.filter(F.col(START_MONTH) >= self.start)

    @cached_property
    def overview(self) -> DataFrame:
        return self._overview(self.started)

    def _overview(self, cases: DataFrame) -> DataFrame:
        first_day = F.col(day_col(self.steps[0].name))
        spans = cases.filter(first_day.isNotNull()).select(
            "Case_ID",
            F.col(ts_col(self.steps[0].name)).alias("Start_Time"),
            F.col("End_ts").alias("End_Time"),
            F.col(day_col(self.steps[0].name)).alias("Start_Day"),
            F.col("End_day").alias("End_Day"),
        )
        return case_overview(spans, self.as_of, self.params.snapshot)

    @cached_property
    def classification(self) -> DataFrame:
        p = self.params
        seen = self._overview(self.in_window)
        return case_classification(seen, self.start, p.bucket_edges, p.risk_labels)

    @cached_property
    def stage_base(self) -> DataFrame:
        return stage_base(self.in_window, self.start, self.steps)

    @cached_property
    def stage_flags(self) -> DataFrame:
        return stage_flags(self.stage_base, self.steps)

    @cached_property
    def delay_base(self) -> DataFrame:
        return delay_base(
            self.in_window, self.start, self.params.target_days, self.steps, self.segments
        )

    # Counted once for all reports that need no single case: their size is bounded by the calendar,
    # and 17 reports read them instead of the case table. Written at first use.

    @cached_property
    def sla_counts(self) -> DataFrame:
        """The overview counted per start day, type and duration."""
        return stage(counted_overview(self.overview, self.trend_cutoff), "sla_counts")

    @cached_property
    def classification_counts(self) -> DataFrame:
        p = self.params
        return case_classification(self.sla_counts, self.start, p.bucket_edges, p.risk_labels)

    @cached_property
    def stage_counts(self) -> DataFrame:
        """The stage base counted per stage, its days and the lead time."""
        return stage(stage_counts(self.stage_base, self.steps), "stage_counts")

    @cached_property
    def flag_counts(self) -> DataFrame:
        """The stage flags counted per statuses and steps reached."""
        return stage(flag_counts(self.stage_flags, self.steps), "flag_counts")


def build_model(
    star: Star,
    params: Params = Params(),
    collation: str | None = None,
    steps: Sequence[Step] = P2P_STEPS,
    segments: Sequence[Segment] = SEGMENTS,
    partitions: int | None = None,
) -> CaseModel:
    """Compute the case table once, into the shared folder, and the as-of date from it.

    ``steps`` are the milestones of the process in their order, ``segments`` the attributes of
    ``fact_cases`` to rank; ``partitions`` is the number of reducers of the case shuffle, by default
    the session's. The finished cases are dealt to ranges of the first step (and of the case id, so that
    a day with a third of all cases is split) and written in folders by its month: a window reads the
    files of its months only, and in these the sort lets it skip row groups and pages. There are about as
    many files as reducers and months together.
    Without a core milestone table the as-of date is the latest first step in the case table,
    one column of a table already written, instead of a second pass over the events.
    """
    first = steps[0]
    with reducers(star.fact_events.sparkSession, partitions):
        about, aggregates = case_rows(star, collation, steps, segments)
        table = about.groupBy(F.col("case_id").alias("Case_ID")).agg(*aggregates)
        day = F.col(ts_col(first.name)).cast("date")
        # The days are added behind the shuffle: they need not travel.
        dealt = ended_cases(table, steps, segments).repartitionByRange(day, "Case_ID")
        table = with_days(dealt, steps).withColumn(START_MONTH, F.trunc(day_col(first.name), "MM"))
        cases = stage(table.sortWithinPartitions(START_MONTH, ts_col(first.name)), "cases", [START_MONTH])
    core = star.fact_case_milestones_core
    if core is None:
        as_of = cases.agg(F.max(ts_col(first.name)).alias("As_of_Date"))
    else:
        as_of = as_of_date(core, star.dim_activity, first.activity, collation)
    as_of = stage(as_of, "as_of")
    return CaseModel(cases, as_of, star.dim_spend_area, params, tuple(steps), tuple(segments))
