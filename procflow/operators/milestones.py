"""From events to milestones: one row per case with the time each process step was reached."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procflow.constants import P2P_STEPS, PO_ACTIVITY, Step, ts_col
from procflow.functions.dates import first_of_month


def _is_activity(name: str, collation: str | None) -> Column:
    text = F.col("activity")
    return (F.collate(text, collation) if collation else text) == name


def step_activities(
    dim_activity: DataFrame, steps: Sequence[Step] = P2P_STEPS, collation: str | None = None
) -> DataFrame:
    """``activity_key`` and step number of the milestone activities.

    Names match exactly; ``collation="UTF8_LCASE_RTRIM"`` ignores case and trailing blanks.
    Several activities can then mark one step, as many as the dimension has spellings of it.
    """
    number = F.when(_is_activity(steps[0].activity, collation), 0)
    for i, step in enumerate(steps[1:], 1):
        number = number.when(_is_activity(step.activity, collation), i)
    found = dim_activity.select("activity_key", number.alias("_step"))
    return found.filter(F.col("_step").isNotNull())


def step_events(
    events: DataFrame,
    dim_activity: DataFrame,
    steps: Sequence[Step] = P2P_STEPS,
    collation: str | None = None,
) -> DataFrame:
    """``case_id, _step, timestamp`` of the events that mark a step and belong to a case."""
    core = _small(step_activities(dim_activity, steps, collation), collation)
    known = events.filter(F.col("case_id").isNotNull())
    return known.join(core, "activity_key").select("case_id", "_step", "timestamp")


def _small(rows: DataFrame, collation: str | None) -> DataFrame:
    """A hint for rows that are one per step; with spellings Spark's own size check decides."""
    return rows if collation else F.broadcast(rows)


def step_times(steps: Sequence[Step] = P2P_STEPS) -> list[Column]:
    """Aggregates over step events of one case: the time of each step."""
    return [
        (F.min if s.pick == "first" else F.max)(
            F.when(F.col("_step") == i, F.col("timestamp"))
        ).alias(ts_col(s.name))
        for i, s in enumerate(steps)
    ]


def activity_rows(
    core: DataFrame, dim_activity: DataFrame, activity: str, collation: str | None = None
) -> DataFrame:
    """The milestones of one activity."""
    keys = dim_activity.filter(_is_activity(activity, collation)).select("activity_key")
    return core.join(_small(keys, collation), "activity_key")


def milestones(
    events: DataFrame,
    dim_activity: DataFrame,
    steps: Sequence[Step] = P2P_STEPS,
    required: Sequence[str] = ("PO",),
    collation: str | None = None,
) -> DataFrame:
    """One row per case with a ``<step>_ts`` column per step, NULL when not reached.

    One scan and one shuffle for all steps. MIN/MAX combine in the map tasks, so a case with very
    many events still sends one row per task. Cases lacking a ``required`` step are left out, and
    so are events without a case.
    """
    hits = step_events(events, dim_activity, steps, collation)
    reached = hits.groupBy(F.col("case_id").alias("Case_ID")).agg(*step_times(steps))
    for name in required:
        reached = reached.filter(F.col(ts_col(name)).isNotNull())
    return reached


def core_milestones(
    events: DataFrame,
    dim_activity: DataFrame,
    steps: Sequence[Step] = P2P_STEPS,
    collation: str | None = None,
) -> DataFrame:
    """Long form: one row per case and milestone activity (first or last event, per step).

    Melted from the wide form: shuffling one row per case moves each case id once, where grouping
    by case and activity would move it once per step. With a collation several activities can
    mark a step and each keeps its own row, so the events are grouped by activity.
    """
    if collation:
        return _by_activity(events, dim_activity, steps, collation)
    wide = milestones(events, dim_activity, steps, (), collation)
    numbered = wide.select(
        F.col("Case_ID").alias("case_id"),
        *[F.col(ts_col(s.name)).alias(str(i)) for i, s in enumerate(steps)],
    )
    numbers = [str(i) for i in range(len(steps))]
    long = numbered.unpivot(["case_id"], numbers, "_number", "milestone_ts")
    reached = long.filter(F.col("milestone_ts").isNotNull()).select(
        "case_id", F.col("_number").cast("int").alias("_step"), "milestone_ts"
    )
    keys = F.broadcast(step_activities(dim_activity, steps, collation))
    return reached.join(keys, "_step").select("case_id", "activity_key", "milestone_ts")


def _by_activity(
    events: DataFrame, dim_activity: DataFrame, steps: Sequence[Step], collation: str
) -> DataFrame:
    core = step_activities(dim_activity, steps, collation)
    hits = events.filter(F.col("case_id").isNotNull()).join(core, "activity_key")
    firsts = [i for i, s in enumerate(steps) if s.pick == "first"]
    ends = hits.groupBy("case_id", "activity_key", "_step").agg(
        F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last")
    )
    moment = F.when(F.col("_step").isin(firsts), F.col("_first")).otherwise(F.col("_last"))
    return ends.select("case_id", "activity_key", moment.alias("milestone_ts"))


def as_of_date(
    core: DataFrame,
    dim_activity: DataFrame,
    activity: str = PO_ACTIVITY,
    collation: str | None = None,
) -> DataFrame:
    """One row ``As_of_Date``: the latest milestone time of ``activity``."""
    rows = activity_rows(core, dim_activity, activity, collation)
    return rows.agg(F.max("milestone_ts").alias("As_of_Date"))


def analysis_start(as_of: Column, months_back: int = 7) -> Column:
    """First day of the analysis window: the month ``months_back`` months before ``as_of``.

    With 7 the window spans eight calendar months, the current one included.
    """
    return first_of_month(as_of, months_back)
