"""User journeys in the given ``events`` table: a log with real times and three steps of its own."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from procflow.constants import Segment, Step
from procflow.sources.star import Star

# The event types of the table, by key.
EVENT_TYPES = ((1, "view"), (2, "click"), (3, "purchase"), (4, "signup"), (5, "error"))

JOURNEY = (
    Step("VIEW", "view", "first"),
    Step("CLICK", "click", "last"),
    Step("BUY", "purchase", "last"),
)
#: Users by the last digit of their id.
COHORT = Segment("cohort_key", "Cohort_key", "Cohort_Rank")


def journey_star(spark: SparkSession, folder: str) -> Star:
    """Each user is a case; event types are the activities."""
    events = spark.read.parquet(f"{folder.rstrip('/')}/events.parquet")
    user = F.col("user_id").cast("string").alias("case_id")
    values = ", ".join(f"({key}, '{name}')" for key, name in EVENT_TYPES)
    activities = spark.sql(f"SELECT * FROM VALUES {values} AS t(activity_key, activity)")
    numbers = F.create_map(*[F.lit(v) for key, name in EVENT_TYPES for v in (name, key)])
    known = events.where(F.col("user_id").isNotNull())
    return Star(
        fact_events=known.select(
            user,
            F.element_at(numbers, F.col("event_type")).alias("activity_key"),
            F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        ),
        fact_cases=known.select(user, (F.col("user_id") % 10).cast("int").alias("cohort_key")).distinct(),
        dim_activity=activities,
    )
