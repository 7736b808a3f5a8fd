"""A Spark session with the settings the reports are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution merges small reducers (it never splits those of an aggregation, see
# ``staging.reducers``), splits skewed join partitions and turns a shuffle join into a broadcast
# one when the measured size allows. The session zone is fixed, although every
# expression is zone-free. Call-site capture costs several driver round trips per column
# expression, more than planning and running a small report.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def session(
    app: str = "procflow", master: str | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    """Get or create a session; ``settings`` add to or override the ones above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
