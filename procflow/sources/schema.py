"""Declared schemas of the star tables and of the flat event log."""

from __future__ import annotations

from pyspark.sql import types as T

STAR_SCHEMAS: dict[str, str] = {
    "fact_events": "case_id STRING, activity_key INT, timestamp TIMESTAMP_NTZ",
    "fact_case_milestones_core": "case_id STRING, activity_key INT, milestone_ts TIMESTAMP_NTZ",
    "fact_cases": "case_id STRING, company_key INT, vendor_key INT, spend_area_key INT",
    "dim_activity": "activity_key INT, activity STRING",
    "dim_spend_area": (
        "spend_area_key INT, sub_spend_area_text STRING, spend_classification_text STRING"
    ),
    "dim_vendor": "vendor_key INT, vendor STRING",
    "dim_company": "company_key INT, company STRING",
}

REQUIRED_TABLES = ("fact_events", "fact_cases", "dim_activity")

EVENT_LOG_SCHEMA = (
    "case_id STRING, activity STRING, timestamp TIMESTAMP_NTZ, vendor STRING, company STRING, "
    "spend_area STRING, sub_spend_area STRING, spend_classification STRING"
)


def star_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(STAR_SCHEMAS[table])


def event_log_schema() -> T.StructType:
    return T.StructType.fromDDL(EVENT_LOG_SCHEMA)
