"""The case model of the log derived from the order lines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from procflow.plans.model import CaseModel, build_model
from procflow.sources.order_lines import order_line_star
from procflow.sources.staging import once_per_input


def order_line_model(spark: SparkSession, folder: str) -> CaseModel:
    """The model of the order-line log, built once per session and state of the input files."""
    return once_per_input(
        spark,
        f"{folder.rstrip('/')}/lineitem.parquet",
        "order_line_model",
        lambda: build_model(order_line_star(spark, folder)),
    )
