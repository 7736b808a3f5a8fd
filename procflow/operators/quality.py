"""Data-quality checks on the reconstructed cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procflow.constants import P2P_STEPS, Step, stage_cols
from procflow.functions.numeric import ratio
from procflow.functions.rows import cases, cases_if


def quality_check(sb: DataFrame, steps: Sequence[Step] = P2P_STEPS) -> DataFrame:
    """One row: cases, cases with a negative stage, and their percentage."""
    negative = F.lit(False)
    for c in stage_cols(steps):
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    return sb.agg(
        cases().alias("Total_Cases"),
        cases_if(negative).alias("Negative_Cases"),
    ).withColumn("Negative_Share", ratio(F.col("Negative_Cases"), F.col("Total_Cases")))
