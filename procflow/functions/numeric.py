"""Decimal ratios and rounding rules shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERCENT = T.DecimalType(10, 2)
_COUNT = T.DecimalType(20, 0)
_SHARE = T.DecimalType(18, 4)


def ratio(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``, DECIMAL(10,2) rounded half up.

    Computed in DECIMAL, not DOUBLE, so exact halves round up. A zero ``whole`` gives NULL.
    """
    return (part.cast(_COUNT) * 100 / F.nullif(whole.cast(_COUNT), F.lit(0))).cast(PERCENT)


def day_share(days: Column, total: Column, scale: int | None = None) -> Column:
    """``days`` as a percentage of ``total`` days; NULL when ``total`` is 0.

    ``scale`` rounds the share half up to that many decimals; ``None`` leaves it unrounded.
    """
    share = days.cast(_SHARE) / F.nullif(total.cast(_SHARE), F.lit(0)) * 100
    return share if scale is None else share.cast(T.DecimalType(18, scale))


def clean_double(x: Column) -> Column:
    """Drop binary noise of an interpolated percentile (27.80000000000001 becomes 27.8)."""
    return F.round(x, 6)


def to_int(x: Column) -> Column:
    """DOUBLE to INT, truncating towards zero after dropping binary noise."""
    return F.round(x, 9).cast("int")


def to_percent(x: Column) -> Column:
    """DOUBLE to DECIMAL(10,2), half up after dropping binary noise."""
    return F.round(x, 9).cast(PERCENT)
