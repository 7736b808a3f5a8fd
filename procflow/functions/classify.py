"""CASE-style classification of day counts and report sort positions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from procflow.constants import BUCKET_EDGES, RISK_STATUSES, TREND_STATUSES


def _banded(days: Column, edges: Sequence[int], labels: Sequence[str]) -> Column:
    """First label whose (inclusive) upper edge holds ``days``; the last label above all edges."""
    if len(labels) != len(edges) + 1:
        raise ValueError(f"{len(edges)} edges need {len(edges) + 1} labels, got {len(labels)}")
    out = F.when(days <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(days <= edge, label)
    return out.otherwise(labels[-1])


def bucket_labels(edges: Sequence[int] = BUCKET_EDGES) -> list[str]:
    return [str(e) for e in edges] + [f">{edges[-1]}"]


def duration_bucket(days: Column, edges: Sequence[int] = BUCKET_EDGES) -> Column:
    """Bucket named after its upper edge: ``75``, ``90``, ``120``, ``150``, ``>150``."""
    return _banded(days, edges, bucket_labels(edges))


def risk_status(
    days: Column, edges: Sequence[int] = BUCKET_EDGES, labels: Sequence[str] = RISK_STATUSES
) -> Column:
    """Five-level risk status over the same edges as :func:`duration_bucket`."""
    return _banded(days, edges, labels)


def trend_status(
    days: Column, target: int = 75, watch: int = 90, labels: Sequence[str] = TREND_STATUSES
) -> Column:
    """Three-level status of the trend reports: up to target, up to watch, beyond."""
    return _banded(days, (target, watch), labels)


def delay_flag(days: Column, threshold: int = 75) -> Column:
    """0 up to the threshold, otherwise 1 (NULL days count as 1)."""
    return F.when(days <= threshold, 0).otherwise(1)


def position(value: Column, order: Iterable[str | tuple[str, int]]) -> Column:
    """Sort position of a category: its index in ``order``, or the number given next to it."""
    pairs = [(v, i) if isinstance(v, str) else v for i, v in enumerate(order, 1)]
    out = F.when(value == pairs[0][0], pairs[0][1])
    for label, pos in pairs[1:]:
        out = out.when(value == label, pos)
    return out
