"""Fixed values of the purchase-to-pay analysis and its tunable parameters."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple


class Step(NamedTuple):
    """One milestone: a short name, the activity that marks it, and which event counts."""

    name: str
    activity: str
    pick: str  # "first" = earliest event of the case, "last" = latest event


class Segment(NamedTuple):
    """A case attribute to rank: its column in the case table and its report column names."""

    column: str
    key: str
    rank: str


# --- Fixed values: they must equal the data and the report layout, so they are listed as they are.

PO_ACTIVITY = "Create Purchase Order Item"
GR_ACTIVITY = "Record Goods Receipt"
IR_ACTIVITY = "Record Invoice Receipt"
CI_ACTIVITY = "Clear Invoice"

P2P_STEPS = (
    Step("PO", PO_ACTIVITY, "first"),
    Step("GR", GR_ACTIVITY, "last"),
    Step("IR", IR_ACTIVITY, "last"),
    Step("CI", CI_ACTIVITY, "last"),
)

CLOSED = "Lead Time"
OPEN = "Age days"

BUCKET_EDGES = (75, 90, 120, 150)
RISK_STATUSES = ("Acceptable", "Watchlist", "At Risk", "Aged", "Critical")
TREND_STATUSES = ("Acceptable", "Watchlist", "Overdue")

NORMAL = "Lack abnormality"
ISSUE_ORDER = (
    (NORMAL, 1),
    ("Missing_GR", 2),
    ("Invalid_PO_GR", 3),
    ("Missing_IR", 4),
    ("Invalid_GR_IR", 5),
    ("Missing_CI", 6),
    ("Invalid_IR_CI", 6),
)

#: Percentiles of the duration reports by column name.
LEVELS = (("Median", 0.5), ("P90", 0.9))

VENDOR = Segment("vendor_key", "Vendor_key", "Vendor_Rank")
SPEND_AREA = Segment("spend_area_key", "Spend_Area_key", "Spend_Area_Rank")
COMPANY = Segment("company_key", "Company_key", "Company_Rank")
SEGMENTS = (COMPANY, VENDOR, SPEND_AREA)

# --- End of fixed values.


@dataclass(frozen=True)
class Params:
    """Thresholds and windows; the defaults give the standard reports."""

    months_back: int = 7
    lookback_months: int = 3
    target_days: int = 75
    watch_days: int = 90
    bucket_edges: tuple[int, ...] = BUCKET_EDGES
    risk_labels: tuple[str, ...] = RISK_STATUSES
    aged_days: int = 90
    min_cases: int = 100
    top_vendors: int = 15
    top_spend_areas: int = 10
    iso_year: bool = False
    snapshot: bool = False
    levels: tuple[tuple[str, float], ...] = LEVELS


def ts_col(step: str) -> str:
    return f"{step}_ts"


def day_col(step: str) -> str:
    return f"{step}_day"


def stage_pairs(steps: tuple[Step, ...] = P2P_STEPS) -> list[tuple[str, str]]:
    """Adjacent milestone names, e.g. ``[("PO", "GR"), ("GR", "IR"), ("IR", "CI")]``."""
    names = [s.name for s in steps]
    return list(zip(names, names[1:]))


def stage_cols(steps: tuple[Step, ...] = P2P_STEPS) -> list[str]:
    return [f"{a}_{b}_Days" for a, b in stage_pairs(steps)]
