from __future__ import annotations

import os
import sys
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from procflow.constants import P2P_STEPS  # noqa: E402
from procflow.session import session  # noqa: E402
from procflow.sources.schema import star_schema  # noqa: E402
from procflow.sources.star import Star  # noqa: E402

TESTDATA = Path(os.environ.get("PROCFLOW_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = session("procflow-tests", os.environ.get("PROCFLOW_MASTER", "local[8]"), settings)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def checked():
    """The scale at which all queries are compared with DuckDB."""
    return str(TESTDATA / os.environ.get("PROCFLOW_CHECK_SF", "sf0.01"))


def ts(text: str | None) -> datetime | None:
    """``"2018-06-01"`` or ``"2018-06-01 23:59"`` as a datetime."""
    return None if text is None else datetime.fromisoformat(text)


ACTIVITY_KEYS = {s.name: i for i, s in enumerate(P2P_STEPS, 1)}


class Log:
    """A tiny star, written event by event."""

    def __init__(self, spark):
        self.spark = spark
        self.events: list[tuple] = []
        self.cases: list[tuple] = []
        self.areas: list[tuple] = []

    def case(self, case_id, vendor=1, company=1, area=1, **steps):
        """Add a case; each step is a time or a list of times."""
        for name, times in steps.items():
            for t in times if isinstance(times, list) else [times]:
                self.events.append((case_id, ACTIVITY_KEYS[name], ts(t)))
        self.cases.append((case_id, company, vendor, area))
        return self

    def table(self, name, rows):
        return self.spark.createDataFrame(rows, star_schema(name))

    def star(self, core=None) -> Star:
        activities = [(ACTIVITY_KEYS[s.name], s.activity) for s in P2P_STEPS] + [(9, "Change Price")]
        return Star(
            fact_events=self.table("fact_events", self.events),
            fact_cases=self.table("fact_cases", self.cases),
            dim_activity=self.table("dim_activity", activities),
            dim_spend_area=self.table("dim_spend_area", self.areas),
            fact_case_milestones_core=(
                None if core is None else self.table("fact_case_milestones_core", core)
            ),
        )


@pytest.fixture
def log(spark):
    return Log(spark)


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def column(df, name) -> list:
    return [r[name] for r in df.select(name).collect()]
