"""procflow: process analytics on event logs with PySpark DataFrames."""

from procflow.constants import COMPANY, P2P_STEPS, SPEND_AREA, VENDOR, Params, Segment, Step
from procflow.plans.case_state import CaseState
from procflow.plans.model import CaseModel, build_model, case_table
from procflow.plans.reports import REPORTS, reports
from procflow.sources.flat_log import CheckedLog, check_log, raw_log, read_log
from procflow.sources.sinks import publish_outputs, published, read_output, write_outputs
from procflow.sources.staging import remove_staged
from procflow.sources.star import Star, build_star, load_star, save_star

__all__ = [
    "COMPANY",
    "CaseModel",
    "CaseState",
    "CheckedLog",
    "P2P_STEPS",
    "Params",
    "REPORTS",
    "SPEND_AREA",
    "Segment",
    "Star",
    "Step",
    "VENDOR",
    "build_model",
    "build_star",
    "case_table",
    "check_log",
    "load_star",
    "publish_outputs",
    "published",
    "raw_log",
    "read_log",
    "remove_staged",
    "read_output",
    "reports",
    "save_star",
    "write_outputs",
]
