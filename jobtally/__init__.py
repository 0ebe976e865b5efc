"""Resource-usage and efficiency tables from batch accounting and workflow logs."""

from .plans.daily_report import daily_hours, daily_report, daily_report_of_day
from .plans.generic import generic_report
from .plans.ingest import ingest
from .plans.log_inputs import (
    log_input_sizes,
    log_input_sizes_of_files,
    log_input_sizes_of_texts,
)
from .plans.period_report import (
    period_report,
    period_report_from_accounting,
    period_report_from_json,
    period_report_from_metrics,
)
from .plans.rule_report import rule_report, run_allocations
from .plans.run_days import collect_run_day_files, collect_run_days
from .session import get_session, materialize

__all__ = [
    "collect_run_day_files",
    "collect_run_days",
    "daily_hours",
    "daily_report",
    "daily_report_of_day",
    "generic_report",
    "get_session",
    "ingest",
    "log_input_sizes",
    "log_input_sizes_of_files",
    "log_input_sizes_of_texts",
    "materialize",
    "period_report",
    "period_report_from_accounting",
    "period_report_from_json",
    "period_report_from_metrics",
    "rule_report",
    "run_allocations",
]
