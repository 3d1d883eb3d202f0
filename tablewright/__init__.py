"""Exploring, cleaning, profiling and charting tables with Spark DataFrames."""

from tablewright.errors import RequestError
from tablewright.operators.charts import ChartData, ChartSpec, Encoding, chart
from tablewright.operators.cleaning import register_step
from tablewright.plans.dashboard import (
    BoundChart,
    Dashboard,
    Report,
    ReportSection,
    dashboard_sections,
    report_sections,
)
from tablewright.plans.pipeline import CleaningPipeline, CleaningStep
from tablewright.plans.profile import ProfileReport, profile_report
from tablewright.sources.delimited import read_delimited
from tablewright.sources.documents import read_json
from tablewright.store.revisions import Revision, RevisionStore

__all__ = [
    "BoundChart",
    "ChartData",
    "ChartSpec",
    "CleaningPipeline",
    "CleaningStep",
    "Dashboard",
    "Encoding",
    "ProfileReport",
    "Report",
    "ReportSection",
    "RequestError",
    "Revision",
    "RevisionStore",
    "chart",
    "dashboard_sections",
    "profile_report",
    "read_delimited",
    "read_json",
    "register_step",
    "report_sections",
]
