"""Imports every query module, which fills the registry."""

from . import analysis_queries, audit_queries, core_queries, report_queries, summary_queries  # noqa: F401
