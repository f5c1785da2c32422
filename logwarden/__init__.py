"""Security analysis of web-access and authentication logs on Spark."""

from logwarden.operators.correlate import incident_findings, incidents
from logwarden.operators.entries import entries_of, parse_auth_log, parse_errors, parse_lines, parse_web_log
from logwarden.operators.signature import signature_findings, signature_hits
from logwarden.operators.stats import source_stats, total_stats
from logwarden.operators.threshold import burst_segments, sliding_counts, threshold_findings
from logwarden.plans.analyze import Analysis, analyze, analyze_lines, analyze_parsed, detect
from logwarden.plans.rules import EXTRA_RULES, SHIPPED_RULES, build_rules, register_rule
from logwarden.schema import RuleError
from logwarden.session import get_session
from logwarden.sources.lines import read_log_lines
from logwarden.sources.tables import list_reports, write_report_tables

__all__ = [
    "Analysis",
    "EXTRA_RULES",
    "RuleError",
    "SHIPPED_RULES",
    "analyze",
    "analyze_lines",
    "analyze_parsed",
    "build_rules",
    "burst_segments",
    "detect",
    "entries_of",
    "get_session",
    "incident_findings",
    "incidents",
    "list_reports",
    "parse_auth_log",
    "parse_errors",
    "parse_lines",
    "parse_web_log",
    "read_log_lines",
    "register_rule",
    "signature_findings",
    "signature_hits",
    "sliding_counts",
    "source_stats",
    "threshold_findings",
    "total_stats",
    "write_report_tables",
]
