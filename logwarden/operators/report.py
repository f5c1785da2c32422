"""Report views over findings, incidents and parse errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.operators.correlate import incident_findings
from logwarden.schema import DEFAULT_WINDOW_MINUTES

# How much of a bad line the two reports show.
SHORT_RAW = 50
LONG_RAW = 120


def findings_report(findings: DataFrame) -> DataFrame:
    """Findings by severity (highest first), then rule; equal ones in order of emission."""
    return findings.orderBy(F.desc("severity"), "rule_id", "emit_pos").select(
        "severity_name",
        "rule_id",
        "title",
        F.coalesce("source_ip", F.lit("-")).alias("source_ip"),
        "count",
        F.coalesce(F.nullif(F.array_join(F.array_sort("sources"), ", "), F.lit("")), F.lit("-")).alias("sources"),
        "first_seen",
        "last_seen",
        "description",
        F.size("evidence").alias("evidence_lines"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Number of findings per severity that occurs, highest first."""
    counted = findings.groupBy("severity", "severity_name").agg(F.count("*").alias("findings"))
    return counted.orderBy(F.desc("severity"))


def incident_detail(findings: DataFrame, window_minutes: float = DEFAULT_WINDOW_MINUTES) -> DataFrame:
    """One row per finding of each incident, by severity and rule within the incident."""
    rows = incident_findings(findings, window_minutes).select(
        "incident_id",
        "source_ip",
        "severity",
        "severity_name",
        "rule_id",
        "title",
        "count",
        F.array_join(F.array_sort("sources"), ", ").alias("sources"),
        F.size("evidence").alias("evidence_lines"),
        "emit_pos",
    )
    return rows.orderBy("incident_id", F.desc("severity"), "rule_id", "emit_pos")


def evidence_lines(findings: DataFrame) -> DataFrame:
    """One row per stored evidence line of each finding, in order."""
    return findings.select(
        "rule_id", "source_ip", "emit_pos", F.posexplode("evidence").alias("nth", "line")
    ).select("rule_id", "source_ip", "emit_pos", "nth", "line.source", "line.line_no", "line.raw")


def parse_error_report(errors: DataFrame, length: int = SHORT_RAW) -> DataFrame:
    """Parse errors with the line cut to ``length`` characters."""
    return errors.select("source", "line_no", "reason", F.substring("raw", 1, length).alias("raw"))


def all_findings(*parts: DataFrame) -> DataFrame:
    """Union of the findings of all detectors."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def cap_evidence(findings: DataFrame, max_evidence: int) -> DataFrame:
    """Findings with at most ``max_evidence`` evidence lines; counts and matches stay."""
    if max_evidence < 0:
        raise ValueError(f"max_evidence must be >= 0, got {max_evidence!r}")
    return findings.withColumn("evidence", F.slice("evidence", 1, max_evidence))


