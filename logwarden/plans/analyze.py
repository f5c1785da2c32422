"""A whole run: lines to entries to findings to incidents, with statistics."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.operators.correlate import incident_findings, incidents
from logwarden.operators.entries import entries_of, parse_errors, parse_lines
from logwarden.operators.report import all_findings, cap_evidence
from logwarden.operators.signature import signature_findings
from logwarden.operators.stats import source_stats, total_stats
from logwarden.operators.threshold import threshold_findings
from logwarden.plans.rules import RULE_TYPES, SHIPPED_RULES, Rule, build_rules
from logwarden.schema import (
    DEFAULT_MAX_EVIDENCE,
    DEFAULT_WINDOW_MINUTES,
    FINDING_COLUMNS,
    FINDINGS,
)
from logwarden.session import drop_folders, materialise, scratch_scope
from logwarden.sources.catalogue import (
    build_sources,
    edge_lines,
    known_sources,
    reference_time_anchor,
    require_sources,
    skipped_sources,
)
from logwarden.sources.lines import MAX_BROADCAST_BLOCKS, read_log_lines, scan_files, source_files, unreadable_sources

logger = logging.getLogger("logwarden")


@dataclass
class Analysis:
    """Result tables of one run, which read the intermediate tables that the run wrote until ``close``."""

    findings: DataFrame
    incidents: DataFrame
    incident_findings: DataFrame
    parse_errors: DataFrame
    source_stats: DataFrame
    totals: DataFrame
    skipped: DataFrame | None = None
    anchored_to_now: bool = False
    duration_seconds: float = 0.0
    rule_failures: DataFrame | None = None
    started_at: datetime | None = None
    scratch: list[str] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(init=False)

    def __post_init__(self) -> None:
        self.tables = {
            "findings": self.findings,
            "incidents": self.incidents,
            "incident_findings": self.incident_findings,
            "parse_errors": self.parse_errors,
            "source_stats": self.source_stats,
            "totals": self.totals,
        }
        if self.rule_failures is not None:
            self.tables["rule_failures"] = self.rule_failures

    def close(self) -> None:
        """Delete the intermediate tables of the run; its own tables cannot be read any more, so write them elsewhere first."""
        drop_folders(self.totals.sparkSession, self.scratch)
        self.scratch.clear()

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def run_row(self) -> DataFrame:
        """One row on the run itself: when it started, how long its detection took, and whether syslog years hang on the clock."""
        return self.totals.sparkSession.createDataFrame(
            [(self.started_at, self.duration_seconds, self.anchored_to_now)],
            "started_at TIMESTAMP, duration_seconds DOUBLE, anchored_to_now BOOLEAN",
        )


FAILURES = "rule_id STRING, type STRING, error STRING"

# Causes, and conditions of Spark, that no rule can be blamed for: storage and the machines themselves.
_MACHINE = re.compile(r"java\.io\.|java\.nio\.file\.|org\.apache\.hadoop\.|OutOfMemory|FetchFailed|ExecutorLost|BlockNotFound")
_LOST = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "FAILED_RENAME")


def _causes(error: BaseException) -> list[str]:
    """Class names of a Spark error and of what caused it, on the JVM."""
    java = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    names: list[str] = []
    while java is not None and len(names) < 30:
        names.append(java.getClass().getName())
        java = java.getCause()
    return names


def is_fault_of_rule(error: Exception) -> bool:
    """Whether evaluating a rule failed, rather than reading, writing or a lost machine; what Spark cannot tell is not blamed on the rule."""
    if isinstance(error, (OSError, MemoryError, Py4JError)) or any(_MACHINE.search(name) for name in _causes(error)):
        return False
    return not (isinstance(error, PySparkException) and (error.getCondition() or "").startswith(_LOST))


Failures = list[tuple[str, str, str]]


def _isolated(error: Exception, rule: Rule, failures: Failures) -> None:
    """Note the failure of one rule; any other error ends the run."""
    if not is_fault_of_rule(error):
        raise error
    logger.warning("rule %s failed: %s", rule.id, error)
    failures.append((rule.id, rule.type, str(error)))


def custom_findings(entries: DataFrame, rule: Rule, failures: Failures) -> DataFrame | None:
    """Findings of a user-defined detector, written at once so that a failure costs only that rule."""
    try:
        found = RULE_TYPES[rule.type](entries, rule).select(*FINDING_COLUMNS)
        return materialise(found, f"custom-{rule.position}")
    except Exception as error:  # noqa: BLE001 (one faulty rule must not end the run)
        _isolated(error, rule, failures)
        return None


def guarded(rules: list[Rule], find: Callable[[list[Rule]], DataFrame], failures: Failures | None = None) -> list[DataFrame]:
    """Findings of a group of rules, written at once; where the group fails, of each of its rules that does not fail alone."""
    failures = [] if failures is None else failures
    if not rules:
        return []
    try:
        return [materialise(find(rules).select(*FINDING_COLUMNS), "found")]
    except Exception as error:  # noqa: BLE001 (one faulty rule must not end the run)
        if len(rules) == 1:
            _isolated(error, rules[0], failures)
            return []
        if not is_fault_of_rule(error):
            raise
        return [found for rule in rules for found in guarded([rule], find, failures)]


def detect(entries: DataFrame, rules: list[Rule], *, order: str = "arrival", failures: Failures | None = None) -> DataFrame:
    """Findings of all rules over ``entries``, which is read more than once.

    A rule that fails while it is evaluated is left out and noted in ``failures`` as (rule id, type, error).
    """
    failures = [] if failures is None else failures
    signatures = [r for r in rules if r.type == "signature" and r.patterns]
    thresholds = [r for r in rules if r.type == "threshold"]
    parts = guarded(signatures, lambda some: signature_findings(entries, some), failures)
    parts += guarded(thresholds, lambda some: threshold_findings(entries, some, order=order), failures)
    for rule in rules:
        if rule.type in RULE_TYPES and (found := custom_findings(entries, rule, failures)) is not None:
            parts.append(found)
    if not parts:
        return entries.sparkSession.createDataFrame([], FINDINGS)
    return all_findings(*parts)


def analyze_parsed(
    parsed: DataFrame,
    rules: list[Rule],
    *,
    source_errors: DataFrame | None = None,
    sources: DataFrame | None = None,
    max_evidence: int = DEFAULT_MAX_EVIDENCE,
    window_minutes: float = DEFAULT_WINDOW_MINUTES,
    order: str = "arrival",
) -> Analysis:
    """Run over parsed lines that can be read several times (a table).

    ``sources``: all sources of the run, so that those without a line have their counters too.
    """
    with scratch_scope(parsed.sparkSession) as scratch:
        started, started_at = time.monotonic(), datetime.now(timezone.utc)
        failures: Failures = []
        findings = materialise(cap_evidence(detect(entries_of(parsed), rules, order=order, failures=failures), max_evidence), "findings")
        errors = parse_errors(parsed)
        if source_errors is not None:
            errors = source_errors.select(errors.columns).unionAll(errors)
        per_source = source_stats(parsed, sources)
        found = incidents(findings, window_minutes)
        return Analysis(
            findings=findings,
            incidents=found,
            incident_findings=incident_findings(findings, window_minutes),
            parse_errors=errors,
            source_stats=per_source,
            totals=total_stats(per_source, findings, found),
            duration_seconds=time.monotonic() - started,
            rule_failures=parsed.sparkSession.createDataFrame(failures, FAILURES),
            started_at=started_at,
            scratch=scratch,
        )


def analyze_lines(
    lines: DataFrame,
    specs: Iterable[dict[str, Any]] = SHIPPED_RULES,
    *,
    reference_time: datetime | None = None,
    default_year: int | None = None,
    tz: timezone = timezone.utc,
    **options: Any,  # noqa: ANN401 (passed on)
) -> Analysis:
    """Run over lines whose ``format`` is known."""
    with scratch_scope(lines.sparkSession):
        rules = build_rules(specs, lines.sparkSession)
        parsed = parse_lines(lines, reference_time=reference_time, default_year=default_year, tz=tz)
        return analyze_parsed(materialise(parsed, "parsed", ["kind"]), rules, **options)


def analyze(
    spark: SparkSession,
    paths: Sequence[str],
    specs: Iterable[dict[str, Any]] = SHIPPED_RULES,
    *,
    reference_time: datetime | None = None,
    default_year: int | None = None,
    tz: timezone = timezone.utc,
    now: datetime | None = None,
    **options: Any,  # noqa: ANN401 (passed on)
) -> Analysis:
    """Run over text files: detect formats, anchor the years, parse, detect, correlate."""
    with scratch_scope(spark):
        started, started_at = time.monotonic(), datetime.now(timezone.utc)
        rules = build_rules(specs, spark)
        files = materialise(source_files(spark, paths), "files")
        scan = scan_files(spark, paths)
        lines = read_log_lines(spark, paths, files, with_total=True, scan=scan)
        edges = materialise(edge_lines(lines), "edges")
        catalogue = materialise(build_sources(lines, files, edges=edges, now=now), "sources")
        require_sources(catalogue)
        anchor = reference_time_anchor(lines, catalogue, edges=edges, override=reference_time, now=now)
        if anchor.fell_back_to_now:
            logger.warning("resolving syslog years against the current time: no web logs and no reference time")
        formats = known_sources(catalogue).select("source", "format")
        if files.count() <= MAX_BROADCAST_BLOCKS:
            formats = F.broadcast(formats)  # the text itself does not move
        parsed = parse_lines(lines.join(formats, "source"), reference_time=anchor.moment, default_year=default_year, tz=tz)
        counted = edges.select("source", "total_lines").distinct()
        unread = unreadable_sources(spark, paths, counted, scan)
        result = analyze_parsed(
            materialise(parsed, "parsed", ["kind"]), rules, source_errors=unread, sources=files.select("source"), **options
        )
        result.duration_seconds, result.started_at = time.monotonic() - started, started_at
        result.skipped = skipped_sources(catalogue)
        result.anchored_to_now = anchor.fell_back_to_now
        return result


