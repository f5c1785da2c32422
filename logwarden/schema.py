"""Column layouts and fixed names shared by every stage."""

from __future__ import annotations

# Severity levels, names and defaults of the data model.
SEVERITIES = {"INFO": 10, "LOW": 20, "MEDIUM": 30, "HIGH": 40, "CRITICAL": 50}
OUTCOMES = ("failure", "invalid_user", "success", "other")
DEFAULT_MAX_EVIDENCE = 20
DEFAULT_DECODE_PASSES = 2
DEFAULT_WINDOW_MINUTES = 10
SNIFF_LINES = 20

LINES = "source STRING, source_idx INT, line_no BIGINT, value STRING"

PARSE_ERRORS = "source STRING, line_no BIGINT, raw STRING, reason STRING"

FINDING_COLUMNS = [
    "rule_id",
    "title",
    "severity",
    "severity_name",
    "description",
    "source_ip",
    "first_seen",
    "last_seen",
    "count",
    "sources",
    "evidence",
    "matches",
    "metadata",
    "emit_pos",
    "rule_pos",
]

FINDINGS = (
    "rule_id STRING, title STRING, severity INT, severity_name STRING, description STRING, "
    "source_ip STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, count BIGINT, sources ARRAY<STRING>, "
    "evidence ARRAY<STRUCT<source: STRING, line_no: BIGINT, raw: STRING>>, "
    "matches ARRAY<STRUCT<pattern: STRING, snippet: STRING, value: STRING>>, "
    "metadata MAP<STRING, STRING>, emit_pos BIGINT, rule_pos INT"
)

# Arrival order of a line: source position in the run, then line number.
# 40 bits of line number leave 23 bits (8 million) of sources.
POS_LINE_BITS = 40
# Lines of one source that are ordered together in one task: 2 ** CHUNK_BITS.
CHUNK_BITS = 20


class RuleError(ValueError):
    """A rule set, source list or call option that cannot be run."""


def severity_level(value: str | int) -> int:
    """Level for a name (any case, trimmed) or a known level."""
    if isinstance(value, str):
        name = value.strip().upper()
        if name in SEVERITIES:
            return SEVERITIES[name]
    elif not isinstance(value, bool) and value in SEVERITIES.values():
        return int(value)
    raise RuleError(f"unknown severity {value!r}; expected one of {', '.join(SEVERITIES).lower()}")


def severity_name(level: str) -> str:
    """SQL: the name of a level."""
    return f"CASE {level} " + " ".join(f"WHEN {number} THEN '{name}'" for name, number in SEVERITIES.items()) + " END"


def sql_text(value: str | None) -> str:
    """SQL string literal, or a typed NULL."""
    if value is None:
        return "cast(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
