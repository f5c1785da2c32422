"""Rule sets: the shipped rules, merging, checking, and user-defined rule types."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.presets import DISTINCTS, KINDS, MATCHES, TARGETS
from logwarden.schema import DEFAULT_DECODE_PASSES, DEFAULT_MAX_EVIDENCE, SEVERITIES, RuleError, severity_level

# The shipped rules.
SHIPPED_RULES: list[dict[str, Any]] = [
    {
        "id": "ssh_brute_force",
        "type": "threshold",
        "severity": "high",
        "params": {
            "match": "auth_failure",
            "threshold": 5,
            "window_seconds": 60,
            "title": "SSH Brute Force",
            "description": "Repeated SSH authentication failures from one IP.",
        },
    },
    {
        "id": "web_login_brute_force",
        "type": "threshold",
        "severity": "medium",
        "params": {
            "match": "web_login_failure",
            "threshold": 10,
            "window_seconds": 60,
            "title": "Web Login Brute Force",
            "description": "Repeated failed web logins (401/403) from one IP.",
        },
    },
    {
        "id": "web_scanning",
        "type": "threshold",
        "severity": "medium",
        "params": {
            "match": "web_404",
            "distinct_by": "path",
            "threshold": 15,
            "window_seconds": 120,
            "title": "Web Scanning",
            "description": "Many distinct 404 paths from one IP (enumeration).",
        },
    },
    {
        "id": "directory_traversal",
        "type": "signature",
        "severity": "high",
        "params": {
            "target": "request_target",
            "title": "Directory Traversal",
            "description": "Path traversal sequences in the request target.",
            "patterns": [r"\.\./", r"\.\.\\", "/etc/passwd", "/etc/shadow", r"\bboot\.ini\b", "%2e%2e"],
        },
    },
    {
        "id": "sql_injection",
        "type": "signature",
        "severity": "high",
        "params": {
            "target": "request_target",
            "title": "SQL Injection",
            "description": "SQL-injection syntax in the request target.",
            "patterns": [
                r"union\s+select",
                r"\bor\s+1\s*=\s*1\b",
                r"'\s*or\s*'1'\s*=\s*'1",
                r'"\s*or\s*"1"\s*=\s*"1',
                r"'\s*or\s+\w",
                r"'\s*--",
                r"'\s*#",
                r"\bsleep\s*\(",
                r"\bbenchmark\s*\(",
                "information_schema",
                "xp_cmdshell",
                r"\bdrop\s+table\b",
                r";\s*(?:drop|delete|update|insert|alter|truncate)\b",
            ],
        },
    },
    {
        "id": "sensitive_file_exposure",
        "type": "signature",
        "severity": "high",
        "params": {
            "target": "request_target",
            "title": "Sensitive File / Credential Exposure Probing",
            "description": "Request for source control, environment, backup, or key material.",
            "patterns": [
                r"\.git/",
                r"\.svn/",
                r"\.env(\.|$|\?)",
                r"\.aws/credentials",
                "id_rsa",
                r"\.ssh/",
                r"\.htpasswd",
                r"\.pem$",
                r"wp-config\.php",
                r"config\.php",
                r"\.bak$",
                r"\.sql$",
                r"\.tar\.gz$",
                r"docker-compose\.ya?ml",
                r"\.DS_Store",
            ],
        },
    },
    {
        "id": "scanner_user_agent",
        "type": "signature",
        "severity": "medium",
        "params": {
            "target": "user_agent",
            "title": "Known Scanner / Attack-Tool User-Agent",
            "description": "Request identifies itself as a known scanning or exploitation tool.",
            "patterns": [
                "sqlmap",
                r"\bnikto\b",
                r"\bnessus\b",
                r"\bmasscan\b",
                r"\bnmap\b",
                "acunetix",
                "netsparker",
                r"\bw3af\b",
                "dirbuster",
                "gobuster",
                "feroxbuster",
                r"\bzgrab\b",
                "^-$",
            ],
        },
    },
    {
        "id": "sudo_privilege_escalation",
        "type": "signature",
        "severity": "critical",
        "params": {
            "target": "auth_message",
            "title": "Sudo Access to Sensitive Files / Credentials",
            "description": "A sudo command read or copied credential material.",
            "patterns": [
                r"COMMAND=.*\bcat\b.*shadow",
                r"COMMAND=.*\bcat\b.*passwd\b",
                "COMMAND=.*id_rsa",
                r"COMMAND=.*\.ssh/",
                r"COMMAND=.*\.aws/credentials",
                r"COMMAND=.*\buseradd\b",
                r"COMMAND=.*\busermod\b.*sudo",
            ],
        },
    },
]

# Rules the documentation shows as additions.
EXTRA_RULES: list[dict[str, Any]] = [
    {
        "id": "credential_stuffing",
        "type": "threshold",
        "severity": "high",
        "params": {
            "match": "auth_failure",
            "distinct_by": "username",
            "threshold": 20,
            "window_seconds": 300,
            "title": "Credential Stuffing",
            "description": "Many distinct usernames failing auth from one IP.",
        },
    },
    {
        "id": "xss_probe",
        "type": "signature",
        "severity": "medium",
        "params": {
            "target": "query",
            "title": "XSS Probe",
            "description": "Script-injection syntax in the query string.",
            "patterns": [r"<script\b", "javascript:", r"onerror\s*="],
        },
    },
]

# Parameters each type takes; True marks a required one.
PARAMETERS: dict[str, dict[str, bool]] = {
    "threshold": {
        "match": True,
        "threshold": True,
        "window_seconds": True,
        "severity": False,
        "distinct_by": False,
        "title": False,
        "description": False,
        "max_evidence": False,
    },
    "signature": {
        "patterns": True,
        "severity": False,
        "target": False,
        "title": False,
        "description": False,
        "case_sensitive": False,
        "min_hits": False,
        "max_evidence": False,
        "max_decode_passes": False,
    },
}


@dataclass(frozen=True, kw_only=True)
class Rule:
    """A checked rule, ready to become column expressions."""

    id: str
    type: str
    position: int
    severity: int
    title: str
    description: str = ""
    max_evidence: int = DEFAULT_MAX_EVIDENCE
    match: str | None = None
    threshold: int = 1
    window_seconds: float = 0.0
    distinct_by: str | None = None
    target: str = "request_target"
    patterns: tuple[str, ...] = ()
    case_sensitive: bool = False
    min_hits: int = 1
    max_decode_passes: int = DEFAULT_DECODE_PASSES
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def window_us(self) -> int:
        return round(self.window_seconds * 1_000_000)


Detector = Callable[[DataFrame, Rule], DataFrame]
RULE_TYPES: dict[str, Detector] = {}


def register_rule(type_name: str) -> Callable[[Detector], Detector]:
    """Decorator: make ``fn(entries, rule) -> findings`` a rule type with free parameters."""

    def keep(fn: Detector) -> Detector:
        RULE_TYPES[type_name] = fn
        return fn

    return keep


class LiveDetector(Protocol):
    """What a live run needs of a user-defined rule type: the findings of a whole run, met batch by batch.

    State is kept by address like that of the built-in rules: a batch reads what earlier batches left of the buckets of its
    addresses (other addresses are among the rows) and adds rows of its own.
    """

    #: SQL columns of a state row behind ``rule INT, ip STRING``.
    state: str

    def update(self, entries: DataFrame, rule: Rule, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Alerts (``ip, ts, count, source, pos``) of a batch of entries, and rows (``ip`` and the state's columns) to add to the state."""

    def fold(self, state: DataFrame) -> DataFrame:
        """The same state in fewer rows."""


LIVE_TYPES: dict[str, LiveDetector] = {}


def register_live_rule(type_name: str, detector: LiveDetector) -> None:
    """Let rules of a registered type alert in live runs too; ``LiveRun.finalize`` uses the type's function for whole runs."""
    LIVE_TYPES[type_name] = detector


def java_pattern(pattern: str, case_sensitive: bool = False) -> str:
    """The pattern with Unicode classes and ``\\n`` as the only line end."""
    return ("(?dU)" if case_sensitive else "(?iudU)") + pattern


def merge_rules(specs: Iterable[dict[str, Any]]) -> list[dict[str, Any]]:
    """The last spec of an id wins whole, at the position of the first; disabled ones go."""
    by_id: dict[Any, dict[str, Any]] = {}
    for number, spec in enumerate(specs):
        by_id[spec.get("id", ("no id", number))] = spec
    return [spec for spec in by_id.values() if spec.get("enabled", True)]


def rules_table(spark: SparkSession, specs: Iterable[dict[str, Any]]) -> DataFrame:
    """Specs as a table ``pos, id, type, enabled, severity, params`` (params as JSON text)."""
    rows = [
        (
            i,
            s.get("id"),
            s.get("type"),
            bool(s.get("enabled", True)),
            None if s.get("severity") is None else str(s["severity"]),
            json.dumps(s.get("params", {})),
        )
        for i, s in enumerate(specs)
    ]
    return spark.createDataFrame(
        rows, "pos INT, id STRING, type STRING, enabled BOOLEAN, severity STRING, params STRING"
    )


def rule_catalogue(rules: DataFrame) -> DataFrame:
    """Active rules of a rules table: last spec per id, first position, without disabled ones."""
    last = F.max_by(F.struct("type", "enabled", "severity", "params"), F.col("pos"))
    return (
        rules.groupBy("id")
        .agg(F.min("pos").alias("pos"), last.alias("spec"))
        .where("spec.enabled")
        .select("pos", "id", "spec.type", "spec.severity", "spec.params")
    )


def specs_from_table(rules: DataFrame) -> list[dict[str, Any]]:
    """Specs of a rules table on the driver (a rule set is configuration, not data)."""
    rows = rules.orderBy("pos").collect()
    return [
        {"id": r.id, "type": r.type, "enabled": r.enabled, "params": json.loads(r.params or "{}")}
        | ({} if r.severity is None else {"severity": r.severity})
        for r in rows
    ]


def unknown_presets(rules: DataFrame) -> DataFrame:
    """(id, reason) of every preset a rule names that does not exist."""
    spark = rules.sparkSession
    known = spark.createDataFrame(
        [(kind, name) for kind, (_, names) in KINDS.items() for name in names], "kind STRING, name STRING"
    )
    labels = F.create_map(*[F.lit(x) for kind, (label, _) in KINDS.items() for x in (kind, label)])
    takes = {"match": "threshold", "distinct_by": "threshold", "target": "signature"}
    named = rules.select(
        "id",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("kind"),
                        F.when(F.col("type") == takes[kind], F.get_json_object("params", f"$.{kind}")).alias("name"),
                    )
                    for kind in KINDS
                ]
            )
        ),
    ).where("name IS NOT NULL AND NOT (kind = 'distinct_by' AND name = '')")
    reason = F.concat(F.lit("unknown "), F.element_at(labels, F.col("kind")), F.lit(" '"), F.col("name"), F.lit("'"))
    return named.join(F.broadcast(known), ["kind", "name"], "left_anti").select("id", reason.alias("reason"))


def _bad_patterns(spark: SparkSession, patterns: Iterable[str]) -> set[str]:
    regex = spark._jvm.java.util.regex.Pattern
    bad = set()
    for pattern in patterns:
        try:
            regex.compile(java_pattern(pattern))
        except Exception:  # noqa: BLE001 (any syntax error means the same)
            bad.add(pattern)
    return bad


def rule_violations(rules: DataFrame) -> DataFrame:
    """One row (id, reason) per fault of the active rules in a rules table."""
    spark = rules.sparkSession
    active = rules.where("enabled")
    types = sorted(set(PARAMETERS) | set(RULE_TYPES))
    params = F.from_json("params", "MAP<STRING, STRING>")
    fixed = active.where(F.col("type").isin(*PARAMETERS))
    known = spark.createDataFrame(
        [(t, p, need) for t, ps in PARAMETERS.items() for p, need in ps.items()],
        "type STRING, param STRING, required BOOLEAN",
    )
    given = fixed.select("pos", "id", "type", F.explode(F.map_keys(params)).alias("param"))
    value = lambda name: F.get_json_object("params", f"$.{name}")
    number = lambda name: value(name).try_cast("double")
    threshold = fixed.where("type = 'threshold'")
    signature = fixed.where("type = 'signature'")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    named = F.upper(F.trim(F.coalesce(value("severity"), F.col("severity"))))
    levels = [*SEVERITIES, *[str(v) for v in SEVERITIES.values()]]
    faults = [
        active.where("id IS NULL").select("id", F.lit("missing id").alias("reason")),
        active.where(F.col("type").isNull() | ~F.col("type").isin(*types)).select(
            "id", say("unknown rule type '", F.coalesce("type", F.lit("")), "'")
        ),
        active.where(named.isNotNull() & ~named.isin(*levels)).select("id", say("unknown severity '", named, "'")),
        given.drop("pos").distinct().join(F.broadcast(known), ["type", "param"], "left_anti").select(
            "id", say("unknown parameter '", F.col("param"), "'")
        ),
        fixed.select("pos", "id", "type")
        .join(F.broadcast(known.where("required")), "type")
        .join(given.select("pos", "param"), ["pos", "param"], "left_anti")
        .select("id", say("missing parameter '", F.col("param"), "'")),
        threshold.where(value("threshold").isNotNull() & ~F.coalesce(number("threshold") >= 1, F.lit(False))).select(
            "id", F.lit("threshold must be >= 1")
        ),
        threshold.where(
            value("window_seconds").isNotNull() & ~F.coalesce(number("window_seconds") > 0, F.lit(False))
        ).select("id", F.lit("window_seconds must be > 0")),
        signature.where(
            value("max_decode_passes").isNotNull() & ~F.coalesce(number("max_decode_passes") >= 0, F.lit(False))
        ).select("id", F.lit("max_decode_passes must be >= 0")),
        fixed.where(value("max_evidence").isNotNull() & ~F.coalesce(number("max_evidence") >= 0, F.lit(False))).select(
            "id", F.lit("max_evidence must be >= 0")
        ),
        unknown_presets(active),
    ]
    pattern = F.explode(F.from_json(value("patterns"), "ARRAY<STRING>"))
    used = signature.select("id", pattern.alias("pattern"))
    # Regex syntax can only be checked by the regex library itself; a rule set's patterns
    # are configuration, so their distinct texts are few.
    bad = _bad_patterns(spark, [r.pattern for r in used.select("pattern").distinct().collect()])
    if bad:
        faults.append(used.where(F.col("pattern").isin(*sorted(bad))).select("id", say("bad pattern '", F.col("pattern"), "'")))
    result = faults[0]
    for fault in faults[1:]:
        result = result.unionAll(fault)
    return result


def build_rules(specs: Iterable[dict[str, Any]], spark: SparkSession | None = None) -> list[Rule]:
    """Checked rules from specs; the first fault raises, naming the rule."""
    rules = []
    for position, spec in enumerate(merge_rules(specs)):
        if "id" not in spec or spec["id"] is None:
            raise RuleError(f"a rule has no id: {spec!r}")
        rule_id, type_name = spec["id"], spec.get("type")
        if type_name not in PARAMETERS and type_name not in RULE_TYPES:
            raise RuleError(f"rule {rule_id!r}: no such type as {type_name!r}")
        try:
            rules.append(_build(position, spec, spark))
        except (RuleError, TypeError, ValueError) as error:
            raise RuleError(f"rule {rule_id!r}: {error}") from error
    return rules


def _build(position: int, spec: dict[str, Any], spark: SparkSession | None) -> Rule:
    params = dict(spec.get("params") or {})
    type_name = spec["type"]
    severity = params.pop("severity", None)
    severity = spec.get("severity") if severity is None else severity
    default = "medium" if type_name == "threshold" else "high"
    common = {
        "id": spec["id"],
        "type": type_name,
        "position": position,
        "severity": severity_level(default if severity is None else severity),
        "title": params.pop("title", None) or spec["id"],
        "description": params.pop("description", ""),
        "max_evidence": params.pop("max_evidence", DEFAULT_MAX_EVIDENCE),
    }
    numbers = {"max_evidence": common["max_evidence"]} | {n: v for n, v in params.items() if n in NUMBERS and type_name in PARAMETERS}
    for name, given in numbers.items():
        if isinstance(given, bool) or not isinstance(given, (int, float)) or name in WHOLE and given != int(given):
            raise RuleError(f"{name} must be a {'whole ' * (name in WHOLE)}number, got {given!r}")
    if common["max_evidence"] < 0:
        raise RuleError(f"max_evidence must be >= 0, got {common['max_evidence']!r}")
    if type_name not in PARAMETERS:
        return Rule(**common, extra=params)

    takes = PARAMETERS[type_name]
    for name in params:
        if name not in takes:
            raise RuleError(f"unknown parameter {name!r}")
    for name, required in takes.items():
        if required and name not in params:
            raise RuleError(f"missing parameter {name!r}")
    if "patterns" in params and (isinstance(params["patterns"], str) or not all(isinstance(p, str) for p in params["patterns"])):
        raise RuleError(f"patterns must be a list of texts, got {params['patterns']!r}")
    rule = Rule(**common, **{k: tuple(v) if k == "patterns" else v for k, v in params.items()})
    if type_name == "threshold":
        if rule.threshold < 1:
            raise RuleError(f"threshold must be >= 1, got {rule.threshold!r}")
        if rule.window_seconds <= 0:
            raise RuleError(f"window_seconds must be > 0, got {rule.window_seconds!r}")
        _known("match", rule.match, MATCHES)
        if rule.distinct_by:
            _known("distinct_by", rule.distinct_by, DISTINCTS)
    else:
        if rule.max_decode_passes < 0:
            raise RuleError(f"max_decode_passes must be >= 0, got {rule.max_decode_passes!r}")
        _known("target", rule.target, TARGETS)
        if spark is not None and (bad := _bad_patterns(spark, rule.patterns)):
            raise RuleError(f"bad pattern {sorted(bad)[0]!r}")
    return rule


#: Parameters that are numbers, and those that have no parts.
NUMBERS = ("threshold", "window_seconds", "min_hits", "max_decode_passes", "max_evidence")
WHOLE = ("min_hits", "max_decode_passes", "max_evidence")


def _known(kind: str, name: Any, names: dict[str, Any]) -> None:
    if name not in names:
        raise RuleError(f"unknown {KINDS[kind][0]} {name!r}")
