"""Signature rules: regex search over decoded fields, summed up per (rule, source IP)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions.decode import decode_once
from logwarden.functions.presets import TARGETS
from logwarden.plans.rules import Rule, java_pattern
from logwarden.schema import CHUNK_BITS, severity_name, sql_text
from logwarden.session import materialise

# What changes its meaning inside a joined pattern: references and names of groups, quotes, flags and comments.
NOT_JOINED = re.compile(r"\\[1-9]|\\k<|\\Q|\(\?<[A-Za-z]|\(\?[a-zA-Z-]+[:)]|#")

# Up to this limit Spark prunes ``row_number`` ranks before the shuffle, by its default setting.
GROUP_LIMIT = 1000


def _hit(rule: Rule, rule_no: int, forms: list[str]) -> str:
    """SQL: first hit in form-major, pattern-minor order as a struct, NULL where nothing matches.

    One regex of all patterns tells per form whether anything matches, so a clean row costs
    one search per form that differs from the last. Only a row that hits walks the patterns
    in order.
    """
    regexes = [sql_text(java_pattern(p, rule.case_sensitive)) for p in rule.patterns]
    if any(NOT_JOINED.search(p) for p in rule.patterns):
        matches = lambda form: "(" + " OR ".join(f"{form} rlike {r}" for r in regexes) + ")"
    else:
        together = java_pattern("|".join(f"(?:{p})" for p in rule.patterns), rule.case_sensitive)
        matches = lambda form: f"{form} rlike {sql_text(together)}"

    def first_in(form: str) -> str:
        branches = [
            f"WHEN {form} rlike {regex} THEN named_struct('rule', {rule_no}, 'pattern', {sql_text(pattern)}, "
            f"'snippet', regexp_extract({form}, {regex}, 0), 'value', {forms[0]})"
            for pattern, regex in zip(rule.patterns, regexes)
        ]
        return f"CASE {' '.join(branches)} END"

    ordered = [f"WHEN {matches(forms[0])} THEN {first_in(forms[0])}"]
    for before, form in zip(forms, forms[1:]):
        ordered.append(f"WHEN {form} <> {before} AND {matches(form)} THEN {first_in(form)}")
    return f"CASE WHEN length({forms[0]}) > 0 THEN CASE {' '.join(ordered)} END END"


def signature_hits(entries: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per (entry, signature rule that hits it); all rules in one pass over the entries."""
    rules = [r for r in rules if r.type == "signature" and r.patterns]
    wanted = ["ts", "source", "line_no", "pos", "raw", "source_ip"]
    if not rules:
        hit = "rule INT, pattern STRING, snippet STRING, value STRING"
        empty = F.from_json(F.lit(None).cast("string"), hit)
        return entries.select(*wanted, F.inline(F.array(empty))).where(F.lit(False))

    names = sorted({r.target for r in rules})
    passes = {n: max(r.max_decode_passes for r in rules if r.target == n) for n in names}
    forms = {n: [f"_{n}_{i}" for i in range(passes[n] + 1)] for n in names}
    staged = entries.select(*wanted, *[TARGETS[n]().alias(forms[n][0]) for n in names])
    for depth in range(1, max(passes.values()) + 1):
        more = [decode_once(F.col(forms[n][depth - 1])).alias(forms[n][depth]) for n in names if depth <= passes[n]]
        staged = staged.select("*", *more)
    hits = [
        _hit(rule, rule_no, forms[rule.target][: rule.max_decode_passes + 1])
        for rule_no, rule in enumerate(rules)
    ]
    return staged.selectExpr(*wanted, f"inline(filter(array({', '.join(hits)}), h -> h IS NOT NULL))")


def first_hits(hits: DataFrame, keep: int, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The first ``keep`` hits of each (rule, ip) with their ``rank``.

    Up to ``GROUP_LIMIT``, and the session's own limit if that is lower, Spark applies such a limit before the shuffle too. Beyond it the
    rank is the hits of earlier chunks plus the rank in the chunk, and only the chunks that
    can hold one of the first hits take part.
    """
    in_session = int(hits.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", str(GROUP_LIMIT)))
    if keep <= min(GROUP_LIMIT, in_session):
        ranked = hits.selectExpr("*", "row_number() OVER (PARTITION BY rule, ip ORDER BY pos) AS rank")
        return ranked.where(f"rank <= {keep}")
    chunk = ["rule", "ip", "chunk"]
    chunked = hits.selectExpr("*", f"shiftright(pos, {chunk_bits}) AS chunk")
    before = "PARTITION BY rule, ip ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    counted = chunked.groupBy(*chunk).agg(F.count("*").alias("n"))
    early = counted.selectExpr(*chunk, f"coalesce(sum(n) OVER ({before}), 0L) AS before").where(f"before < {keep}")
    here = "row_number() OVER (PARTITION BY rule, ip, chunk ORDER BY pos)"
    ranked = chunked.join(early, chunk).selectExpr("*", f"before + {here} AS rank")
    return ranked.where(f"rank <= {keep}").drop("chunk", "before")


def signature_findings(entries: DataFrame, rules: list[Rule], *, hits: DataFrame | None = None) -> DataFrame:
    """One finding per (rule, source IP) with at least ``min_hits`` hits over the whole run.

    Totals are hash aggregates with a map-side half, and of the hits themselves only the first
    of each group move, so a group may hold a large share of them.
    """
    rules = [r for r in rules if r.type == "signature" and r.patterns]
    if hits is None:  # read twice below: every regex runs once
        hits = materialise(signature_hits(entries, rules), "hits")
    hits = hits.withColumn("ip", F.coalesce(F.col("source_ip"), F.lit("")))
    totals = hits.groupBy("rule", "ip").agg(
        F.count("*").alias("count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.collect_set("source").alias("sources"),
    )
    keep = max([max(r.max_evidence, r.min_hits, 1) for r in rules], default=1)
    shown = (
        f"CASE WHEN rank <= {per_rule([r.max_evidence for r in rules])} THEN "
        "struct(rank, struct(source, line_no, raw) AS evidence, struct(pattern, snippet, value) AS match) END"
    )
    fires_at = f"CASE WHEN rank = {per_rule([max(r.min_hits, 1) for r in rules])} THEN pos END"
    detail = (
        first_hits(hits, keep)
        .groupBy("rule", "ip")
        .agg(F.expr(f"array_sort(collect_list({shown})) AS shown"), F.expr(f"max({fires_at}) AS emit_pos"))
    )
    enough = totals.where(f"count >= {per_rule([r.min_hits for r in rules])}")
    return with_rule_text(
        enough.join(detail, ["rule", "ip"]),
        rules,
        evidence="shown.evidence",
        matches="shown.match",
        metadata=[{"target": r.target} for r in rules],
    )


def per_rule(values: list[int | bool | str | None]) -> str:
    """SQL: the value that belongs to the row's rule."""
    if all(isinstance(v, bool) for v in values):
        literals = [str(v).lower() for v in values]
    elif all(isinstance(v, int) for v in values):
        wide = "L" if max(map(abs, values), default=0) >= 2**31 else ""
        literals = [f"{v}{wide}" for v in values]
    elif all(isinstance(v, (int, float)) for v in values):
        literals = [f"{float(v)!r}D" for v in values]
    else:
        literals = [sql_text(v) for v in values]
    return f"get(array({', '.join(literals)}), rule)"


def with_rule_text(
    found: DataFrame, rules: list[Rule], *, evidence: str, matches: str, metadata: list[dict[str, object]]
) -> DataFrame:
    """Findings layout: the rule's own texts beside what was measured."""
    text = lambda v: sql_text(v if v is None else str(v))
    maps = [f"map({', '.join(f'{text(k)}, {text(v)}' for k, v in m.items())})" for m in metadata]
    measured = found.selectExpr("*", f"{per_rule([r.severity for r in rules])} AS severity")
    return measured.selectExpr(
        f"{per_rule([r.id for r in rules])} AS rule_id",
        f"{per_rule([r.title for r in rules])} AS title",
        "severity",
        f"{severity_name('severity')} AS severity_name",
        f"{per_rule([r.description for r in rules])} AS description",
        "nullif(ip, '') AS source_ip",
        "first_seen",
        "last_seen",
        "cast(count AS BIGINT) AS count",
        "array_sort(sources) AS sources",
        f"{evidence} AS evidence",
        f"{matches} AS matches",
        f"get(array({', '.join(maps)}), rule) AS metadata",
        "emit_pos",
        f"{per_rule([r.position for r in rules])} AS rule_pos",
    )
