"""One query per operator, each over whole test tables."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixture import mixed_lines, run_lines, write_files
from logwarden.functions import fields as X
from logwarden.functions.decode import decode_variants
from logwarden.functions.presets import DISTINCTS, MATCHES, TARGETS, normal_path
from logwarden.operators.correlate import (
    cluster_findings,
    escalate_severity,
    incident_findings,
    incident_gate,
    incident_id,
    incident_narrative,
    incidents,
    iso_utc,
)
from logwarden.operators.entries import entries_of, parse_auth_log, parse_errors, parse_lines, parse_web_log
from logwarden.operators.report import (
    all_findings,
    cap_evidence,
    evidence_lines,
    findings_report,
    incident_detail,
    parse_error_report,
    severity_counts,
)
from logwarden.operators.signature import signature_findings, signature_hits
from logwarden.operators.stats import source_stats, total_stats
from logwarden.operators.threshold import burst_segments, sliding_counts, threshold_findings
from logwarden.plans import rules as R
from logwarden.plans.analyze import analyze, analyze_parsed, detect
from logwarden.schema import FINDING_COLUMNS
from logwarden.session import materialise, scratch_path
from logwarden.sources.catalogue import (
    build_sources,
    detect_format,
    known_sources,
    newest_web_stamp,
    skipped_sources,
)
from logwarden.sources.lines import drop_blank_lines, read_log_lines, source_files, unreadable_sources
from logwarden.sources.tables import list_reports, read_report_table, reports_in, write_report_tables
from logwarden.streaming.follow import TAILS, assemble_partial_lines, follow_chunks
from logwarden.streaming.live import LiveRun

Query = Callable[[SparkSession, str], DataFrame]

ANCHOR = datetime(2024, 12, 31, 23, 59, 59, tzinfo=timezone.utc)
GENERATED = datetime(2024, 6, 1, 12, 30, 15, tzinfo=timezone.utc)

SHIPPED = {spec["id"]: spec for spec in R.SHIPPED_RULES + R.EXTRA_RULES}


def tuned(rule_id: str, **params: object) -> dict:
    """A known rule with some parameters changed, so that the test data sets it off."""
    spec = SHIPPED[rule_id]
    return spec | {"params": spec["params"] | params}


RUN_SPECS = [
    tuned("ssh_brute_force"),
    tuned("web_login_brute_force", threshold=5),
    tuned("web_scanning", threshold=8),
    *[SHIPPED[i] for i in (
        "directory_traversal", "sql_injection", "sensitive_file_exposure", "scanner_user_agent",
        "sudo_privilege_escalation")],
]
SIGNATURES = [s for s in RUN_SPECS if s["type"] == "signature"]
WINDOW_MINUTES = 0.5


def parsed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(run_lines(spark, sf_dir), reference_time=ANCHOR)


def run_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(parsed_run(spark, sf_dir))


def run_findings(spark: SparkSession, sf_dir: str, specs: list[dict] | None = None) -> DataFrame:
    entries = materialise(run_entries(spark, sf_dir), "entries", ["kind"])
    return detect(entries, R.build_rules(specs or RUN_SPECS, spark))


SECONDS = "unix_seconds({0}) AS {0}"
FINDING_VIEW = [
    "rule_id", "title", "severity", "severity_name", "description", "source_ip", SECONDS.format("first_seen"),
    SECONDS.format("last_seen"), "count", "array_join(sources, ',') AS sources", "emit_pos", "rule_pos",
]
EVIDENCE_TEXT = "array_join(transform(evidence, e -> concat(e.source, ':', e.line_no)), ',') AS evidence"
MATCH_TEXT = (
    "array_join(transform(matches, m -> concat_ws('|', m.pattern, m.snippet, m.value)), ',') AS matches"
)
PLACE = ["source", "line_no"]


# --- sources and sinks ------------------------------------------------------------------------

LABEL = "regexp_extract({0}, 'source=([^/]+)', 1)"


def s1_read_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_log_lines(spark, [write_files(spark, sf_dir)])
    return lines.selectExpr(f"{LABEL.format('source')} AS source", "source_idx", "line_no", "value")


def s2_drop_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_blank_lines(run_lines(spark, sf_dir)).select(*PLACE, "value")


def s3_unreadable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_files(spark, sf_dir)
    regions = [r.r_name for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect()]
    errors = unreadable_sources(spark, [folder, *[f"{folder}/missing-{name}.log" for name in regions]])
    short = "regexp_extract({0}, '(missing.*)$', 1) AS {0}"
    return errors.selectExpr(short.format("source"), "line_no", short.format("raw"), short.format("reason"))


def s4_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_format(mixed_lines(spark, sf_dir), now=ANCHOR)


def s5_skipped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skipped_sources(build_sources(mixed_lines(spark, sf_dir), now=ANCHOR))


def s6_build_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [write_files(spark, sf_dir)]
    files = source_files(spark, paths)
    catalogue = known_sources(build_sources(read_log_lines(spark, paths, files), files, now=ANCHOR))
    return catalogue.selectExpr(f"{LABEL.format('source')} AS source", "source_idx", "format")


def s7_reference_time_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialise(mixed_lines(spark, sf_dir), "mixed")
    newest = newest_web_stamp(lines, build_sources(lines, now=ANCHOR))
    return newest.selectExpr("unix_seconds(ts) AS anchor", "utc_offset")


def s8_write_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = run_findings(spark, sf_dir, SIGNATURES)
    folder = scratch_path(spark, "reports")
    write_report_tables({"findings": findings}, folder, generated_at=GENERATED)
    kept = read_report_table(spark, folder, "findings")
    return kept.groupBy("run_id", "rule_id").agg(F.count("*").alias("findings"), F.sum("count").alias("hits"))


def s9_list_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    stamp = "date_format(o_orderdate, 'yyyy_MM_dd')"
    names = orders.selectExpr(
        f"CASE WHEN o_orderkey % 5 = 0 THEN concat('notes_', o_orderkey) "
        f"WHEN o_orderkey % 7 = 0 THEN concat('report_', {stamp}, '_25_00_00') "
        f"ELSE concat('report_', {stamp}, '_', lpad(cast(o_orderkey % 24 AS STRING), 2, '0'), '_10_00') END AS run_id"
    ).distinct()
    return reports_in(names).selectExpr("run_id", "unix_seconds(generated_at) AS generated_at")


def s9_list_written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(source_stats(parsed_run(spark, sf_dir)), "stats")  # written three times
    folder = scratch_path(spark, "reports")
    for hour in (3, 1, 2):
        write_report_tables({"stats": stats}, folder, generated_at=GENERATED.replace(hour=hour))
    lines = read_report_table(spark, folder, "stats").groupBy("run_id").agg(F.sum("lines_read").alias("lines_read"))
    runs = list_reports(spark, folder).join(lines, "run_id")
    return runs.selectExpr("run_id", "unix_seconds(generated_at) AS generated_at", "lines_read")


# --- parsing ----------------------------------------------------------------------------------


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_web_log(run_lines(spark, sf_dir).where("format = 'web'"))


def _auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_auth_log(run_lines(spark, sf_dir).where("format = 'auth'"), reference_time=ANCHOR)


WEB_VIEW = [
    *PLACE, "unix_seconds(ts) AS ts", "source_ip", "method", "target", "path", "query", "protocol", "status", "size",
    "identity", "user AS user_name", "referrer", "user_agent",
]


def p1_parse_web_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web(spark, sf_dir).selectExpr(*WEB_VIEW)


def p2_web_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as stamps with many offsets, some of them broken."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    zone = "element_at(array('+0000', '-0730', '+0530', '+1400', '+2400', '-0060', ''), cast(o_orderkey % 7 + 1 AS INT))"
    clock = "concat(o_orderkey % 25, ':', o_orderkey % 60, ':', o_orderkey % 61)"
    stamp = f"concat(date_format(o_orderdate, 'd/MMM/yyyy'), ':', {clock}, ' ', {zone})"
    lines = orders.selectExpr(
        "'orders' AS source",
        "0 AS source_idx",
        "cast(o_orderkey AS BIGINT) AS line_no",
        f"""concat('h - - [', {stamp}, '] "GET / HTTP/1.1" 200 1') AS value""",
        "'web' AS format",
    )
    return parse_lines(lines).selectExpr("line_no", "unix_seconds(ts) AS ts", "reason")


def p3_split_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of each document as a request line."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    split = documents.selectExpr("doc_id", "text AS request").selectExpr("*", f"{X.request_tokens('request')} AS tokens")
    return split.selectExpr(
        "doc_id",
        f"{X.request_method('tokens')} AS method",
        f"md5({X.request_target('tokens')}) AS target_md5",
        f"{X.request_protocol('tokens')} AS protocol",
    )


def p4_dash_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _web(spark, sf_dir).selectExpr(
        *PLACE, "source_ip", "identity", "user AS user_name", "status", "size", "referrer", "user_agent"
    )


def p5_split_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.selectExpr("page_id", f"{X.target_path('url')} AS path", f"{X.target_query('url')} AS query")


def p6_parse_auth_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auth(spark, sf_dir).selectExpr(
        *PLACE, "unix_seconds(ts) AS ts", "hostname", "process", "pid", "message"
    )


def p7_resolve_syslog_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates without their year, against an anchor in the spring of a leap year."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    clock = "concat(lpad(cast(o_orderkey % 25 AS STRING), 2, '0'), ':30:', lpad(cast(o_orderkey % 61 AS STRING), 2, '0'))"
    lines = orders.selectExpr(
        "'orders' AS source",
        "0 AS source_idx",
        "cast(o_orderkey AS BIGINT) AS line_no",
        f"concat(date_format(o_orderdate, 'MMM d'), ' ', {clock}, ' host app: done') AS value",
        "'auth' AS format",
    )
    anchor = datetime(2024, 2, 20, 12, tzinfo=timezone.utc)
    return parse_lines(lines, reference_time=anchor).selectExpr("line_no", "unix_seconds(ts) AS ts", "reason")


def p8_classify_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auth(spark, sf_dir).select(*PLACE, "outcome", "username")


def p9_extract_ip_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auth(spark, sf_dir).select(*PLACE, "source_ip", "source_port")


def p10_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_errors(parsed_run(spark, sf_dir))


def p11_parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_entries(spark, sf_dir).selectExpr(
        "kind", *PLACE, "pos", "unix_seconds(ts) AS ts", "source_ip", "target", "status", "outcome", "username", "raw"
    )


# --- presets ----------------------------------------------------------------------------------


def _matching(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_entries(spark, sf_dir).where(MATCHES[name]()).select(*PLACE, "source_ip")

    return query


def f4_distinct_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = run_entries(spark, sf_dir).select(DISTINCTS["path"]().alias("path")).groupBy("path")
    return counted.agg(F.count("*").alias("entries"))


def f4_normal_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "concat(url, '//') AS url")
    return pages.selectExpr("page_id", f"{normal_path('url')} AS path")


def f5_distinct_username(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = run_entries(spark, sf_dir).select(DISTINCTS["username"]().alias("username")).groupBy("username")
    return counted.agg(F.count("*").alias("entries"))


def f6_signature_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = run_entries(spark, sf_dir).select(*PLACE, *[make().alias(name) for name, make in TARGETS.items()])
    return values.select(*PLACE, *TARGETS)


def _part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rules table made from ``part``: repeated ids, some disabled, many with a fault."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = "p_partkey"
    return part.selectExpr(
        f"cast({k} AS INT) AS pos",
        f"concat('rule', {k} % 700) AS id",
        f"CASE WHEN {k} % 11 = 0 THEN 'sequence' WHEN {k} % 2 = 0 THEN 'threshold' ELSE 'signature' END AS type",
        f"{k} % 5 <> 0 AS enabled",
        f"CASE {k} % 6 WHEN 0 THEN 'high' WHEN 1 THEN ' Low ' WHEN 2 THEN 'urgent' END AS severity",
        f"""CASE WHEN {k} % 2 = 0 THEN concat(
              '{{"match": "', element_at(array('auth_failure', 'web_404', 'dns'), cast({k} % 3 + 1 AS INT)),
              '", "threshold": ', {k} % 4, ', "window_seconds": ', {k} % 9 - 1,
              CASE WHEN {k} % 8 = 0 THEN ', "distinct_by": "port"' ELSE '' END,
              CASE WHEN {k} % 14 = 0 THEN ', "colour": "red"' ELSE '' END, '}}')
            ELSE concat(
              '{{"target": "', element_at(array('path', 'query', 'cookie'), cast({k} % 3 + 1 AS INT)), '"',
              CASE WHEN {k} % 7 = 0 THEN '' WHEN {k} % 9 = 0 THEN ', "patterns": ["a(b"]' ELSE ', "patterns": ["a+"]' END,
              CASE WHEN {k} % 13 = 0 THEN ', "max_decode_passes": -1' ELSE '' END, '}}') END AS params""",
    )


def f7_unknown_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unknown_presets(_part_rules(spark, sf_dir))


# --- signatures -------------------------------------------------------------------------------


def g1_decode_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = run_entries(spark, sf_dir).where("target IS NOT NULL")
    variants = entries.select(*PLACE, decode_variants(F.col("target")).alias("v"))
    return variants.selectExpr(*PLACE, "size(v) AS forms", "array_join(v, ' ') AS variants")


def g1_decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with every blank written as an escape, twice over."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = documents.selectExpr("doc_id", "replace(replace(text, '%', ''), ' ', '%2520') AS text")
    variants = coded.select("doc_id", decode_variants(F.col("text")).alias("v"))
    return variants.selectExpr("doc_id", "size(v) AS forms", "md5(element_at(v, -1)) AS last_md5")


HIT_VIEW = [*PLACE, "source_ip", "pattern", "snippet", "value"]


def g2_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [SHIPPED["sql_injection"], SHIPPED["directory_traversal"]]
    return signature_hits(run_entries(spark, sf_dir), R.build_rules(specs)).select("rule", *HIT_VIEW)


def g3_signature_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = R.build_rules([tuned("sensitive_file_exposure", min_hits=3, max_evidence=2)])
    entries = run_entries(spark, sf_dir)
    return signature_findings(entries, rules).selectExpr(*FINDING_VIEW, MATCH_TEXT)


def g4_capped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = R.build_rules([tuned("directory_traversal", max_evidence=4)])
    found = signature_findings(run_entries(spark, sf_dir), rules)
    return found.selectExpr("rule_id", "source_ip", "count", EVIDENCE_TEXT)


def g5_all_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = run_entries(spark, sf_dir)
    return signature_findings(entries, R.build_rules(SIGNATURES)).selectExpr(*FINDING_VIEW, EVIDENCE_TEXT, MATCH_TEXT)


def _signature(rule_id: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        entries = run_entries(spark, sf_dir)
        return signature_findings(entries, R.build_rules([SHIPPED[rule_id]])).selectExpr(*FINDING_VIEW, MATCH_TEXT)

    return query


# --- thresholds -------------------------------------------------------------------------------

SSH = tuned("ssh_brute_force")
SCAN = tuned("web_scanning", threshold=8)
LOGIN = tuned("web_login_brute_force", threshold=5)
STUFFING = tuned("credential_stuffing", threshold=8)


def _counts(spec: dict) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = sliding_counts(run_entries(spark, sf_dir), R.build_rules([spec]))
        return counts.selectExpr(
            "rule_id", "source_ip", "pos", SECONDS.format("ts"), "count", SECONDS.format("front_ts")
        )

    return query


def t3_burst_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    bursts = burst_segments(run_entries(spark, sf_dir), R.build_rules([SSH, SCAN]))
    return bursts.selectExpr("rule_id", "source_ip", "pos", "burst")


def _threshold(*specs: dict) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        entries = materialise(run_entries(spark, sf_dir), "entries", ["kind"])  # read for the counts and for the evidence
        found = threshold_findings(entries, R.build_rules(specs))
        return found.selectExpr(*FINDING_VIEW, EVIDENCE_TEXT)

    return query


def t1_event_time_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sliding_counts(run_entries(spark, sf_dir), R.build_rules([SSH]), order="event_time")
    return counts.selectExpr("rule_id", "source_ip", "pos", "count")


# --- correlation, statistics, reports ---------------------------------------------------------


def c1_all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = materialise(run_entries(spark, sf_dir), "entries", ["kind"])
    rules = R.build_rules(RUN_SPECS)
    return all_findings(signature_findings(entries, rules), threshold_findings(entries, rules)).selectExpr(*FINDING_VIEW)


def c2_cap_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = cap_evidence(run_findings(spark, sf_dir), 3)
    return capped.selectExpr("rule_id", "emit_pos", "count", "size(matches) AS matches", EVIDENCE_TEXT)


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_findings(run_findings(spark, sf_dir), WINDOW_MINUTES)


def c3_cluster_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir).select("rule_id", "source_ip", "emit_pos", "cluster")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident_gate(_clustered(spark, sf_dir))


def c4_incident_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).selectExpr(
        "source_ip", "cluster", "finding_count", "array_join(rule_ids, ',') AS rule_ids",
        "array_join(sources, ',') AS sources", SECONDS.format("first_seen"), SECONDS.format("last_seen"),
    )


def c5_escalate_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("source_ip", "cluster", escalate_severity(F.col("top")).alias("severity"))


def c6_incident_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = incident_id(F.col("source_ip"), F.col("first_seen"), F.col("rule_ids"))
    return _gated(spark, sf_dir).select("source_ip", "cluster", made.alias("incident_id"))


def c6_iso_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", iso_utc(F.col("ts").cast("timestamp")).alias("iso"))


def c7_incident_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("source_ip", "cluster", incident_narrative().alias("narrative"))


INCIDENT_VIEW = [
    "incident_id", "title", "severity", "severity_name", "source_ip", SECONDS.format("first_seen"),
    SECONDS.format("last_seen"), "finding_count", "narrative",
]


def c8_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(run_findings(spark, sf_dir), WINDOW_MINUTES).selectExpr(*INCIDENT_VIEW)


def c8_incident_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incident_findings(run_findings(spark, sf_dir), WINDOW_MINUTES)
    return rows.select("incident_id", "rule_id", "source_ip", "emit_pos")


def r1_source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_stats(parsed_run(spark, sf_dir))


def r2_total_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = materialise(parsed_run(spark, sf_dir), "parsed", ["kind"])
    findings = materialise(detect(entries_of(parsed), R.build_rules(RUN_SPECS, spark)), "findings")
    return total_stats(source_stats(parsed), findings, incidents(findings, WINDOW_MINUTES))


def r3_findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = findings_report(run_findings(spark, sf_dir))
    return report.withColumns({c: F.unix_seconds(c) for c in ("first_seen", "last_seen")})


def r4_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_counts(run_findings(spark, sf_dir))


def r5_incident_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident_detail(run_findings(spark, sf_dir), WINDOW_MINUTES)


def r6_evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_lines(run_findings(spark, sf_dir))


def r7_parse_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_error_report(parse_errors(parsed_run(spark, sf_dir)), 30)


def r8_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run from parsed lines to incidents."""
    parsed = materialise(parsed_run(spark, sf_dir), "parsed", ["kind"])
    result = analyze_parsed(parsed, R.build_rules(RUN_SPECS, spark), window_minutes=WINDOW_MINUTES)
    return result.incidents.selectExpr(*INCIDENT_VIEW)


def r8_analyze_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run from text files: formats detected, years anchored to the newest web stamp."""
    result = analyze(spark, [write_files(spark, sf_dir)], RUN_SPECS, now=ANCHOR)
    return result.totals


# --- streaming --------------------------------------------------------------------------------


def _whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of complete lines of whole sources, with the end of the chunk before as ``given``.

    The chunks of a source are ordered by slim rows without their texts, so no task holds a source.
    """
    lines = run_lines(spark, sf_dir).selectExpr("source", "line_no", "value", "(line_no - 1) div 200 AS nth")
    text = "concat(array_join(transform(array_sort(collect_list(struct(line_no, value))), x -> x.value), '\\n'), '\\n')"
    whole = materialise(lines.groupBy("source", "nth").agg(F.expr(f"{text} AS text")), "chunks")
    ends = materialise(whole.selectExpr("source", "nth", "right(text, 9) AS end"), "ends")
    order = "OVER (PARTITION BY source ORDER BY nth)"
    placed = ends.selectExpr("source", "nth", f"coalesce(lag(end) {order}, '') AS given", f"lead(nth) {order} IS NULL AS last")
    return whole.join(placed, ["source", "nth"]).selectExpr("source", "lpad(cast(nth AS STRING), 8, '0') AS chunk", "text", "given", "last")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole sources that end in the middle of lines: each lends its end to the next."""
    return _whole_chunks(spark, sf_dir).selectExpr("source", "chunk", "concat(given, left(text, length(text) - 9)) AS text")


def _sources(spark: SparkSession, lines: DataFrame) -> DataFrame:
    return lines.select("source", "source_idx", "format").distinct()


def _live(spark: SparkSession, sf_dir: str, specs: list[dict]) -> LiveRun:
    """A live run over the lines of the run table: one half, then, after a restart, the other."""
    landing = scratch_path(spark, "landing")
    lines = run_lines(spark, sf_dir)
    half = spark.read.parquet(f"{sf_dir}/events.parquet").count() / 2
    run = LiveRun(spark, scratch_path(spark, "live"), _sources(spark, lines), specs, reference_time=ANCHOR)
    for part in (f"line_no <= {half}", f"line_no > {half}"):
        lines.where(part).select("source", "line_no", "value").write.mode("append").parquet(landing)
        stream = spark.readStream.schema("source STRING, line_no BIGINT, value STRING").parquet(landing)
        run.start_lines(stream, availableNow=True).awaitTermination()
    return run


def x1_follow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk files of complete lines, followed until all are read."""
    landing = write_files(spark, sf_dir)
    run = LiveRun(spark, scratch_path(spark, "live"), _sources(spark, run_lines(spark, sf_dir)), [])

    def keep(chunks: DataFrame, batch_id: int) -> None:
        done, tails = assemble_partial_lines(chunks, run._left_by("tails", TAILS, batch_id))
        run._write_together({"lines": done, "tails": tails}, batch_id)

    stream = follow_chunks(spark, landing, max_files=3)
    run._start(stream, keep, {"availableNow": True}).awaitTermination()
    return run.table("lines").selectExpr("regexp_extract(source, 'source=(.+)', 1) AS source", "line_no", "value")


def x2_assemble_partial_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = assemble_partial_lines(_chunks(spark, sf_dir), spark.createDataFrame([], TAILS))
    return lines.select("source", "line_no", F.md5("value").alias("value_md5"))


def x2_assemble_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every source, from chunks that end in the middle of lines; the last line has no line end and is held as the tail."""
    # each chunk but the last lends its end to the next; the last has no line end
    chunks = _whole_chunks(spark, sf_dir).selectExpr(
        "source", "chunk", "concat(given, left(text, length(text) - if(last, 1, 9))) AS text"
    )
    done, tails = assemble_partial_lines(chunks, spark.createDataFrame([], TAILS))
    held = tails.selectExpr("source", "lines + 1 AS line_no", "tail AS value", "true AS held")
    return done.selectExpr("source", "line_no", "value", "false AS held").unionByName(held).select("source", "line_no", F.md5("value").alias("value_md5"), "held")


def x3_stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _live(spark, sf_dir, []).table("parsed")
    return parsed.selectExpr("kind", *PLACE, "unix_seconds(ts) AS ts", "source_ip", "reason")


ALERT_VIEW = ["rule_id", "source_ip", SECONDS.format("ts"), "count", "source"]


def x4_stream_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [tuned("sql_injection", min_hits=3), tuned("scanner_user_agent", min_hits=2)]
    return _live(spark, sf_dir, specs).live_alerts().selectExpr(*ALERT_VIEW)


def x5_stream_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir, [SSH, SCAN]).live_alerts().selectExpr(*ALERT_VIEW)


def x6_live_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _live(spark, sf_dir, RUN_SPECS).live_alerts()
    seen = alerts.where("seen_at > ts").groupBy("rule_id", "title", "severity_name")
    return seen.agg(F.count("*").alias("alerts"))


def x6_live_alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir, RUN_SPECS).live_alerts().where("seen_at > ts").selectExpr(*ALERT_VIEW)


def x7_finalize_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _live(spark, sf_dir, RUN_SPECS).finalize(window_minutes=WINDOW_MINUTES)
    return report.findings.selectExpr(
        "rule_id", "source_ip", SECONDS.format("first_seen"), SECONDS.format("last_seen"), "count",
        "array_join(sources, ',') AS sources",
    )


def x8_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parsed line of the late source is there and counts."""
    parsed = _live(spark, sf_dir, [LOGIN]).table("parsed")
    entries = parsed.where("kind IN ('web', 'auth')").selectExpr("source", "pos", "unix_seconds(ts) AS at", "shiftright(pos, 16) AS chunk")
    # the latest stamp before is that of earlier chunks or of the own one, so no task orders a whole source
    tops = entries.groupBy("source", "chunk").agg(F.max("at").alias("top"))
    before = "max(top) OVER (PARTITION BY source ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_before"
    late = entries.join(tops.selectExpr("source", "chunk", before), ["source", "chunk"]).selectExpr(
        "source", "at < greatest(max(at) OVER (PARTITION BY source, chunk ORDER BY pos), top_before) AS late"
    )
    return late.groupBy("source").agg(F.count("*").alias("entries"), F.count_if("late").alias("late_entries"))


# --- rules ------------------------------------------------------------------------------------


def u1_rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rule_catalogue(_part_rules(spark, sf_dir))


def u2_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rule_violations(_part_rules(spark, sf_dir)).groupBy("id", "reason").agg(F.count("*").alias("n"))


def _big_transfer(entries: DataFrame, rule: R.Rule) -> DataFrame:
    """A user's own detector: addresses that were sent more than ``limit`` bytes in all."""
    totals = entries.where("kind = 'web'").groupBy("source_ip").agg(
        F.sum("size").alias("total"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.collect_set("source").alias("sources"), F.min("pos").alias("emit_pos"),
    )
    return totals.where(F.col("total") > rule.extra["limit"]).select(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.title).alias("title"), F.lit(rule.severity).alias("severity"),
        F.lit("HIGH").alias("severity_name"), F.lit(rule.description).alias("description"), "source_ip", "first_seen",
        "last_seen", F.col("total").alias("count"), F.array_sort("sources").alias("sources"),
        F.array().cast("array<struct<source:string,line_no:bigint,raw:string>>").alias("evidence"),
        F.array().cast("array<struct<pattern:string,snippet:string,value:string>>").alias("matches"),
        F.create_map(F.lit("limit"), F.lit(str(rule.extra["limit"]))).alias("metadata"), "emit_pos",
        F.lit(rule.position).alias("rule_pos"),
    ).select(*FINDING_COLUMNS)


def _broken(entries: DataFrame, rule: R.Rule) -> DataFrame:
    found = _big_transfer(entries, replace(rule, extra={"limit": 0}))
    return found.withColumn("rule_id", F.expr("cast(raise_error(concat('bad rule for ', title)) AS STRING)"))


BIG = {"id": "big_transfer", "type": "big_transfer", "params": {"limit": 5000, "title": "Big Transfer"}}


def u3_register_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.register_rule("big_transfer")(_big_transfer)
    return run_findings(spark, sf_dir, [BIG]).selectExpr("rule_id", "title", "source_ip", "severity", "count")


class BigTransferLive:
    """The detector ``big_transfer`` batch by batch: the bytes so far are its state, and the entry that passes the limit alerts."""

    state = "total BIGINT"

    def update(self, entries: DataFrame, rule: R.Rule, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        sent = entries.where("kind = 'web' AND size > 0").selectExpr("coalesce(source_ip, '') AS ip", "ts", "source", "pos", "size")
        so_far = sent.selectExpr("*", "sum(size) OVER (PARTITION BY ip ORDER BY pos ROWS UNBOUNDED PRECEDING) AS own")
        known = so_far.join(self.fold(state), "ip", "left").selectExpr("*", "own + coalesce(total, 0L) AS count")
        limit = rule.extra["limit"]
        return known.where(f"count > {limit} AND count - size <= {limit}").drop("total"), sent.groupBy("ip").agg(F.sum("size").alias("total"))

    def fold(self, state: DataFrame) -> DataFrame:
        return state.groupBy("ip").agg(F.sum("total").alias("total"))


def u3_live_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own rule type in a live run; the addresses it alerts on are those of the whole run's findings."""
    R.register_rule("big_transfer")(_big_transfer)
    R.register_live_rule("big_transfer", BigTransferLive())
    run = _live(spark, sf_dir, [BIG])
    found = run.finalize(window_minutes=WINDOW_MINUTES).findings
    alerts = run.live_alerts().groupBy("rule_id", "source_ip").agg(F.count("*").alias("alerts"))
    both = found.selectExpr("rule_id", "source_ip", "0L AS alerts", "count AS total").unionByName(alerts.selectExpr("*", "0L AS total"))
    return both.groupBy("rule_id", "source_ip").agg(F.sum("alerts").alias("alerts"), F.sum("total").alias("total"))


def u4_rule_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed rule is named in a table of the run."""
    R.register_rule("big_transfer")(_big_transfer)
    R.register_rule("broken")(_broken)
    parsed = materialise(parsed_run(spark, sf_dir), "parsed", ["kind"])
    logger = logging.getLogger("logwarden")
    level = logger.level
    logger.setLevel(logging.ERROR)
    try:
        result = analyze_parsed(parsed, R.build_rules([{"id": "broken", "type": "broken"}, BIG], spark))
    finally:
        logger.setLevel(level)
    return result.rule_failures.join(result.totals.select("findings", "lines_read")).selectExpr("rule_id", "type", "findings", "lines_read")


def u4_rule_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that fails while it runs, between two that do not."""
    R.register_rule("big_transfer")(_big_transfer)
    R.register_rule("broken")(_broken)
    specs = [SHIPPED["sql_injection"], {"id": "broken", "type": "broken"}, BIG]
    logger = logging.getLogger("logwarden")
    level = logger.level
    logger.setLevel(logging.ERROR)
    try:
        found = run_findings(spark, sf_dir, specs)
    finally:
        logger.setLevel(level)
    return found.groupBy("rule_id").agg(F.count("*").alias("findings"), F.sum("count").alias("total"))


QUERIES: dict[str, Query] = {
    "read_log_lines": s1_read_log_lines,
    "drop_blank_lines": s2_drop_blank_lines,
    "unreadable_sources": s3_unreadable_sources,
    "detect_format": s4_detect_format,
    "skipped_sources": s5_skipped_sources,
    "build_sources": s6_build_sources,
    "reference_time_anchor": s7_reference_time_anchor,
    "write_report_tables": s8_write_report_tables,
    "list_reports": s9_list_reports,
    "list_written_reports": s9_list_written_reports,
    "parse_web_log": p1_parse_web_log,
    "web_timestamp": p2_web_timestamp,
    "split_request": p3_split_request,
    "dash_to_null": p4_dash_to_null,
    "split_target": p5_split_target,
    "parse_auth_log": p6_parse_auth_log,
    "resolve_syslog_year": p7_resolve_syslog_year,
    "classify_auth": p8_classify_auth,
    "extract_ip_port": p9_extract_ip_port,
    "parse_errors": p10_parse_errors,
    "parse_lines": p11_parse_lines,
    "auth_failure": _matching("auth_failure"),
    "web_login_failure": _matching("web_login_failure"),
    "web_404": _matching("web_404"),
    "distinct_path": f4_distinct_path,
    "normal_url": f4_normal_url,
    "distinct_username": f5_distinct_username,
    "signature_targets": f6_signature_targets,
    "unknown_presets": f7_unknown_presets,
    "decode_variants": g1_decode_variants,
    "decode_text": g1_decode_text,
    "pattern_hits": g2_pattern_hits,
    "signature_findings": g3_signature_findings,
    "capped_evidence": g4_capped_evidence,
    "all_signatures": g5_all_signatures,
    "directory_traversal": _signature("directory_traversal"),
    "sql_injection": _signature("sql_injection"),
    "sensitive_file_exposure": _signature("sensitive_file_exposure"),
    "scanner_user_agent": _signature("scanner_user_agent"),
    "sudo_privilege_escalation": _signature("sudo_privilege_escalation"),
    "xss_probe": _signature("xss_probe"),
    "sliding_count": _counts(SSH),
    "sliding_count_event_time": t1_event_time_count,
    "sliding_distinct_count": _counts(SCAN),
    "burst_segments": t3_burst_segments,
    "threshold_findings": _threshold(SSH, LOGIN, SCAN),
    "ssh_brute_force": _threshold(SSH),
    "web_login_brute_force": _threshold(LOGIN),
    "web_scanning": _threshold(SCAN),
    "credential_stuffing": _threshold(STUFFING),
    "all_findings": c1_all_findings,
    "cap_evidence": c2_cap_evidence,
    "cluster_findings": c3_cluster_findings,
    "incident_gate": c4_incident_gate,
    "escalate_severity": c5_escalate_severity,
    "incident_id": c6_incident_id,
    "iso_stamp": c6_iso_stamp,
    "incident_narrative": c7_incident_narrative,
    "incidents": c8_incidents,
    "incident_findings": c8_incident_findings,
    "source_stats": r1_source_stats,
    "total_stats": r2_total_stats,
    "findings_report": r3_findings_report,
    "severity_counts": r4_severity_counts,
    "incident_detail": r5_incident_detail,
    "evidence_lines": r6_evidence_lines,
    "parse_error_report": r7_parse_error_report,
    "analyze": r8_analyze,
    "analyze_files": r8_analyze_files,
    "follow_lines": x1_follow_lines,
    "assemble_partial_lines": x2_assemble_partial_lines,
    "assemble_all_lines": x2_assemble_all_lines,
    "stream_parse": x3_stream_parse,
    "stream_signatures": x4_stream_signatures,
    "stream_thresholds": x5_stream_thresholds,
    "live_alerts": x6_live_alerts,
    "live_alert_rows": x6_live_alert_rows,
    "finalize_stream": x7_finalize_stream,
    "late_data": x8_late_data,
    "rule_catalogue": u1_rule_catalogue,
    "rule_violations": u2_rule_violations,
    "register_rule": u3_register_rule,
    "live_rule": u3_live_rule,
    "rule_failures": u4_rule_failures,
    "rule_isolation": u4_rule_isolation,
}
