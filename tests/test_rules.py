from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logwarden.operators.entries import parse_auth_log
from logwarden.operators.correlate import cluster_findings, incident_findings, incidents, span_text
from logwarden.operators.signature import signature_findings, signature_hits
from logwarden.plans import rules as R
from logwarden.plans.analyze import analyze_lines, guarded
from logwarden.schema import FINDING_COLUMNS, FINDINGS, RuleError

ENTRY = (
    "kind STRING, ts TIMESTAMP, source STRING, line_no BIGINT, pos BIGINT, raw STRING, source_ip STRING, "
    "target STRING, user_agent STRING, referrer STRING, message STRING"
)


def web(spark, targets):
    rows = [("web", None, "s", i, i, f"raw{i}", ip, t, None, None, None) for i, (ip, t) in enumerate(targets, 1)]
    return spark.createDataFrame(rows, ENTRY).withColumn("ts", F.timestamp_seconds("pos"))


def signature(patterns, **params):
    return R.build_rules([{"id": "r", "type": "signature", "params": {"patterns": patterns, **params}}])


def hits(spark, rules, targets):
    return [(r.line_no, r.pattern, r.snippet) for r in
            signature_hits(web(spark, targets), rules).orderBy("line_no").collect()]


def test_first_form_then_first_pattern_wins(spark):
    rules = signature(["b+", "A", r"it's \\"])
    assert hits(spark, rules, [("i", "aabb"), ("i", "%41%62"), ("i", "%2541"), ("i", ""), ("i", None), ("i", "it's \\")]) == [
        (1, "b+", "bb"), (2, "b+", "b"), (3, "A", "A"), (6, r"it's \\", "it's \\")]


def test_passes_case_and_back_references(spark):
    assert hits(spark, signature(["A"], max_decode_passes=0), [("i", "%41"), ("i", "a")]) == [(2, "A", "a")]
    assert hits(spark, signature(["A"], case_sensitive=True), [("i", "a"), ("i", "A")]) == [(2, "A", "A")]
    assert hits(spark, signature([r"(x)\1", r"(y)\1"]), [("i", "xy"), ("i", "yy")]) == [(2, r"(y)\1", "yy")]


def test_aggregate_per_ip_with_null_as_a_group(spark):
    targets = [("a", "x"), (None, "x"), ("a", "x"), ("b", "x"), (None, "x"), ("a", "n")]
    found = signature_findings(web(spark, targets), signature(["x"], min_hits=2, max_evidence=1)).collect()
    assert sorted((str(r.source_ip), r["count"], r.emit_pos, len(r.evidence), len(r.matches)) for r in found) == [
        ("None", 2, 5, 1, 1), ("a", 2, 3, 1, 1)]
    none = signature_findings(web(spark, targets), signature(["x"], max_evidence=0)).collect()
    assert {len(r.evidence) for r in none} == {0} and len(none) == 3


def test_first_hits_beyond_the_group_limit(spark, monkeypatch):
    from logwarden.operators import signature as S

    rows = [(r, ip, p) for p in range(400) for r, ip in [(0, "a"), (1, "b")] if (p * 7 + r) % 3]
    hits = spark.createDataFrame(rows, "rule INT, ip STRING, pos BIGINT").repartition(5)
    few = {tuple(r) for r in S.first_hits(hits, 60).collect()}
    monkeypatch.setattr(S, "GROUP_LIMIT", 10)
    assert {tuple(r) for r in S.first_hits(hits, 60, chunk_bits=3).collect()} == few and len(few) == 120


def test_last_spec_of_an_id_wins_at_the_first_place(spark):
    specs = [
        {"id": "a", "type": "signature", "params": {"patterns": ["1"]}},
        {"id": "b", "type": "signature", "severity": "low", "params": {"patterns": ["2"], "severity": " Critical "}},
        {"id": "a", "type": "threshold", "params": {"match": "web_404", "threshold": 2, "window_seconds": 1.5}},
        {"id": "c", "type": "signature", "enabled": False},
    ]
    built = R.build_rules(specs)
    assert [(r.id, r.type, r.severity) for r in built] == [("a", "threshold", 30), ("b", "signature", 50)]
    table = R.rules_table(spark, specs)
    assert [(r.id, r.pos, r.type) for r in R.rule_catalogue(table).orderBy("pos").collect()] == [
        ("a", 0, "threshold"), ("b", 1, "signature")]
    assert [s["id"] for s in R.specs_from_table(table)] == ["a", "b", "a", "c"]


@pytest.mark.parametrize(
    "spec,words",
    [
        ({"type": "signature", "params": {"patterns": []}}, "has no id"),
        ({"id": "x", "type": "bogus"}, "no such type as 'bogus'"),
        ({"id": "x", "type": "signature", "severity": "bad", "params": {"patterns": []}}, "unknown severity"),
        ({"id": "x", "type": "signature", "params": {}}, "missing parameter 'patterns'"),
        ({"id": "x", "type": "signature", "params": {"patterns": ["("]}}, "bad pattern"),
        ({"id": "x", "type": "signature", "params": {"patterns": [], "max_decode_passes": -1}}, "max_decode_passes"),
        ({"id": "x", "type": "signature", "params": {"patterns": [], "target": "cookie"}}, "unknown signature target"),
        ({"id": "x", "type": "signature", "params": {"patterns": [], "max_evidence": -1}}, "max_evidence"),
        ({"id": "x", "type": "threshold", "params": {"match": "web_404", "threshold": 0, "window_seconds": 1}}, "threshold"),
        ({"id": "x", "type": "threshold", "params": {"match": "web_404", "threshold": 1, "window_seconds": 0}}, "window"),
        ({"id": "x", "type": "threshold", "params": {"match": "no", "threshold": 1, "window_seconds": 1}}, "match preset"),
        ({"id": "x", "type": "threshold", "params": {"match": "web_404", "threshold": 1, "window_seconds": 1, "k": 1}}, "'k'"),
    ],
)
def test_faulty_rules_are_refused_by_name(spark, spec, words):
    with pytest.raises(RuleError, match=words) as error:
        R.build_rules([spec], spark)
    assert "id" not in spec or "'x'" in str(error.value)
    assert R.rule_violations(R.rules_table(spark, [spec])).count() == 1


def findings(spark, rows):
    """(rule, ip, first, last, sources) in order of emission."""
    data = [(r, r.upper(), 40, "HIGH", "", ip, f, l, 1, s, [], [], {}, n, 0) for n, (r, ip, f, l, s) in enumerate(rows)]
    schema = (
        "rule_id STRING, title STRING, severity INT, severity_name STRING, description STRING, source_ip STRING, "
        "f BIGINT, l BIGINT, count BIGINT, sources ARRAY<STRING>, "
        "evidence ARRAY<STRUCT<source: STRING, line_no: BIGINT, raw: STRING>>, "
        "matches ARRAY<STRUCT<pattern: STRING, snippet: STRING, value: STRING>>, metadata MAP<STRING, STRING>, "
        "emit_pos BIGINT, rule_pos INT"
    )
    frame = spark.createDataFrame(data, schema)
    stamps = {"first_seen": F.timestamp_seconds("f"), "last_seen": F.timestamp_seconds("l")}
    return frame.withColumns(stamps).select(*FINDING_COLUMNS)


def greedy(rows, window):
    """Cluster numbers of one IP's findings, walked one by one."""
    out, number, until = {}, 0, None
    for n, (first, last) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        if until is None or first - until > window:
            number, until = number + 1, last
        else:
            until = max(until, last)
        out[n] = number
    return out


def test_clusters_are_those_of_a_greedy_walk(spark):
    import random

    rng = random.Random(8)
    spans = [(f, f + rng.randint(-400, 300)) for f in (rng.randint(0, 40_000) for _ in range(150))]
    found = findings(spark, [("a", "ip", f, last, ["s"]) for f, last in spans])
    got = {r.emit_pos: r.cluster for r in cluster_findings(found, 2).collect()}
    assert got == greedy(spans, 120) and max(got.values()) > 10


def test_incident_gate_severity_and_text(spark):
    rows = [
        ("a", "1.1.1.1", 0, 10, ["w"]), ("b", "1.1.1.1", 610, 700, ["w"]),  # gap of exactly the window
        ("a", "2.2.2.2", 0, 10, ["w"]), ("a", "2.2.2.2", 20, 30, ["w"]),  # one rule, one source
        ("a", "3.3.3.3", 0, 10, ["w", "x"]),  # one finding, two sources
        ("a", None, 0, 1, ["w"]), ("b", None, 0, 1, ["x"]),  # no address
        ("a", "4.4.4.4", 0, 10, ["w"]), ("b", "4.4.4.4", 611, 700, ["w"]),  # too far apart
    ]
    found = findings(spark, rows)
    got = incidents(found).collect()
    assert [(r.source_ip, r.severity_name, r.finding_count) for r in got] == [
        ("1.1.1.1", "CRITICAL", 2), ("3.3.3.3", "CRITICAL", 1)]
    assert got[0].narrative == (
        "1.1.1.1 triggered 2 findings across 2 rule(s) (A, B) over w within 0:11:40 "
        "(1970-01-01T00:00:00+00:00 → 1970-01-01T00:11:40+00:00).")
    assert got[0].incident_id.startswith("INC-") and len(got[0].incident_id) == 14
    assert sorted(r.emit_pos for r in incident_findings(found).collect()) == [0, 1, 4]
    assert incidents(found, 0).count() == 1 and incidents(found, 30).count() == 3


def test_span_text_matches_timedelta(spark):
    from datetime import timedelta

    values = [0, 1, 59_000_000, 214_000_000, 86_400_000_000, 90_061_500_000, 200_000_000_000, -60_000_000, -90_000_000_000]
    frame = spark.createDataFrame([(v,) for v in values], "v BIGINT")
    assert [r[0] for r in frame.select(span_text(F.col("v"))).collect()] == [str(timedelta(microseconds=v)) for v in values]


def test_patterns_that_cannot_be_joined_and_numbers_with_parts(spark):
    stamp = "10/Mar/2024:00:00:0{}"
    hits = [("w", 0, i, f'1.1.1.1 - - [{stamp.format(i)} +0000] "GET /login?x=foo%20passwd HTTP/1.1" 401 5', "web") for i in range(1, 8)]
    hits += [("w", 0, 8, "junk\nmore", "web"), ("w", 0, 9, hits[0][3][:-1] + "9" * 20, "web")]
    lines = spark.createDataFrame(hits, "source STRING, source_idx INT, line_no BIGINT, value STRING, format STRING")
    specs = [
        {"id": "named", "type": "signature", "params": {"patterns": ["(?<x>foo)", "(?<x>bar)", "(?x)passwd # c", "\\Qpasswd"]}},
        {"id": "half", "type": "threshold", "params": {"match": "web_login_failure", "threshold": 4.5, "window_seconds": 60}},
    ]
    rules = R.build_rules(specs, spark)
    assert rules[1].threshold == 4.5
    run = analyze_lines(lines, specs)
    assert {(r.rule_id, r["count"]) for r in run.findings.collect()} == {("named", 7), ("half", 7)}
    assert {(r.line_no, r.reason) for r in run.parse_errors.collect()} == {(8, "does not match Combined log format"), (9, "number too large")}
    for bad in ({"threshold": "5"}, {"threshold": True}, {"max_evidence": 1.5}):
        params = {"match": "web_login_failure", "threshold": 5, "window_seconds": 60} | bad
        with pytest.raises(RuleError):
            R.build_rules([{"id": "x", "type": "threshold", "params": params}], spark)


def test_zone_of_syslog_stamps(spark):
    line = "Jan  1 00:30:00 h sshd[9]: Failed password for root from 1.1.1.1 port 22 ssh2"
    lines = spark.createDataFrame([("a", 0, 1, line)], "source STRING, source_idx INT, line_no BIGINT, value STRING")
    east = timezone(timedelta(hours=2))
    at = lambda **o: parse_auth_log(lines, **o).select(F.unix_seconds("ts")).first()[0]
    new_year = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert at(default_year=2024, tz=east) == new_year.timestamp() + 1800 - 7200
    assert at(reference_time=new_year, tz=east) == new_year.timestamp() + 1800 - 7200
    assert at(reference_time=new_year) == datetime(2023, 1, 1, 0, 30, tzinfo=timezone.utc).timestamp()


def test_a_built_in_rule_that_fails_leaves_the_others(spark):
    rules = R.build_rules([{"id": i, "type": "signature", "params": {"patterns": ["x"]}} for i in ("good", "bad", "fine")], spark)

    def find(some):
        frame = spark.createDataFrame([(r.id,) for r in some], "rule_id STRING")
        faulty = "if(rule_id = 'bad', raise_error('no'), rule_id) AS rule_id"
        return frame.selectExpr(faulty, *[f"NULL AS {c}" for c in FINDING_COLUMNS if c != "rule_id"]).to(spark.createDataFrame([], FINDINGS).schema)

    assert {r.rule_id for part in guarded(rules, find) for r in part.collect()} == {"good", "fine"}
    assert guarded([], find) == []
