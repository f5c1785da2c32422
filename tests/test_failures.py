"""Failures of rules are data; failures of storage and machines end the run."""

import pytest
from pyspark.sql import functions as F

from logwarden.operators.entries import entries_of as entries_in
from logwarden.operators.entries import parse_lines
from logwarden.operators.threshold import sliding_counts
from logwarden.plans import analyze as A
from logwarden.plans.rules import RULE_TYPES, build_rules, register_rule
from logwarden.schema import FINDINGS
from test_threshold import BASE, entries_of, rule


@pytest.fixture
def types():
    before = dict(RULE_TYPES)
    yield
    RULE_TYPES.clear()
    RULE_TYPES.update(before)


def parsed(spark):
    lines = [("s", 0, n, f"Jan  1 00:00:{n:02d} host sshd[1]: Failed password for root from 2.2.2.2 port 22 ssh2", "auth") for n in range(1, 8)]
    return parse_lines(spark.createDataFrame(lines, "source STRING, source_idx INT, line_no BIGINT, value STRING, format STRING"), default_year=2024)


SPECS = [rule("burst", threshold=3, window_seconds=60), {"id": "bad", "type": "bad"}, {"id": "worse", "type": "worse"}]


def test_failing_rules_are_listed_and_the_others_go_on(spark, types):
    @register_rule("bad")
    def bad(entries, spec):
        raise KeyError("no such column in a user's code")

    @register_rule("worse")
    def worse(entries, spec):
        failing = [F.expr(f"cast(raise_error('while it runs') AS {f.dataType.simpleString()})").alias(f.name) for f in spark.createDataFrame([], FINDINGS).schema]
        return entries.limit(1).select(*failing)

    result = A.analyze_parsed(parsed(spark), build_rules(SPECS))
    assert [(r.rule_id, r.type) for r in result.tables["rule_failures"].collect()] == [("bad", "bad"), ("worse", "worse")]
    assert [r.rule_id for r in result.findings.collect()] == ["burst"]
    row = result.run_row().first()
    assert row.duration_seconds > 0 and row.started_at is not None


def test_failing_storage_ends_the_run(spark, types, monkeypatch, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("a file where a folder is needed")
    monkeypatch.setattr("logwarden.session.scratch_path", lambda spark, name: f"{blocked}/{name}")
    with pytest.raises(Exception) as error:
        A.detect(entries_in(parsed(spark)), build_rules(SPECS[:1]))
    assert not A.is_fault_of_rule(error.value)
    assert not A.is_fault_of_rule(OSError("disk full")) and A.is_fault_of_rule(ValueError("rule"))


def test_sources_without_a_line_have_counters(spark):
    from logwarden.operators.stats import source_stats

    rows = spark.createDataFrame([("full", "auth"), ("full", "blank")], "source STRING, kind STRING")
    listing = spark.createDataFrame([("full",), ("empty",), ("empty",)], "source STRING")
    assert sorted(tuple(r) for r in source_stats(rows, listing).collect()) == [("empty", 0, 0, 0, 0), ("full", 2, 1, 0, 1)]


def test_an_address_in_many_sources_in_the_same_seconds(spark, monkeypatch):
    """What is ordered for one address is one row a second, however many chunks it is in."""
    import logwarden.operators.threshold as T

    seen = []
    whole = T._edges
    monkeypatch.setattr(T, "_edges", lambda edges, rules: seen.append(edges) or whole(edges, rules))
    rows = [(s, n, BASE + n // 2, "a", f"u{n}") for s in range(200) for n in range(1, 9)]
    rules = build_rules([rule("burst", threshold=3, window_seconds=2), rule("users", threshold=3, window_seconds=2, distinct_by="username")])
    got = {(r.rule_id, r.pos): r["count"] for r in sliding_counts(entries_of(spark, rows), rules).collect()}
    assert seen[0].groupBy("rule", "ip").count().agg(F.max("count")).first()[0] == 5
    from models import threshold_model
    from logwarden.schema import POS_LINE_BITS

    events = [((s << POS_LINE_BITS) + n, t * 1_000_000, ip, user, f"s{s}") for s, n, t, ip, user in rows]
    for r in rules:
        want = threshold_model(events, r.window_us, r.threshold, bool(r.distinct_by))[0]
        assert {p: c for p, c, _ in want} == {p: c for (i, p), c in got.items() if i == r.id}
