import random

import pytest
from pyspark.sql import functions as F

from logwarden.operators.threshold import burst_segments, sliding_counts, threshold_findings
from logwarden.plans.rules import build_rules
from logwarden.schema import POS_LINE_BITS
from models import threshold_model

ENTRY = (
    "kind STRING, ts TIMESTAMP, source STRING, source_idx INT, line_no BIGINT, pos BIGINT, raw STRING, "
    "source_ip STRING, status INT, path STRING, outcome STRING, username STRING"
)
BASE = 1_704_067_200


def make_events(seed, size, late):
    rng = random.Random(seed)
    rows, t = [], BASE
    ips = ["a", "a", "a", "b", "c", None]
    for number in range(1, size + 1):
        t += rng.choice([0, 0, 0, 1, 1, 2, 9])
        if rng.random() < 0.004:
            t += 90
        stamp = t - (rng.randint(0, 70) if rng.random() < late else 0)
        if late and rng.random() < 0.002:
            stamp += 150
        source = min(number * 3 // size, 2)
        user = rng.choice([None, "u1", "u2", "u3", "u4", "u5", "u6", "u7"])
        rows.append((source, number, stamp, rng.choice(ips), user))
    return rows


def entries_of(spark, rows):
    data = [
        ("auth", None, f"s{s}", s, n, (s << POS_LINE_BITS) + n, f"raw{n}", ip, None, None, "failure", user, t)
        for s, n, t, ip, user in rows
    ]
    frame = spark.createDataFrame(data, ENTRY + ", t BIGINT").repartition(5)
    return frame.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def rule(name, **params):
    return {"id": name, "type": "threshold", "params": {"match": "auth_failure", **params}}


RULES = [
    rule("plain", threshold=5, window_seconds=30),
    rule("short", threshold=2, window_seconds=1.5, max_evidence=3),
    rule("users", threshold=4, window_seconds=40, distinct_by="username", max_evidence=2),
    rule("one", threshold=1, window_seconds=10, max_evidence=0),
    rule("many", threshold=6, window_seconds=60, distinct_by="username"),
]


@pytest.mark.parametrize("late,bits,seed", [(0.0, 20, 1), (0.3, 3, 2), (0.3, 20, 3), (0.1, 0, 4)])
def test_matches_the_queue_model(spark, late, bits, seed):
    rows = make_events(seed, 900, late)
    entries = entries_of(spark, rows).cache()
    rules = build_rules(RULES)
    counts = {(r.rule_id, r.pos): (r["count"], r.front) for r in sliding_counts(entries, rules, chunk_bits=bits)
              .select("rule_id", "pos", "count", F.unix_micros("front_ts").alias("front")).collect()}
    bursts = {(r.rule_id, r.pos): r.burst for r in burst_segments(entries, rules, chunk_bits=bits).collect()}
    found = threshold_findings(entries, rules, chunk_bits=bits).select(
        "*", F.unix_micros("first_seen").alias("f"), F.unix_micros("last_seen").alias("l")).collect()
    events = [((s << POS_LINE_BITS) + n, t * 1_000_000, ip, user, f"s{s}") for s, n, t, ip, user in rows]
    for r in rules:
        want_counts, want_found, want_hot = threshold_model(
            events, r.window_us, r.threshold, bool(r.distinct_by), r.max_evidence)
        assert {p: (c, f) for p, c, f in want_counts} == {p: v for (i, p), v in counts.items() if i == r.id}
        assert dict(want_hot) == {p: b for (i, p), b in bursts.items() if i == r.id}
        got = {
            (x.emit_pos, x.source_ip): (
                x.f, x.l, x["count"], tuple(x.sources),
                tuple((e.source, e.line_no, e.raw) for e in x.evidence))
            for x in found if x.rule_id == r.id
        }
        line = lambda p: p & ((1 << POS_LINE_BITS) - 1)
        want = {
            (x["emit"], x["ip"]): (
                x["first"], x["last"], x["count"], tuple(sorted(x["sources"])),
                tuple((f"s{p >> POS_LINE_BITS}", line(p), f"raw{line(p)}") for p in x["evidence"]))
            for x in want_found
        }
        assert got == want and (want or r.id == "many")


def test_counts_only_rules_take_the_short_path(spark):
    rows = make_events(7, 500, 0.2)
    rules = build_rules(RULES[:2])
    found = threshold_findings(entries_of(spark, rows), rules, chunk_bits=4).collect()
    events = [((s << POS_LINE_BITS) + n, t * 1_000_000, ip, user, f"s{s}") for s, n, t, ip, user in rows]
    want = [x for r in rules for x in threshold_model(events, r.window_us, r.threshold, max_evidence=r.max_evidence)[1]]
    assert sorted((x.emit_pos, x["count"], len(x.evidence)) for x in found) == sorted(
        (x["emit"], x["count"], len(x["evidence"])) for x in want)


def test_event_time_order_ignores_arrival(spark):
    rows = make_events(9, 400, 0.3)
    rules = build_rules(RULES[:1] + RULES[2:3])
    counts = {(r.rule_id, r.pos): r["count"] for r in sliding_counts(
        entries_of(spark, rows), rules, order="event_time", chunk_bits=3).collect()}
    events = sorted([((s << POS_LINE_BITS) + n, t * 1_000_000, ip, user, f"s{s}") for s, n, t, ip, user in rows],
                    key=lambda e: (e[1], e[0]))
    for r in rules:
        want = threshold_model(events, r.window_us, r.threshold, bool(r.distinct_by))[0]
        assert {p: c for p, c, _ in want} == {p: c for (i, p), c in counts.items() if i == r.id}
