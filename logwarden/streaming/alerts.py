"""Alerts of one batch of a stream, given what earlier batches left of the batch's keys.

Both work on the rows of one batch with the operators of a whole run, so a stream finds what a run over the same lines
finds, and a busy IP is spread over tasks in the same way. What a batch leaves behind are only its own rows: hits of
signatures by key, and for thresholds one row for each key and second (or value) of the batch. Late rows are not
dropped here, they count against the latest stamp seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.operators.signature import first_hits, per_rule, signature_hits
from logwarden.operators.threshold import GROUP, KEY, Stages
from logwarden.plans.rules import Rule
from logwarden.schema import CHUNK_BITS, severity_name
from logwarden.session import materialise

HITS = "rule INT, ip STRING, ts TIMESTAMP, source STRING, pos BIGINT"
HIT_COUNTS = "rule INT, ip STRING, hits BIGINT, at BIGINT"
WINDOWS = "rule INT, ip STRING, at BIGINT, item STRING, n BIGINT"
ALERTS = (
    "rule_id STRING, title STRING, severity INT, severity_name STRING, source_ip STRING, ts TIMESTAMP, "
    "count BIGINT, source STRING, pos BIGINT"
)


def alert_rows(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Alerts with the texts of their rules; ``rule`` is the place in ``rules``."""
    return rows.selectExpr("*", f"{per_rule([r.severity for r in rules])} AS severity").selectExpr(
        f"{per_rule([r.id for r in rules])} AS rule_id",
        f"{per_rule([r.title for r in rules])} AS title",
        "severity",
        f"{severity_name('severity')} AS severity_name",
        "nullif(ip, '') AS source_ip",
        "ts",
        "cast(count AS BIGINT) AS count",
        "source",
        "pos",
    )


def live_hits(entries: DataFrame, rules: list[Rule]) -> DataFrame:
    """The hits of a batch, one row for each (entry, rule)."""
    return signature_hits(entries, signature_rules(rules)).selectExpr("rule", "coalesce(source_ip, '') AS ip", "ts", "source", "pos")


def signature_rules(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.type == "signature" and r.patterns]


def stream_signatures(hits: DataFrame, rules: list[Rule], counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One alert per (rule, IP), at the hit that reaches ``min_hits``; and the hits to add to the counts.

    ``counts`` has what earlier batches left of the keys of ``hits``, and may have more.
    """
    rules = signature_rules(rules)
    needed = [max(r.min_hits, 1) for r in rules]
    known = counts.groupBy(*KEY).agg(F.sum("hits").alias("hits"))
    reached = first_hits(hits, max(needed, default=1)).join(known, KEY, "left").selectExpr("*", "coalesce(hits, 0L) + rank AS count")
    alerts = alert_rows(reached.where(f"count = {per_rule(needed)}"), rules)
    return alerts, hits.groupBy(*KEY).agg(F.count("*").alias("hits"), F.max(F.unix_micros("ts")).alias("at"))


def fold_counts(counts: DataFrame, oldest: int | None = None) -> DataFrame:
    """One row per key; with ``oldest``, without the keys whose last hit is older."""
    whole = counts.groupBy(*KEY).agg(F.sum("hits").alias("hits"), F.max("at").alias("at"))
    return whole if oldest is None else whole.where(F.col("at") >= oldest)


def stream_thresholds(
    events: DataFrame,
    rules: list[Rule],
    windows: DataFrame,
    *,
    chunk_bits: int = CHUNK_BITS,
    keep: Callable[[DataFrame, str], DataFrame] = materialise,
) -> tuple[DataFrame, DataFrame]:
    """One alert per burst, at the event that crosses the threshold; and the rows to add to the windows.

    ``events`` are the matched events of the batch. ``windows`` has what earlier batches left of their keys: per key and edge
    the number of events, or per value the edge at which it was last seen. That brings back the edge, the counts and
    whether a burst was open; the events themselves are not needed again.
    """
    rules = [r for r in rules if r.type == "threshold"]
    known = fold_windows(windows, rules)
    stages = Stages(events, rules, "arrival", chunk_bits, carried=known, keep=keep)
    opened = stages.hot_events().where("opens AND rank = 1")
    alerts = alert_rows(opened.selectExpr("*", "timestamp_micros(t) AS ts").drop("count").selectExpr(
        "*", "base + so_far AS count"), rules)
    distinct = per_rule([bool(r.distinct_by) for r in rules])
    fresh = stages.sizes.where("chunk >= 0")
    counted = fresh.where(f"NOT {distinct}").groupBy(*KEY, F.col("edge").alias("at")).agg(F.sum("n").alias("n"))
    left = counted.selectExpr(*KEY, "at", "cast(NULL AS STRING) AS item", "n")
    if any(r.distinct_by for r in rules):
        # the edge itself, which events without a value move too
        edges = fresh.where(distinct).groupBy(*KEY).agg(F.max("edge").alias("at"))
        values = stages.placed.where(f"item IS NOT NULL AND {distinct}").join(fresh.select(*GROUP, "edge"), GROUP)
        values = values.groupBy(*KEY, "item").agg(F.max("edge").alias("at"))
        left = left.unionByName(edges.selectExpr(*KEY, "at", "cast(NULL AS STRING) AS item", "0L AS n"))
        left = left.unionByName(values.selectExpr(*KEY, "at", "item", "0L AS n"))
    return alerts, left


def fold_windows(windows: DataFrame, rules: list[Rule], oldest: int | None = None) -> DataFrame:
    """One row per key and edge, or per value, of what is still in the window of its key.

    With ``oldest``, the keys whose window had passed by then are left out.
    """
    rules = [r for r in rules if r.type == "threshold"]
    merged = (
        windows.selectExpr("*", "if(item IS NULL, at, NULL) AS own")
        .groupBy(*KEY, "item", "own")
        .agg(F.max("at").alias("at"), F.sum("n").alias("n"))
    )
    last = windows.groupBy(*KEY).agg(F.max("at").alias("last_edge"))
    window_us = per_rule([r.window_us for r in rules])
    alive = merged.join(last, KEY).where(f"at >= last_edge - {window_us}")
    if oldest is not None:
        alive = alive.where(f"last_edge >= {oldest}L - {window_us}")
    return alive.select(*KEY, "at", "item", "n")
