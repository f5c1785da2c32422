"""Threshold rules: exact sliding windows per (rule, source IP), spread over many tasks.

The window of a key is a queue in arrival order. Each event moves the queue's edge to the
latest stamp seen so far and drops events from the front that are more than ``window`` older
than the edge. As the edge never goes back, the event at position i counts

    (runs started up to i)  -  (runs ended before edge(i) - window)

where a run is a stretch of events of one counted thing that keeps it in the window: a single
event when events are counted, and all sightings of a value that follow each other within the
window when distinct values are counted. Both terms are prefix sums, so nothing needs the
whole history of a key in one task:

* rows are spread by (rule, ip, chunk), a chunk being at most ``2**CHUNK_BITS`` lines of one
  source, where each gets ``here``, the latest stamp of its chunk so far;
* everything else works on one row per group, i.e. per (rule, ip, chunk, here). Log stamps
  have whole seconds, so a key has at most one such row per second and chunk, however hot it
  is, and the edge of a group is the latest ``here`` of the key up to it.

A key that is in very many chunks in the same seconds still has many groups, so they are not ordered as one either. The
scan has two levels: the groups of a key and edge are added up, sums run over the edges of a key, and only
the groups of one edge are ordered among themselves. Within an edge nothing leaves the window, so the count never
falls: whether an edge is hot at its first and last event tells which of its groups opens a burst.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions.presets import DISTINCTS, MATCHES
from logwarden.operators.signature import per_rule, with_rule_text
from logwarden.plans.rules import Rule
from logwarden.schema import CHUNK_BITS
from logwarden.session import materialise

# A place is about a hundred bytes.
MAX_BROADCAST_PLACES = 1_000_000

KEY = ["rule", "ip"]
CHUNK = [*KEY, "chunk"]
GROUP = [*CHUNK, "here"]

# The chunk, and the place, of what earlier batches of a live run left.
CARRIED = "-1L"

BY_KEY = "PARTITION BY rule, ip"
BY_GROUP = "PARTITION BY rule, ip, chunk, here"
AT_EDGE = "PARTITION BY rule, ip, edge ORDER BY chunk, here"
BEFORE_AT_EDGE = f"{AT_EDGE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _threshold_rules(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.type == "threshold"]


def matched_events(entries: DataFrame, rules: list[Rule]) -> DataFrame:
    """One slim row per (entry, threshold rule that counts it); all rules in one pass."""
    rules = _threshold_rules(rules)
    tests = {name: MATCHES[name]() for name in {r.match for r in rules}}
    none = F.lit(None).cast("string")
    counted = [
        F.when(
            tests[r.match],
            F.struct(F.lit(number).alias("rule"), (DISTINCTS[r.distinct_by]() if r.distinct_by else none).alias("item")),
        )
        for number, r in enumerate(rules)
    ]
    return entries.where(reduce(lambda a, b: a | b, tests.values())).select(
        "pos",
        F.unix_micros("ts").alias("t"),
        "source",
        F.coalesce("source_ip", F.lit("")).alias("ip"),
        F.inline(F.array_compact(F.array(*counted))),
    )


def _placed(events: DataFrame, order: str, chunk_bits: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Events with ``chunk`` and ``here``, written once because several stages read them."""
    if order not in ("arrival", "event_time"):
        raise ValueError(f"order must be 'arrival' or 'event_time', got {order!r}")
    latest = "max(t) OVER (PARTITION BY rule, ip, chunk ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    here = latest if order == "arrival" else "t"
    chunked = events.selectExpr("*", f"shiftright(pos, {chunk_bits}) AS chunk")
    return keep(chunked.selectExpr("*", f"{here} AS here"), "matched")


def _sizes(placed: DataFrame, order: str, carried: DataFrame | None) -> DataFrame:
    """Groups with their number of events, first event, and ``edge``."""
    sizes = placed.groupBy(*GROUP).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    if carried is not None:
        earlier = carried.groupBy(*KEY, "at").agg(F.sum("n").alias("n"))
        sizes = sizes.unionByName(earlier.selectExpr(*KEY, f"{CARRIED} AS chunk", "at AS here", "n", f"{CARRIED} AS first_pos"))
    if order == "event_time":
        return sizes.selectExpr("*", "here AS edge")
    # ``here`` is the latest stamp of its own chunk already, so only the chunks before count beside it
    tops = sizes.groupBy(*CHUNK).agg(F.max("here").alias("top"))
    before = f"max(top) OVER ({BY_KEY} ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_before"
    edges = sizes.join(tops.selectExpr(*CHUNK, before), CHUNK)
    return edges.selectExpr(*GROUP, "n", "first_pos", "greatest(here, top_before) AS edge")


def _value_runs(
    placed: DataFrame, sizes: DataFrame, rules: list[Rule], carried: DataFrame | None, keep: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """First sighting of a value in each group, with whether it starts and ends a run of that value."""
    by_value = f"{BY_KEY}, item ORDER BY edge"
    window_us = per_rule([r.window_us for r in rules])
    seen = placed.where("item IS NOT NULL").groupBy(*GROUP, "item").agg(F.min("pos").alias("pos"))
    if carried is not None:
        earlier = carried.where("item IS NOT NULL")
        seen = seen.unionByName(earlier.selectExpr(*KEY, f"{CARRIED} AS chunk", "at AS here", "item", f"{CARRIED} AS pos"))
    # later sightings at an edge neither start a run nor are needed to end it
    first = seen.join(sizes.select(*GROUP, "edge"), GROUP).groupBy(*KEY, "item", "edge").agg(F.expr("min(struct(pos, chunk, here)) AS first"))
    runs = first.selectExpr(
        *KEY,
        "first.*",
        f"coalesce(lag(edge) OVER ({by_value}) < edge - {window_us}, true) AS starts",
        f"coalesce(lead(edge) OVER ({by_value}) > edge + {window_us}, true) AS ends",
    ).where("starts OR ends")
    return keep(runs, "runs")


def _groups(sizes: DataFrame, runs: DataFrame | None, rules: list[Rule]) -> DataFrame:
    """Groups with the run starts before them and the runs ended by then.

    The count at an event of the group is ``starts_before`` + the run starts inside the group
    up to that event - ``ended``.
    """
    if runs is None:
        counted = sizes.selectExpr("*", "n AS starts", "n AS ends", "first_pos AS first_start")
    else:
        per_group = runs.groupBy(*GROUP).agg(
            F.expr("count_if(starts) AS value_starts"),
            F.expr("count_if(ends) AS value_ends"),
            F.expr("min(CASE WHEN starts THEN pos END) AS value_first"),
        )
        distinct = per_rule([bool(r.distinct_by) for r in rules])
        counted = sizes.join(per_group, GROUP, "left").selectExpr(
            *GROUP,
            "n",
            "first_pos",
            "edge",
            f"if({distinct}, coalesce(value_starts, 0L), n) AS starts",
            f"if({distinct}, coalesce(value_ends, 0L), n) AS ends",
            f"if({distinct}, value_first, first_pos) AS first_start",
        )

    added = ["sum(n) AS n", "sum(starts) AS starts", "sum(ends) AS ends"]
    first = "min_by(coalesce(first_start = first_pos, false), struct(chunk, here)) AS first_starts"
    edges = _edges(counted.groupBy(*KEY, "edge").agg(*[F.expr(a) for a in [*added, first]]), rules)
    return counted.join(edges, [*KEY, "edge"]).selectExpr(
        *GROUP,
        "n",
        "first_pos",
        "first_start",
        "edge",
        "starts",
        f"edge_starts_before + coalesce(sum(starts) OVER ({BEFORE_AT_EDGE}), 0L) AS starts_before",
        "ended",
        "front",
        "burst",
        "edge_hot_before",
        "hot_till_edge",
    )


def _edges(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """Sums over the edges of a key: what started before each, what had ended, and the bursts."""
    window_us, limit = per_rule([r.window_us for r in rules]), per_rule([r.threshold for r in rules])
    in_order = f"{BY_KEY} ORDER BY edge"
    # Two moments per edge: when it comes, and when it has left the window.
    comes = "edge AS at, 0 AS leaving, starts AS in, 0L AS out, cast(NULL AS BIGINT) AS front"
    leaves = f"edge + {window_us} AS at, 1 AS leaving, 0L AS in, ends AS out, next_edge AS front"
    fixed = [*KEY, "edge", "n", "starts", "first_starts"]
    moments = edges.selectExpr("*", f"lead(edge) OVER ({in_order}) AS next_edge").selectExpr(
        *fixed, f"inline(array(struct({comes}), struct({leaves})))"
    )
    before = f"{BY_KEY} ORDER BY at, leaving ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    earlier = f"{BY_KEY}, burst ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return (
        moments.selectExpr(
            *fixed,
            "leaving",
            f"coalesce(sum(in) OVER ({before}), 0L) AS edge_starts_before",
            f"coalesce(sum(out) OVER ({before}), 0L) AS ended",
            f"coalesce(max(front) OVER ({before}), min(edge) OVER ({BY_KEY})) AS front",
        )
        .where("leaving = 0")
        .selectExpr(
            "*",
            f"edge_starts_before - ended + if(first_starts, 1, 0) >= {limit} AS hot_first",
            f"edge_starts_before - ended + starts >= {limit} AS hot_last",
        )
        .selectExpr("*", f"lag(hot_last, 1, false) OVER ({in_order}) AS hot_till_edge")
        .selectExpr(
            "*",
            f"sum(if(hot_last AND NOT (hot_first AND hot_till_edge), 1L, 0L)) OVER ({in_order} ROWS UNBOUNDED PRECEDING) AS burst",
        )
        .selectExpr(
            *KEY,
            "edge",
            "edge_starts_before",
            "ended",
            "front",
            "burst",
            "hot_till_edge",
            f"coalesce(sum(if(hot_first, n, 0L)) OVER ({earlier}), 0L) AS edge_hot_before",
        )
    )


def _bursts(groups: DataFrame, rules: list[Rule]) -> DataFrame:
    """Groups with at least one hot event, numbered by burst.

    Inside a group the count never falls, so its hot events are those from its ``need``-th run
    start on. ``hot_before`` counts earlier hot events of the burst, but for those of the edge that opened it before
    the count was full for a whole group.
    """
    limit = per_rule([r.threshold for r in rules])
    return (
        groups.selectExpr("*", "starts_before - ended AS base", f"{limit} AS limit")
        .selectExpr(
            "*",
            "base + starts AS count",
            "base + if(first_start = first_pos, 1, 0) >= limit AS hot_first",
            "base + starts >= limit AS hot_last",
        )
        .selectExpr(
            *GROUP,
            "edge",
            "burst",
            "front",
            "count",
            f"hot_last AND NOT (hot_first AND coalesce(lag(hot_last) OVER ({AT_EDGE}), hot_till_edge)) AS opens",
            "base",
            "limit - base AS need",
            f"edge_hot_before + coalesce(sum(if(hot_first, n, 0L)) OVER ({BEFORE_AT_EDGE}), 0L) AS hot_before",
            "hot_last",
        )
        .where("hot_last")
        .drop("hot_last")
    )


def _with_starts(rows: DataFrame, runs: DataFrame | None, rules: list[Rule]) -> DataFrame:
    """Add ``so_far``, the run starts of the row's group up to and including the row."""
    own_run = "1L"
    if runs is not None:
        marks = runs.where("starts").selectExpr(*GROUP, "pos", "1L AS mark")
        rows = rows.join(marks, [*GROUP, "pos"], "left")
        own_run = f"if({per_rule([bool(r.distinct_by) for r in rules])}, coalesce(mark, 0L), 1L)"
    return rows.selectExpr("*", f"sum({own_run}) OVER ({BY_GROUP} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS so_far")


class Stages:
    """The shared stages of one run over the threshold rules.

    ``carried``: what is left of the windows of earlier events, as ``rule, ip, at, item, n``. ``at`` is the edge at which ``n``
    events came, or, with an item, at which it was last seen; the latest edge of each key is among the rows. They count like
    groups before all chunks but are not among the events that the stages return.
    """

    def __init__(
        self,
        events: DataFrame,
        rules: list[Rule],
        order: str,
        chunk_bits: int,
        *,
        carried: DataFrame | None = None,
        keep: Callable[[DataFrame, str], DataFrame] = materialise,
    ) -> None:
        self.rules = _threshold_rules(rules)
        self.placed = _placed(events, order, chunk_bits, keep)
        if carried is not None:
            carried = carried.join(self.placed.select(*KEY).distinct(), KEY, "left_semi")
        self.sizes = _sizes(self.placed, order, carried)
        counts_values = any(r.distinct_by for r in self.rules)
        self.runs = _value_runs(self.placed, self.sizes, self.rules, carried, keep) if counts_values else None
        self.groups = _groups(self.sizes, self.runs, self.rules)
        self.rule_id = f"{per_rule([r.id for r in self.rules])} AS rule_id"

    def hot_events(self) -> DataFrame:
        """The events at which the count is at or above the threshold, with their burst.

        ``rank`` numbers the hot events of a group.
        """
        rows = self.placed.join(_bursts(self.groups, self.rules), GROUP)
        hot = _with_starts(rows, self.runs, self.rules).where("so_far >= need")
        return hot.selectExpr("*", f"row_number() OVER ({BY_GROUP} ORDER BY pos) AS rank")


def sliding_counts(
    entries: DataFrame, rules: list[Rule], *, order: str = "arrival", chunk_bits: int = CHUNK_BITS
) -> DataFrame:
    """The window count after each matching event, and the stamp at the window's front.

    ``rule_id, source_ip, pos, ts, count, front_ts``; counts distinct values for rules with
    ``distinct_by``.
    """
    stages = Stages(matched_events(entries, rules), rules, order, chunk_bits)
    rows = stages.placed.join(stages.groups.select(*GROUP, "starts_before", "ended", "front"), GROUP)
    return _with_starts(rows, stages.runs, stages.rules).selectExpr(
        stages.rule_id,
        "nullif(ip, '') AS source_ip",
        "pos",
        "timestamp_micros(t) AS ts",
        "starts_before + so_far - ended AS count",
        "timestamp_micros(front) AS front_ts",
    )


def burst_segments(
    entries: DataFrame, rules: list[Rule], *, order: str = "arrival", chunk_bits: int = CHUNK_BITS
) -> DataFrame:
    """The events at or above the threshold with the number of their burst per (rule, ip)."""
    stages = Stages(matched_events(entries, rules), rules, order, chunk_bits)
    return stages.hot_events().selectExpr(
        stages.rule_id, "nullif(ip, '') AS source_ip", "pos", "timestamp_micros(t) AS ts", "burst"
    )


def threshold_findings(
    entries: DataFrame, rules: list[Rule], *, order: str = "arrival", chunk_bits: int = CHUNK_BITS
) -> DataFrame:
    """One finding per burst.

    A burst's rows meet only in a hash aggregate with a map-side half. Its first events are
    known by their rank, so at most ``3 * max_evidence`` positions are listed per burst, and
    the lines themselves are fetched for those positions alone.
    """
    stages = Stages(matched_events(entries, rules), rules, order, chunk_bits)
    room = per_rule([r.max_evidence for r in stages.rules])
    aggregates = [
        "min_by(front, struct(edge, pos)) AS front",
        "max(t) AS last",
        "max_by(count, struct(edge, pos)) AS count",
        "collect_set(source) AS sources",
        "min_by(pos, struct(edge, pos)) AS emit_pos",
        f"sort_array(collect_list(CASE WHEN hot_before + rank <= {room} THEN struct(edge, pos) END)) AS listed",
    ]
    found = stages.hot_events().groupBy(*KEY, "burst").agg(*[F.expr(a) for a in aggregates])
    listed = materialise(
        found.selectExpr(
            *KEY,
            "emit_pos",
            "count",
            "sources",
            "timestamp_micros(front) AS first_seen",
            "timestamp_micros(last) AS last_seen",
            f"posexplode_outer(slice(listed.pos, 1, {room})) AS (nth, pos)",
        ),
        "listed",
    )
    # Written first, so that the number of places is known before the entries are read: up to
    # a limit they go to the entries, beyond it both sides meet by position.
    places = listed.where("pos IS NOT NULL").select(*KEY, "emit_pos", "nth", "pos")
    if places.count() <= MAX_BROADCAST_PLACES:
        places = F.broadcast(places)
    shown = (
        entries.select("pos", "source", "line_no", "raw")
        .join(places, "pos")
        .groupBy(*KEY, "emit_pos")
        .agg(F.expr("array_sort(collect_list(struct(nth, source, line_no, raw))) AS shown"))
    )
    joined = listed.where("coalesce(nth, 0) = 0").drop("nth", "pos").join(shown, [*KEY, "emit_pos"], "left")
    one_line = "struct(e.source AS source, e.line_no AS line_no, e.raw AS raw)"
    no_lines = "cast(array() AS ARRAY<STRUCT<source: STRING, line_no: BIGINT, raw: STRING>>)"
    return with_rule_text(
        joined,
        stages.rules,
        evidence=f"coalesce(transform(shown, e -> {one_line}), {no_lines})",
        matches="cast(array() AS ARRAY<STRUCT<pattern: STRING, snippet: STRING, value: STRING>>)",
        metadata=[
            {
                "match": r.match,
                "distinct_by": r.distinct_by,
                "threshold": r.threshold,
                "window_seconds": float(r.window_seconds),
            }
            for r in stages.rules
        ],
    )
