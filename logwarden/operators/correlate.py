"""Findings of one source IP that lie close in time, joined into incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.schema import DEFAULT_WINDOW_MINUTES, SEVERITIES, severity_name

CLUSTER = ["source_ip", "cluster"]


def iso_utc(ts: Column) -> Column:
    """ISO text in UTC, with a fraction only where there is one."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(whole, fraction, F.lit("+00:00"))


def span_text(micros: Column) -> Column:
    """``[D day[s], ]H:MM:SS[.ffffff]``, with negative spans counted back from whole days."""
    day_us = 86_400_000_000
    days = F.floor(micros / day_us)
    rest = F.pmod(micros, F.lit(day_us))
    seconds = (rest / 1_000_000).cast("bigint")
    fraction = rest % 1_000_000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(
        (seconds / 3600).cast("int").cast("string"), F.lit(":"), two((seconds % 3600 / 60).cast("int")), F.lit(":"),
        two(seconds % 60), F.when(fraction > 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))).otherwise(""),
    )
    unit = F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), unit, clock))


def cluster_findings(findings: DataFrame, window_minutes: float = DEFAULT_WINDOW_MINUTES) -> DataFrame:
    """Findings that have an IP, with the number of their cluster per IP.

    A finding joins while it starts at most the window after the latest end seen before it.
    Taking that end over all earlier findings of the IP, not only the current cluster, gives
    the same clusters: a new one opens only beyond every earlier end, so those can no longer
    be within the window of anything later. Findings per IP are few: a burst ends only when
    time moves on.
    """
    if window_minutes < 0:
        raise ValueError(f"window_minutes must be >= 0, got {window_minutes!r}")
    order = Window.partitionBy("source_ip").orderBy("first_seen", "emit_pos", "rule_pos")
    end = F.max(F.unix_micros("last_seen")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.unix_micros("first_seen") - end
    opens = F.coalesce(gap > round(window_minutes * 60_000_000), F.lit(True)).cast("int")
    return (
        findings.where(F.col("source_ip").isNotNull())
        .withColumn("opens", opens)
        .withColumn("cluster", F.sum("opens").over(order).cast("int"))
        .drop("opens")
    )


def _summaries(clustered: DataFrame) -> DataFrame:
    """One row per cluster; the sources of its findings meet as single strings, not as lists."""
    spread = clustered.select(
        *CLUSTER, "rule_id", "title", "severity", "first_seen", "last_seen",
        F.posexplode_outer("sources").alias("nth", "origin"),
    )
    return spread.groupBy(*CLUSTER).agg(
        F.count_if(F.coalesce("nth", F.lit(0)) == 0).alias("finding_count"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.array_sort(F.collect_set("title")).alias("titles"),
        F.array_sort(F.collect_set("origin")).alias("sources"),
        F.max("severity").alias("top"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def incident_gate(clustered: DataFrame) -> DataFrame:
    """Clusters that span at least two rules or at least two sources."""
    return _summaries(clustered).where((F.size("rule_ids") >= 2) | (F.size("sources") >= 2))


def escalate_severity(level: Column) -> Column:
    """One level up, at most the highest."""
    return F.least(level + 10, F.lit(max(SEVERITIES.values())))


def incident_id(ip: Column, first_seen: Column, rule_ids: Column) -> Column:
    text = F.concat_ws("|", ip, iso_utc(first_seen), F.array_join(F.array_sort(rule_ids), ","))
    return F.concat(F.lit("INC-"), F.substring(F.sha1(text), 1, 10))


def incident_narrative() -> Column:
    """Sentence over the columns of ``incident_gate``."""
    span = span_text(F.unix_micros("last_seen") - F.unix_micros("first_seen"))
    return F.concat(
        F.col("source_ip"), F.lit(" triggered "), F.col("finding_count").cast("string"), F.lit(" findings across "),
        F.size("rule_ids").cast("string"), F.lit(" rule(s) ("), F.array_join("titles", ", "), F.lit(") over "),
        F.array_join("sources", ", "), F.lit(" within "), span, F.lit(" ("), iso_utc(F.col("first_seen")),
        F.lit(" → "), iso_utc(F.col("last_seen")), F.lit(")."),
    )


def _described(gated: DataFrame) -> DataFrame:
    severity = escalate_severity(F.col("top"))
    return gated.select(
        incident_id(F.col("source_ip"), F.col("first_seen"), F.col("rule_ids")).alias("incident_id"),
        F.concat(F.lit("Correlated activity from "), F.col("source_ip")).alias("title"),
        severity.alias("severity"),
        F.expr(severity_name("least(top + 10, 50)")).alias("severity_name"),
        "source_ip",
        "first_seen",
        "last_seen",
        "finding_count",
        "rule_ids",
        "sources",
        incident_narrative().alias("narrative"),
        "cluster",
    )


def incidents(findings: DataFrame, window_minutes: float = DEFAULT_WINDOW_MINUTES) -> DataFrame:
    """Incidents by first stamp, then IP. Their findings are in ``incident_findings``."""
    gated = incident_gate(cluster_findings(findings, window_minutes))
    return _described(gated).drop("cluster").orderBy("first_seen", "source_ip")


def incident_findings(findings: DataFrame, window_minutes: float = DEFAULT_WINDOW_MINUTES) -> DataFrame:
    """Each finding that belongs to an incident, with the incident's id."""
    clustered = cluster_findings(findings, window_minutes)
    found = _described(incident_gate(clustered)).select("incident_id", *CLUSTER)
    return clustered.join(found, CLUSTER).drop("cluster")
