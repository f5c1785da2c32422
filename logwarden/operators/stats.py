"""Line counts per source and for the whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ["lines_read", "parsed", "malformed", "skipped_blank"]


def source_stats(parsed: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Lines read, parsed, malformed and blank per source; zeros for those of ``sources`` (source) without a line."""
    counted = parsed.groupBy("source").agg(
        F.count("*").alias("lines_read"),
        F.count_if(F.col("kind").isin("web", "auth")).alias("parsed"),
        F.count_if(F.col("kind") == "error").alias("malformed"),
        F.count_if(F.col("kind") == "blank").alias("skipped_blank"),
    )
    if sources is None:
        return counted
    none = [F.lit(0).cast("bigint").alias(c) for c in COUNTERS]
    return counted.unionByName(sources.select("source").distinct().join(counted, "source", "left_anti").select("source", *none))


def total_stats(per_source: DataFrame, findings: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: the counters summed over all sources, and the numbers of findings and incidents."""
    names = [*COUNTERS, "findings", "incidents"]
    row = lambda given: [(given[n] if n in given else F.lit(0)).cast("bigint").alias(n) for n in names]
    parts = [
        per_source.select(*row({c: F.col(c) for c in COUNTERS})),
        findings.agg(F.count("*").alias("number")).select(*row({"findings": F.col("number")})),
        incidents.agg(F.count("*").alias("number")).select(*row({"incidents": F.col("number")})),
    ]
    merged = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return merged.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
