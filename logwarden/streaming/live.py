"""A live run: follow sources, alert as things happen, and report over what was read."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden.operators.entries import entries_of, parse_lines
from logwarden.plans.analyze import Analysis, analyze_parsed
from logwarden.plans.rules import LIVE_TYPES, SHIPPED_RULES, build_rules
from logwarden.session import materialise
from logwarden.sources.catalogue import detect_format
from logwarden.operators.threshold import matched_events
from logwarden.streaming.alerts import (
    ALERTS,
    HIT_COUNTS,
    WINDOWS,
    alert_rows,
    fold_counts,
    fold_windows,
    live_hits,
    signature_rules,
    stream_signatures,
    stream_thresholds,
)
from logwarden.streaming.follow import TAILS, arrival_order, assemble_partial_lines, follow_chunks
from logwarden.streaming.state import KeyedLog


# The place of the newest line so far (places count lines, whatever the number of batches), and the latest stamp in microseconds.
PLACES = "last BIGINT, newest BIGINT"
LATE = "source STRING, late BIGINT"
# Sources that came while the run was going, with the format of their first lines, if that is known yet.
JOINED = "source STRING, source_idx INT, format STRING"


class LiveRun:
    """Tables of a live run below ``run_dir``, which every executor must reach.

    Each batch writes its own folder of each table and reads what the batch before left, so a
    batch that is run again after a failure replaces its own rows and nothing is counted
    twice. Hit counts and windows are kept by key (``KeyedLog``): a batch reads and writes the
    buckets of its own keys.

    ``expire_after`` (seconds of event time) bounds them in long runs. It is off by default: no row is late and no address is
    forgotten. With it, entries older than the latest stamp of the batches before less ``expire_after`` raise no alert and
    are counted in the table ``late``, and what is left of addresses that were idle for longer is dropped. ``parsed``
    and the final report have every line either way.
    """

    def __init__(
        self,
        spark: SparkSession,
        run_dir: str,
        sources: DataFrame,
        specs: Iterable[dict[str, Any]] = SHIPPED_RULES,
        *,
        reference_time: datetime | None = None,
        default_year: int | None = None,
        tz: timezone = timezone.utc,
        expire_after: float | None = None,
        state_buckets: int = 64,
        fold_after: int = 8,
    ) -> None:
        self.spark = spark
        self.run_dir = run_dir.rstrip("/")
        self.sources = materialise(sources, "sources")  # read in every batch
        self.rules = build_rules(specs, spark)
        # Lines are read as they are written, so their years count back from the start of the run.
        self.reference_time = reference_time if reference_time is not None else datetime.now(timezone.utc)
        self.default_year = default_year
        self.tz = tz
        if expire_after is not None and expire_after < 0:
            raise ValueError(f"expire_after must not be negative, got {expire_after!r}")
        self.expire_us = None if expire_after is None else round(expire_after * 1_000_000)
        self.counts = KeyedLog(self, "counts", HIT_COUNTS, buckets=state_buckets, fold_after=fold_after)
        self.windows = KeyedLog(self, "windows", WINDOWS, buckets=state_buckets, fold_after=fold_after)
        self.custom = [
            (rule, LIVE_TYPES[rule.type], KeyedLog(self, f"state_{rule.id}", f"rule INT, ip STRING, {LIVE_TYPES[rule.type].state}", buckets=state_buckets, fold_after=fold_after))
            for rule in self.rules
            if rule.type in LIVE_TYPES
        ]

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.run_dir}/{table}/batch={batch_id}"

    def _write(self, df: DataFrame, table: str, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(table, batch_id))
        return self.spark.read.schema(df.schema).parquet(self._path(table, batch_id))

    def _write_together(self, tables: dict[str, DataFrame], batch_id: int) -> list[DataFrame]:
        """Tables of a batch that need nothing of each other, written at the same time: small batches mostly wait for their jobs."""
        with ThreadPoolExecutor(len(tables)) as pool:
            write = inheritable_thread_target(self.spark)(self._write)  # stopping the query stops these jobs too
            return [job.result() for job in [pool.submit(write, df, name, batch_id) for name, df in tables.items()]]

    def _left_by(self, table: str, schema: str, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table, batch_id - 1))

    def _file_system(self, path: str) -> tuple[Any, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _exists(self, path: str) -> bool:
        files, at = self._file_system(path)
        return files.exists(at)

    def _delete(self, path: str) -> None:
        files, at = self._file_system(path)
        files.delete(at, True)

    def _forget(self, table: str, batch_id: int) -> None:
        """Drop state that no batch can ask for again."""
        if batch_id >= 2:
            self._delete(self._path(table, batch_id - 2))

    def on_batch(self, chunks: DataFrame, batch_id: int) -> None:
        """Lines, entries and alerts of one batch of chunks."""
        lines, tails = assemble_partial_lines(chunks, self._left_by("tails", TAILS, batch_id))
        lines, _ = self._write_together({"lines": lines, "tails": tails}, batch_id)
        self.on_lines(lines, batch_id)
        self._forget("tails", batch_id)

    def on_lines(self, lines: DataFrame, batch_id: int) -> None:
        """Entries and alerts of one batch of complete lines."""
        base, newest = self._left_by("places", PLACES, batch_id).agg(F.max("last"), F.max("newest")).first()
        base = base or 0
        placed = arrival_order(lines, self._sources_of(lines, batch_id), base)
        parsed = parse_lines(placed, reference_time=self.reference_time, default_year=self.default_year, tz=self.tz)
        parsed = self._write(parsed, "parsed", batch_id)
        entries = entries_of(parsed)
        seen = parsed.agg(F.max("pos").alias("last"), F.max(F.when(F.col("kind").isin("web", "auth"), F.unix_micros("ts"))).alias("newest"))
        old = F.lit(newest).cast("long")
        self._write(seen.select(F.coalesce("last", F.lit(base)).alias("last"), F.greatest("newest", old).alias("newest")), "places", batch_id)
        oldest = None
        if self.expire_us is not None and newest is not None:
            oldest = newest - self.expire_us
            late = F.unix_micros("ts") < oldest
            self._write(entries.where(late).groupBy("source").agg(F.count("*").alias("late")), "late", batch_id)
            entries = entries.where(~late)
        alerts = [f(entries, batch_id, oldest) for f in (self._signature_alerts, self._threshold_alerts)]
        alerts = [a for a in alerts if a is not None] + self._custom_alerts(entries, batch_id)
        if alerts:
            both = reduce(DataFrame.unionByName, alerts)
            self._write(both.withColumn("seen_at", F.current_timestamp()), "alerts", batch_id)
        for table in ("places", "joined", "hits", "matched", "runs"):
            self._forget(table, batch_id)
        for log in (self.counts, self.windows, *(log for _, _, log in self.custom)):
            log.forget(batch_id)

    def _signature_alerts(self, entries: DataFrame, batch_id: int, oldest: int | None) -> DataFrame | None:
        if not signature_rules(self.rules):
            return None
        hits = self._write(live_hits(entries, self.rules), "hits", batch_id)
        touched = self.counts.buckets_of(hits)
        alerts, more = stream_signatures(hits, self.rules, self.counts.read(batch_id, touched))
        self.counts.append(more, batch_id, touched, lambda rows: fold_counts(rows, oldest), sweep=oldest is not None)
        return alerts

    def _threshold_alerts(self, entries: DataFrame, batch_id: int, oldest: int | None) -> DataFrame | None:
        if not any(r.type == "threshold" for r in self.rules):
            return None
        events = self._write(matched_events(entries, self.rules), "events", batch_id)
        touched = self.windows.buckets_of(events)
        keep = lambda rows, name: self._write(rows, name, batch_id)
        alerts, more = stream_thresholds(events, self.rules, self.windows.read(batch_id, touched), keep=keep)
        self.windows.append(more, batch_id, touched, lambda rows: fold_windows(rows, self.rules, oldest), sweep=oldest is not None)
        self._forget("events", batch_id)
        return alerts

    def _custom_alerts(self, entries: DataFrame, batch_id: int) -> list[DataFrame]:
        """Alerts of user-defined types; their states are keyed by address like those of the built-in ones."""
        found = []
        for rule, detector, log in self.custom:
            touched = log.buckets_of(entries.select(F.lit(0).alias("rule"), F.coalesce("source_ip", F.lit("")).alias("ip")))
            alerts, more = detector.update(entries, rule, log.read(batch_id, touched).drop("rule"))
            found.append(alert_rows(alerts.withColumn("rule", F.lit(0)), [rule]))
            fold = lambda rows, detector=detector: detector.fold(rows.drop("rule")).withColumn("rule", F.lit(0))
            columns = [c.split()[0] for c in log.schema.split(", ")]
            log.append(more.withColumn("rule", F.lit(0)).select(*columns), batch_id, touched, lambda rows, fold=fold, columns=columns: fold(rows).select(*columns))
        return found

    def _sources_of(self, lines: DataFrame, batch_id: int) -> DataFrame:
        """``sources`` and those that came later.

        A source that the table does not name has the next place and the format of its first lines in a batch. Until
        a line shows it, its lines are read as web lines, so what does not parse is an error row.
        """
        given = self.sources.selectExpr("source", "cast(source_idx AS INT) AS source_idx", "format")
        joined = self._left_by("joined", JOINED, batch_id)
        other = lines.select("source").distinct().join(given, "source", "left_anti")
        unknown = other.join(joined.where("format IS NOT NULL"), "source", "left_anti")
        if not unknown.isEmpty():
            last = given.unionByName(joined).agg(F.max("source_idx")).first()[0]
            nth = F.row_number().over(Window.orderBy("source")) + (-1 if last is None else last)
            fresh = unknown.join(joined, "source", "left_anti").select(
                "source", nth.cast("int").alias("source_idx"), F.lit(None).cast("string").alias("format")
            )
            first = lines.join(unknown, "source").groupBy("source").agg(F.min("line_no").alias("first_no"))
            head = lines.join(first, "source").selectExpr("source", "0 AS source_idx", "line_no - first_no + 1 AS line_no", "value")
            found = detect_format(head, now=self.reference_time).selectExpr("source", "format AS found")
            joined = joined.unionByName(fresh).join(found, "source", "left").selectExpr(
                "source", "source_idx", "coalesce(format, found) AS format"
            )
        joined = self._write(joined, "joined", batch_id)
        return given.unionByName(joined.selectExpr("source", "source_idx", "coalesce(format, 'web') AS format"))

    def start(self, chunks: DataFrame, **trigger: Any) -> StreamingQuery:  # noqa: ANN401 (passed on)
        """Run over a stream of chunks; ``trigger`` as for ``DataStreamWriter.trigger``."""
        return self._start(chunks, self.on_batch, trigger)

    def start_lines(self, lines: DataFrame, **trigger: Any) -> StreamingQuery:  # noqa: ANN401 (passed on)
        """Run over a stream of complete, numbered lines (``source, line_no, value``)."""
        return self._start(lines, self.on_lines, trigger)

    def _start(self, stream: DataFrame, on_batch: Any, trigger: dict[str, Any]) -> StreamingQuery:  # noqa: ANN401
        writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{self.run_dir}/checkpoint")
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()

    def follow(self, landing: str, *, max_files: int = 1000, **trigger: Any) -> StreamingQuery:  # noqa: ANN401
        return self.start(follow_chunks(self.spark, landing, max_files=max_files), **trigger)

    def table(self, name: str) -> DataFrame:
        """A table of the run over all batches so far."""
        return self.spark.read.parquet(f"{self.run_dir}/{name}").drop("batch")

    def live_alerts(self) -> DataFrame:
        """Alerts with the event's own time and the time they were seen."""
        schema = ALERTS + ", seen_at TIMESTAMP"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.run_dir}/alerts/batch=*")
        except AnalysisException:  # no batch has written yet, or no rule alerts
            return self.spark.createDataFrame([], schema)

    def late_rows(self) -> DataFrame:
        """Entries that came too late to raise an alert, by source; none unless ``expire_after`` is set."""
        try:
            rows = self.spark.read.schema(LATE).parquet(f"{self.run_dir}/late/batch=*")
        except AnalysisException:
            rows = self.spark.createDataFrame([], LATE)
        return rows.groupBy("source").agg(F.sum("late").alias("late"))

    def finalize(self, **options: Any) -> Analysis:  # noqa: ANN401 (passed on)
        """The report a run over the same lines gives; incidents exist only here."""
        return analyze_parsed(self.table("parsed"), self.rules, **options)
