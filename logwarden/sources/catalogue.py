"""Which format each source holds, and which moment anchors the years of its stamps."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.functions import patterns as P
from logwarden.functions.fields import is_blank
from logwarden.operators.entries import parse_lines
from logwarden.schema import SNIFF_LINES, RuleError
from logwarden.sources.lines import drop_blank_lines

LINE_COLUMNS = ["source", "source_idx", "line_no", "value"]


# Lines looked at first at either end of a source; only sources that do not settle there are
# looked at in full.
EDGE_LINES = 1000


def edge_lines(lines: DataFrame) -> DataFrame:
    """The first and last lines of each source, from lines with ``total_lines``."""
    line_no, total = F.col("line_no"), F.col("total_lines")
    return lines.where((line_no <= EDGE_LINES) | (line_no > total - EDGE_LINES))


def _head(lines: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The first non-blank lines of each source; the limit also applies before the shuffle.

    Only sources with too few such lines near their start are read on. Where there is none,
    the small side of that join is empty and Spark leaves the scan out.
    """
    near = (lines if edges is None else edges).where(F.col("line_no") <= EDGE_LINES)
    counted = near.groupBy("source").agg(F.expr(f"count_if(NOT {is_blank('value')})").alias("n"), F.count("*").alias("all"))
    short = counted.where((F.col("n") < SNIFF_LINES) & (F.col("all") == EDGE_LINES)).select("source")
    far = lines.where(F.col("line_no") > EDGE_LINES).join(short, "source")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("line_no"))
    both = drop_blank_lines(near.select(*LINE_COLUMNS).unionByName(far.select(*LINE_COLUMNS)))
    return both.withColumn("rank", rank).where(F.col("rank") <= SNIFF_LINES).drop("rank")


def detect_format(lines: DataFrame, *, edges: DataFrame | None = None, now: datetime | None = None) -> DataFrame:
    """``source, source_idx, format``; ``format`` is NULL where none of the first lines parses.

    The first line that parses decides, as web if it reads as both.
    """
    head = _head(lines, edges)
    tried = head.select("*", F.explode(F.array(F.lit("web"), F.lit("auth"))).alias("format"))
    parsed = parse_lines(tried, reference_time=now)
    # A syslog line starts with a month, so no line parses as both; web would win by order.
    choice = F.min_by(
        F.when(F.col("kind").isin("web", "auth"), F.col("kind")),
        F.when(F.col("kind").isin("web", "auth"), F.struct("line_no", F.when(F.col("kind") == "web", 0).otherwise(1))),
    )
    return parsed.groupBy("source", "source_idx").agg(choice.alias("format"))


def build_sources(
    lines: DataFrame, files: DataFrame | None = None, *, edges: DataFrame | None = None, now: datetime | None = None
) -> DataFrame:
    """Catalogue of all sources with their format; files without any line are listed too."""
    detected = detect_format(lines, edges=edges, now=now)
    if files is None:
        return detected
    return files.select("source", "source_idx", "modified_at").join(
        detected.select("source", "format"), "source", "left"
    )


def known_sources(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(F.col("format").isNotNull())


def skipped_sources(catalogue: DataFrame) -> DataFrame:
    """Sources of unknown format, which a run leaves out."""
    return catalogue.where(F.col("format").isNull()).select("source")


def require_sources(catalogue: DataFrame) -> None:
    if not known_sources(catalogue).take(1):
        raise RuleError("no recognized log files to analyze")


@dataclass(frozen=True)
class Anchor:
    """The moment syslog years are resolved against, and whether it is only a guess."""

    moment: datetime
    fell_back_to_now: bool


def _last_stamps(lines: DataFrame, web: DataFrame) -> DataFrame:
    parsed = parse_lines(lines.select(*LINE_COLUMNS).join(web.select("source", "format"), "source"))
    offset = F.regexp_extract("raw", rf"(?dU)^[^\[]*\[[^\]]*{P.WS}([+-][0-9:]+|Z)\]", 1)
    stamp = F.struct("ts", offset.alias("utc_offset"))
    return parsed.where("kind = 'web'").groupBy("source").agg(F.max_by(stamp, "line_no").alias("last"))


def newest_web_stamp(lines: DataFrame, catalogue: DataFrame, *, edges: DataFrame | None = None) -> DataFrame:
    """One row ``ts, utc_offset``: newest over web sources of the stamp of the last line that parses.

    A web source without any such line counts with its modification time, if known.
    """
    web = catalogue.where("format = 'web'")
    if "modified_at" not in catalogue.columns:
        web = web.withColumn("modified_at", F.lit(None).cast("timestamp"))
    if edges is None:
        last = _last_stamps(lines, web)
    else:
        tail = edges.where(F.col("line_no") > F.col("total_lines") - EDGE_LINES)
        last = _last_stamps(tail, web)
        rest = web.join(last, "source", "left_anti")
        last = last.unionAll(_last_stamps(lines, rest))
    unknown = F.struct(F.col("modified_at").alias("ts"), F.lit("+0000").alias("utc_offset"))
    per_source = web.join(last, "source", "left").select(F.coalesce("last", unknown).alias("last"))
    return per_source.where("last.ts IS NOT NULL").agg(F.max_by("last", "last.ts").alias("last")).select("last.*")


def _zone(offset: str) -> timezone:
    digits = offset.replace(":", "")
    if not digits[1:]:
        return timezone.utc
    size = timedelta(hours=int(digits[1:3]), minutes=int(digits[3:5]), seconds=int(digits[5:7] or 0))
    return timezone(-size if digits[0] == "-" else size)


def reference_time_anchor(
    lines: DataFrame,
    catalogue: DataFrame,
    *,
    edges: DataFrame | None = None,
    override: datetime | None = None,
    now: datetime | None = None,
) -> Anchor:
    """Explicit override, else the newest web stamp, else now.

    ``fell_back_to_now`` is set when it is now and there are auth sources to resolve.
    """
    if override is not None:
        return Anchor(override if override.tzinfo else override.replace(tzinfo=timezone.utc), False)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    newest = newest_web_stamp(lines, catalogue, edges=edges).select(F.unix_micros("ts").alias("us"), "utc_offset").first()
    if newest is not None and newest.us is not None:
        return Anchor((epoch + timedelta(microseconds=newest.us)).astimezone(_zone(newest.utc_offset)), False)
    has_auth = bool(catalogue.where("format = 'auth'").take(1))
    return Anchor(now if now is not None else datetime.now(timezone.utc), has_auth)
