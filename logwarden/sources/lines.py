"""Text files to numbered lines, without moving the lines themselves."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.functions.fields import is_blank
from logwarden.schema import LINES, PARSE_ERRORS
from logwarden.session import materialise
from logwarden.sources.files import Listing, escaped, list_sources, plain_path

# Rows of the block table (about 200 bytes each) up to which every executor gets all of them.
MAX_BROADCAST_BLOCKS = 200_000
# Parts into which a group of files with a fault is cut, and groups that are read at the same time.
FAN_OUT = 32
SIDE_BY_SIDE = 8
# Conditions of Spark that blame a file.
_FILE_ERRORS = ("FAILED_READ_FILE", "PATH_NOT_FOUND")


def source_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files behind ``paths`` (files, folders or globs), each once, in the order given.

    ``source, source_idx, path, length, modified_at``; ``source`` is the full path.
    """
    return list_sources(spark, paths).table(spark)


@dataclass(frozen=True)
class Scan:
    """The files of a run, read once for the count.

    ``numbered``: their lines; ``blocks``: one row per block of a file; ``broken``: the sources that break off while they are read, of which
    ``numbered`` has the lines before the break.
    """

    listing: Listing
    numbered: DataFrame | None
    blocks: DataFrame | None
    broken: list[str]


def scan_files(spark: SparkSession, paths: Sequence[str]) -> Scan:
    """Count the lines of all files. Where a file fails, the files that cannot be read whole are sifted out and the others are counted again.

    What is left is read without leave to skip anything, so a file that breaks later stops the run.
    The lines of broken files are written once, so that all passes see the same.
    """
    listing = list_sources(spark, paths)
    if not listing.files:
        return Scan(listing, None, None, [])
    _pin_splits(spark)
    parts: list[tuple[DataFrame, DataFrame]] = []
    broken: list[str] = []
    numbered = _numbered(spark, listing.roots)
    try:
        parts.append((numbered, _blocks(numbered)))
    except (PySparkException, Py4JJavaError) as error:
        if not _is_of_a_file(error):
            raise
        whole, broken = sift_files(spark, [p for p, _, _ in listing.files])
        some, _ = sift_files(spark, broken, skip=True)
        if whole:
            numbered = _numbered(spark, whole)
            parts.append((numbered, _blocks(numbered)))
        if some:
            lines = materialise(_numbered(spark, some, skip=True), "broken")
            parts.append((lines, _blocks(lines)))
    if not parts:
        return Scan(listing, None, None, [plain_path(p) for p in broken])
    numbered, blocks = parts[0]
    for more, counts in parts[1:]:
        numbered, blocks = numbered.unionByName(more), blocks.unionByName(counts)
    return Scan(listing, numbered, blocks, [plain_path(p) for p in broken])


def sift_files(spark: SparkSession, paths: Sequence[str], *, skip: bool = False) -> tuple[list[str], list[str]]:
    """The files that can be read to their end, and the others, each in the order given.

    All are read as one group. A group with a fault is cut into ``FAN_OUT`` smaller ones, down to single files, so a file is read at most once
    for each level: a million files have five levels, however many of them are broken. Only errors of reading a file are taken as its fault.
    """
    whole: set[str] = set()
    groups = [list(paths)] if paths else []
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        while groups:
            read = list(pool.map(lambda group: _can_be_read(spark, group, skip), groups))
            whole.update(p for group, good in zip(groups, read) if good for p in group)
            faulty = [g for g, good in zip(groups, read) if not good and len(g) > 1]
            groups = [g[i :: min(FAN_OUT, len(g))] for g in faulty for i in range(min(FAN_OUT, len(g)))]
    return [p for p in paths if p in whole], [p for p in paths if p not in whole]


def _can_be_read(spark: SparkSession, paths: Sequence[str], skip: bool) -> bool:
    try:
        _text(spark, paths, skip).count()
    except (PySparkException, Py4JJavaError) as error:
        if not _is_of_a_file(error):
            raise
        return False
    return True


def _is_of_a_file(error: Exception) -> bool:
    """Whether Spark blames a file for an error, by the conditions of the error and of its causes."""
    if isinstance(error, PySparkException):
        return (error.getCondition() or "").startswith(_FILE_ERRORS)
    cause, depth = getattr(error, "java_exception", None), 0
    while cause is not None and depth < 30:
        if cause.getClass().getName().startswith("org.apache.spark.Spark") and (cause.getCondition() or "").startswith(_FILE_ERRORS):
            return True
        cause, depth = cause.getCause(), depth + 1
    return False


def unreadable_sources(
    spark: SparkSession, paths: Sequence[str], counted: DataFrame | None = None, scan: Scan | None = None
) -> DataFrame:
    """One parse error with line number 0 for each path that leads to no file and each file that cannot be read whole.

    ``scan`` saves the pass that counts the lines of all files, ``counted`` (``source, total_lines``) their sums.
    """
    scan = scan or scan_files(spark, paths)
    listing = scan.listing
    missing = spark.createDataFrame([(p, 0, p, why) for p, why in listing.missing], PARSE_ERRORS)
    if not listing.files:
        return missing
    if counted is None:
        empty = spark.createDataFrame([], "source STRING, total_lines BIGINT")
        counted = empty if scan.blocks is None else scan.blocks.groupBy("source").agg(F.sum("lines").alias("total_lines"))
    total = counted.where("total_lines > 0").select("source", "total_lines")
    broken = spark.createDataFrame([(s, True) for s in scan.broken], "source STRING, broken BOOLEAN")
    faulty = listing.table(spark).join(total, "source", "left").join(broken, "source", "left")
    none = F.concat(F.lit("OSError: no line could be read from "), F.col("source"))
    some = F.concat(F.lit("OSError: broke off after "), F.col("total_lines"), F.lit(" lines: "), F.col("source"))
    unread = faulty.where("broken OR length > 0 AND total_lines IS NULL").select(
        "source", F.lit(0).cast("bigint").alias("line_no"), F.col("source").alias("raw"),
        F.when(F.col("total_lines").isNull(), none).otherwise(some).alias("reason"),
    )
    return missing.unionAll(unread)


def _text(spark: SparkSession, paths: Sequence[str], skip: bool) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(skip).lower())
    return reader.text([escaped(p) for p in paths])


def _numbered(spark: SparkSession, paths: Sequence[str], *, skip: bool = False) -> DataFrame:
    """Every line with its file, block and a number that rises by one inside a block.

    Files are named literally and folders are read to their depth. ``skip``: a file that breaks off gives the lines before the break.
    """
    found = _text(spark, paths, skip)
    # The scan writes a path as a URI, the listing as it is; a local one has one slash or three after the scheme.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return found.select(
        "value",
        F.regexp_replace(path, "^file:/+", "/").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )


def _blocks(numbered: DataFrame) -> DataFrame:
    """One row per block of a file: its first number and its lines; written once, as several steps read it."""
    blocks = numbered.groupBy("source", "block").agg(F.min("id").alias("first_id"), F.count("*").alias("lines"))
    return materialise(blocks, "blocks")


def read_log_lines(
    spark: SparkSession, paths: Sequence[str], files: DataFrame | None = None, *, with_total: bool = False, scan: Scan | None = None
) -> DataFrame:
    """All lines of all files as ``source, source_idx, line_no, value``; blank lines count.

    Spark reads a file in blocks, and ``monotonically_increasing_id`` rises by one per line
    inside a block. So a line's number is its id less the first id of its block plus the lines
    of the file's earlier blocks; the first pass reads the blocks to count their lines, and
    only one row per block moves. ``with_total`` adds ``total_lines`` of the source and ``pos``, the
    place of the line among all lines of the run.
    """
    scan = scan or scan_files(spark, paths)
    files = scan.listing.table(spark) if files is None else files
    if scan.numbered is None:
        return spark.createDataFrame([], LINES + (", total_lines BIGINT, pos BIGINT" if with_total else ""))
    blocks = scan.blocks
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(
        "source",
        "block",
        (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first_id") + 1).alias("shift"),
    )
    totals = blocks.groupBy("source").agg(F.sum("lines").alias("total_lines")).join(files.select("source", "source_idx"), "source")
    # One row per file: the only global order here, over the file list.
    above = Window.orderBy("source_idx").rowsBetween(Window.unboundedPreceding, -1)
    table = placed.join(totals.withColumn("lines_above", F.coalesce(F.sum("total_lines").over(above), F.lit(0))), "source")
    if blocks.count() <= MAX_BROADCAST_BLOCKS:
        table = F.broadcast(table)
    lines = scan.numbered.join(table, ["source", "block"]).select(
        "source",
        "source_idx",
        (F.col("id") + F.col("shift")).alias("line_no"),
        F.make_valid_utf8("value").alias("value"),
        "total_lines",
        (F.col("id") + F.col("shift") + F.col("lines_above")).alias("pos"),
    )
    return lines if with_total else lines.drop("total_lines", "pos")


def _pin_splits(spark: SparkSession) -> None:
    """Keep the split size from following the number of cores, which may change between two scans."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def drop_blank_lines(lines: DataFrame) -> DataFrame:
    """Lines with more than white space; they keep their numbers."""
    return lines.where(f"NOT {is_blank('value')}")
