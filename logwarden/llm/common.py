"""Helpers of this folder: reading tables, shipping the code, crc32 folds and pass-through batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.session import materialise

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, as ``--py-files`` would, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="logwarden-py-"), f"logwarden_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "logwarden")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``materialise``, after which Spark removes the shuffle files of this write; no other reader needs them."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return materialise(df, name)
    finally:
        spark.conf.set(CLEANUP, before)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(parts)


def hash_share(rows: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """Rows whose key has one of the smallest hashes: some more than ``n`` of ``total`` rows, so that no task sends ``n`` rows of its own."""
    if total <= 4 * n:
        return rows
    return rows.where(F.xxhash64(key) < F.lit(-(2**63) + int(2**64 * 2.0 * n / total)))


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under names that no extra column can clash with; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def join_spread(rows: DataFrame, facts: DataFrame, key: str, times: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of many rows with one row of ``facts`` for each key; ``times`` tells how many of the ``total`` rows have the key.

    Keys of more than one in ``share`` rows are fewer than ``share``: they are sent to the rows. All others meet by key, so no task gets more than that share of one key.
    """
    hot = F.col(times) * F.lit(share) > F.lit(total)
    columns = [c for c in facts.columns if c not in (key, times)]
    sent = facts.where(hot).select(F.col(key).alias("_key"), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_{c}") for c in columns])
    first = rows.join(F.broadcast(sent), rows[key] == sent["_key"], "left")
    met = first.where("_hot is not null").select(*rows.columns, *[F.col(f"_{c}").alias(c) for c in columns])
    rest = first.where("_hot is null").select(*rows.columns)
    return met.unionByName(rest.join(facts.where(~hot).drop(times), key, "left").select(*met.columns))


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, object]], schema: str | T.StructType, rows: int = 10_000) -> DataFrame:
    """A DataFrame of the columns that ``make`` returns for each Arrow batch, or each ``rows`` rows of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                made = make(batch.slice(lo, rows))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()], names=list(made))

    return df.mapInArrow(run, schema)


def rewrite_batches(df: DataFrame, rewrite: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 1000) -> DataFrame:
    """Batches with all columns kept, whatever they are called; ``rewrite`` may drop rows or change columns, and gets few rows at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                yield rewrite(batch.slice(lo, rows))

    return df.mapInArrow(run, df.schema)
