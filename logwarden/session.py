"""Session settings and the shared folder that holds intermediate tables."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

logger = logging.getLogger("logwarden")

#: Bytes of generated code in a method beyond which the JVM never compiles it; Spark's own limit lets such methods run interpreted,
#: at a third of the speed, where smaller methods for each operator would be compiled.
HUGE_METHOD = "8000"

# Folders written since the scope of a run began; None outside of runs.
_scope: ContextVar[list[str] | None] = ContextVar("scratch folders", default=None)
_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def get_session(app_name: str = "logwarden", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
    if context.applicationId not in _local_dirs:  # goes with the process
        _local_dirs[context.applicationId] = tempfile.TemporaryDirectory(prefix="logwarden-", ignore_cleanup_errors=True)
    return _local_dirs[context.applicationId].name


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Collect the folders that ``materialise`` writes inside the block.

    An error deletes them, as no table over them is left. A scope inside another one belongs to it.
    """
    outer = _scope.get()
    if outer is not None:
        yield outer
        return
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    except BaseException:
        drop_folders(spark, paths)
        raise
    finally:
        _scope.reset(token)


def drop_folders(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders in whatever store they lie; one that cannot be deleted is logged and stays."""
    context = spark.sparkContext
    for path in paths:
        try:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        except Exception as error:  # noqa: BLE001 (what is left over must not hide how the run ended)
            logger.warning("scratch folder %s was not deleted: %s", path, error)


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and leaves later
    readers a columnar table with column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)
