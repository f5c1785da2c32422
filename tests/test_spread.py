"""Work that grows with a source is spread over tasks, whatever the files and the sources look like."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from checks.fixture import run_lines
from checks.queries import QUERIES
from logwarden.streaming.follow import arrival_order
from logwarden.streaming.live import LiveRun


@pytest.fixture
def conf(spark):
    kept = {}

    def change(key, value):
        kept[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)

    yield change
    for key, value in kept.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def share_of_largest(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.fixture
def one_group(spark, tmp_path):
    """Events in one row group that lies in many splits, of which one has all the rows."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").coalesce(1)
    events.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_lines_of_one_row_group_are_spread(spark, one_group, conf):
    conf("spark.sql.files.maxPartitionBytes", "8192")
    assert spark.read.parquet(f"{one_group}/events.parquet").rdd.getNumPartitions() >= 8
    assert share_of_largest(run_lines(spark, one_group)) < 0.3


def test_lines_of_one_source_stay_spread_when_they_are_placed(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    lines = spark.range(1, 8001, numPartitions=8).selectExpr("if(id > 0, 'a', 'b') AS source", "id AS line_no", "'x' AS value")
    sources = spark.createDataFrame([("a", 0, "web")], "source STRING, source_idx INT, format STRING")
    placed = arrival_order(lines, sources, 5)
    assert share_of_largest(placed) < 0.3
    assert placed.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()[:] == (6, 8005, 8000)


@pytest.mark.parametrize("name", ["assemble_partial_lines", "assemble_all_lines"])
def test_chunks_are_ordered_without_their_texts(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    rows = plan.splitlines()
    depth = lambda row: re.match(r"[\s:+|-]*", row).end()
    windows = [i for i, row in enumerate(rows) if re.match(r"[\s:+|-]*Window ", row)]
    assert windows
    for i in windows:
        child = rows[i + 1]
        assert depth(child) > depth(rows[i])
        assert not re.search(r"\btext#|\bvalue#", child), child


def test_late_entries_need_no_window_over_a_source(spark):
    plan = QUERIES["late_data"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    ordered = [row for row in plan.splitlines() if re.match(r"[\s:+|-]*Window ", row)]
    assert not [row for row in ordered if re.search(r"windowspecdefinition\(source#\d+, pos#", row)]


def test_lines_and_tails_of_a_batch_are_written_at_the_same_time(spark, tmp_path, monkeypatch):
    sources = spark.createDataFrame([("a", 0, "web")], "source STRING, source_idx INT, format STRING")
    run = LiveRun(spark, str(tmp_path / "run"), sources, [])
    both, write = threading.Barrier(2, timeout=60), run._write

    def meet(df, table, batch_id):
        if table in ("lines", "tails"):
            both.wait()  # breaks where one is written after the other
        return write(df, table, batch_id)

    monkeypatch.setattr(run, "_write", meet)
    chunks = spark.createDataFrame([("a", "0", "x\ny\nz")], "source STRING, chunk STRING, text STRING")
    run.on_batch(chunks, 0)
    assert [r.value for r in run.table("lines").orderBy("line_no").collect()] == ["x", "y"]
    assert [r.tail for r in run.table("tails").collect()] == ["z"]
