"""Intermediate tables of a run, reports that were not written to the end, places of lines."""

import os

import pytest

from logwarden.operators.entries import parse_lines
from logwarden.operators.signature import first_hits
from logwarden.plans.analyze import analyze, analyze_lines
from logwarden.plans.rules import RULE_TYPES
from logwarden.schema import LINES
from logwarden.session import materialise, scratch_scope
from logwarden.sources.tables import read_report_table, write_report_tables

LINE = '1.2.3.4 - - [10/Mar/2024:10:00:0%d +0000] "GET /a/../../etc/passwd HTTP/1.1" 200 5 "-" "Nikto"'


@pytest.fixture
def shared(monkeypatch, tmp_path):
    """A folder of its own for the intermediate tables."""
    folder = tmp_path / "shared"
    folder.mkdir()
    monkeypatch.setattr("logwarden.session.scratch_dir", lambda spark: str(folder))
    return folder


def log(tmp_path):
    path = tmp_path / "web.log"
    path.write_text("".join(LINE % i + "\n" for i in range(5)))
    return str(path)


def test_no_folder_of_a_finished_run_is_left(spark, shared, tmp_path):
    with analyze(spark, [log(tmp_path)]) as run:
        assert {p.rsplit("/", 1)[1] for p in run.scratch} == set(os.listdir(shared)) and len(run.scratch) > 4
        name = write_report_tables(run.tables, str(tmp_path / "reports"))
        want = sorted(map(str, run.findings.collect()))
    assert os.listdir(shared) == [] and run.scratch == []
    read = read_report_table(spark, str(tmp_path / "reports"), "findings", name).drop("run_id")
    assert sorted(map(str, read.select(*run.findings.columns).collect())) == want != []


def test_a_run_that_fails_leaves_nothing(spark, shared, tmp_path, monkeypatch):
    def stop(entries, rule):
        raise OSError("no space left")

    monkeypatch.setitem(RULE_TYPES, "full_disk", stop)
    spec = {"id": "x", "name": "x", "type": "full_disk", "severity": "low", "log_type": "web"}
    with pytest.raises(OSError, match="no space left"):
        analyze(spark, [log(tmp_path)], [spec])
    assert os.listdir(shared) == []


def test_scopes(spark, shared):
    table = spark.range(3)
    materialise(table, "outside")
    with scratch_scope(spark) as outer:
        materialise(table, "a")
        with scratch_scope(spark) as inner:
            kept = materialise(table, "b")
        assert inner is outer and len(outer) == 2 and kept.count() == 3
    assert len(os.listdir(shared)) == 3


def test_a_half_written_run_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "reports")
    table = spark.createDataFrame([(1,)], "n INT")
    table.write.parquet(f"{folder}/findings/run_id=report_2024_01_01_00_00_00")
    assert read_report_table(spark, folder, "findings").count() == 0
    name = write_report_tables({"findings": table.selectExpr("n + 1 AS n")}, folder)
    got = [tuple(r) for r in read_report_table(spark, folder, "findings").collect()]
    assert got == [(2, name)]
    assert read_report_table(spark, folder, "findings", "report_2024_01_01_00_00_00").count() == 0


@pytest.mark.parametrize(("source_idx", "line_no"), [(1 << 23, 1), (0, 1 << 40)])
def test_a_line_without_a_place_is_an_error(spark, source_idx, line_no):
    def parsed(*rows):
        table = spark.createDataFrame([("s", i, n, LINE % 1, "web") for i, n in rows], LINES + ", format STRING")
        return parse_lines(table).select("pos")

    last = ((1 << 23) - 1, (1 << 40) - 1)
    assert [r.pos for r in parsed((0, 1), last).orderBy("pos").collect()] == [1, (1 << 63) - 1]
    with pytest.raises(Exception, match="no place for line"):
        parsed((0, 1), (source_idx, line_no)).collect()


def test_first_hits_follow_the_limit_of_the_session(spark):
    hits = spark.range(60).selectExpr("CAST(id % 2 AS INT) AS rule", "'1.1.1.1' AS ip", "id << 18 AS pos")
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    want = sorted(map(str, first_hits(hits, 7).collect()))
    spark.conf.set(key, "5")
    try:
        chunked = first_hits(hits, 7)
        assert sorted(map(str, chunked.select("rule", "ip", "pos", "rank").collect())) == want and len(want) == 14
        assert "chunk" in chunked._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset(key)


def test_lines_of_a_run_stay_readable_until_close(spark, shared, tmp_path):
    lines = spark.createDataFrame([("s", 0, i + 1, LINE % i, "web") for i in range(5)], LINES + ", format STRING")
    run = analyze_lines(lines)
    assert run.findings.count() > 0 and run.totals.count() == 1
    run.close()
    assert os.listdir(shared) == []
