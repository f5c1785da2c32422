import gzip
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logwarden.plans.analyze import analyze
from logwarden.plans.rules import register_rule
from logwarden.schema import RuleError
from logwarden.sources.catalogue import build_sources, detect_format, reference_time_anchor
from logwarden.sources.lines import read_log_lines, source_files, unreadable_sources
from logwarden.sources.tables import list_reports, read_report_table, run_id, write_report_tables


def clock(at):
    return f"{at // 3600:02d}:{at // 60 % 60:02d}:{at % 60:02d}"


def hit(ip, at, target="/", status=200, agent="Mozilla/5.0"):
    return f'{ip} - - [10/Mar/2024:{clock(at)} +0000] "GET {target} HTTP/1.1" {status} 5 "-" "{agent}"'


def failure(ip, at, user="root"):
    return f"Mar 10 {clock(at)} h sshd[9]: Failed password for {user} from {ip} port 22 ssh2"


def write(path, lines, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(end.join(lines).encode() + end.encode())
    return str(path)


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    texts = {
        "a.log": [f"a{i}" if i % 7 else "" for i in range(3000)],
        "b.log": [f"b{i}" * 5 for i in range(900)],
        "c.log": ["only"],
    }
    paths = [write(tmp_path / n, v, "\r\n" if n[0] == "b" else "\n") for n, v in texts.items()]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in old:
            spark.conf.set(key, "1000")
        lines = read_log_lines(spark, paths[::-1], with_total=True)
        assert lines.rdd.getNumPartitions() > 8
        rows = lines.collect()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    got = {}
    for r in rows:
        got.setdefault((r.source_idx, r.source, r.total_lines), {})[r.line_no] = r.value
    assert {k: list(map(v.get, sorted(v))) for k, v in got.items()} == {
        (2 - i, p, len(v)): v for i, (p, v) in enumerate(zip(paths, texts.values()))}
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


def test_overlapping_paths_and_bad_bytes(spark, tmp_path):
    path = write(tmp_path / "d" / "x.log", ["ok"])
    (tmp_path / "d" / "y.log").write_bytes(b"\xff\xfeab\n")
    lines = read_log_lines(spark, [str(tmp_path / "d"), path]).collect()
    assert sorted((r.line_no, r.value) for r in lines) == [(1, "ok"), (1, "��ab")]
    missing = str(tmp_path / "none.log")
    assert [(r.source, r.line_no, r.raw) for r in unreadable_sources(spark, [path, missing]).collect()] == [
        (missing, 0, missing)]
    assert read_log_lines(spark, [missing]).count() == 0


def test_formats_from_the_first_twenty_lines(spark, tmp_path):
    junk = [f"# {i}" for i in range(20)]
    paths = {
        "web": write(tmp_path / "w.log", [*junk[:19], hit("1.1.1.1", 1)]),
        "auth": write(tmp_path / "a.log", ["", " ", *junk[:3], failure("1.1.1.1", 1)]),
        "late": write(tmp_path / "l.log", [*junk, hit("1.1.1.1", 1)]),
        "blank": write(tmp_path / "b.log", ["", "  "]),
        "far": write(tmp_path / "f.log", [""] * 1500 + [hit("1.1.1.1", 1)]),
    }
    files = source_files(spark, list(paths.values()))
    lines = read_log_lines(spark, list(paths.values()), files)
    found = {r.source: r.format for r in build_sources(lines, files).collect()}
    assert found == {paths["web"]: "web", paths["auth"]: "auth", paths["late"]: None, paths["blank"]: None,
                     paths["far"]: "web"}
    assert {r.source for r in detect_format(lines).collect()} == set(paths.values()) - {paths["blank"]}


def test_anchor_prefers_override_then_newest_web_stamp_then_now(spark, tmp_path):
    now = datetime(2030, 1, 2, tzinfo=timezone.utc)
    last = '1.1.1.1 - - [31/Dec/2023:23:30:00 -0200] "GET / HTTP/1.1" 200 1'
    web = write(tmp_path / "w.log", [hit("1.1.1.1", 1).replace("2024", "2022"), last, "junk"])
    auth = write(tmp_path / "a.log", [failure("1.1.1.1", 1)])

    def anchor(*paths, **options):
        files = source_files(spark, paths)
        lines = read_log_lines(spark, paths, files)
        return reference_time_anchor(lines, build_sources(lines, files, now=now), now=now, **options)

    got = anchor(web, auth)
    assert got.moment == datetime(2024, 1, 1, 1, 30, tzinfo=timezone.utc) and not got.fell_back_to_now
    assert got.moment.year == 2023 and got.moment.utcoffset() == timedelta(hours=-2)
    assert anchor(auth).moment == now and anchor(auth).fell_back_to_now
    assert anchor(auth, override=datetime(2020, 1, 1)).moment == datetime(2020, 1, 1, tzinfo=timezone.utc)


SQLI = ["/s?q=1%27%20OR%201=1", "/s?q=1%20UNION%20SELECT%20x", "/s?q=1;%20DROP%20TABLE%20t", "/s?q=sleep(5)"]


def test_whole_run_over_files(spark, tmp_path):
    ip = "203.0.113.7"
    web = write(tmp_path / "web.log", [
        "# header", hit("8.8.8.8", 0, "/o%27brien"), hit(ip, 60, "/a/../../etc/passwd"), hit(ip, 61, "/x/%2e%2e/y"),
        "", *[hit("9.9.9.9", 100 + i, t) for i, t in enumerate(SQLI)],
        *[hit("7.7.7.7", 200 + i, "/login", 401) for i in range(10)],
        *[hit("6.6.6.6", 300 + i, f"/p{i % 16}/", 404) for i in range(20)],
        hit("5.5.5.5", 400, agent="-"), hit("4.4.4.4", 401, agent="Nikto/2"),
    ])
    first = write(tmp_path / "h1" / "auth.log", [
        *[failure(ip, 200 + i) for i in range(5)], *[failure("3.3.3.3", 300 + i) for i in range(4)],
        *[failure("2.2.2.2", 350 + i) for i in range(5)],
        f"Mar 10 {clock(390)} h sudo: al : TTY=x ; COMMAND=/bin/cat /etc/shadow", "Mar 10 bad",
    ])
    second = write(tmp_path / "h2" / "auth.log", [failure("2.2.2.2", 356)])
    junk = write(tmp_path / "junk.log", ["nothing", "here"])
    missing = str(tmp_path / "missing.log")
    run = analyze(spark, [web, first, second, junk, missing])
    found = {(r.rule_id, r.source_ip): r for r in run.findings.collect()}
    assert {k: r["count"] for k, r in found.items()} == {
        ("directory_traversal", ip): 2, ("ssh_brute_force", ip): 5, ("sql_injection", "9.9.9.9"): 4,
        ("web_login_brute_force", "7.7.7.7"): 10, ("web_scanning", "6.6.6.6"): 16,
        ("scanner_user_agent", "5.5.5.5"): 1, ("scanner_user_agent", "4.4.4.4"): 1,
        ("ssh_brute_force", "2.2.2.2"): 6, ("sudo_privilege_escalation", None): 1,
    }
    burst = found["ssh_brute_force", "2.2.2.2"]
    assert burst.sources == [first, second]
    assert [(e.source, e.line_no) for e in burst.evidence] == [(first, 14), (second, 1)]
    assert burst.metadata == {"match": "auth_failure", "distinct_by": None, "threshold": "5", "window_seconds": "60.0"}
    got = [(r.source_ip, r.severity_name, r.finding_count) for r in run.incidents.collect()]
    assert got == [(ip, "CRITICAL", 2), ("2.2.2.2", "CRITICAL", 1)]
    assert sorted((r.source, r.line_no) for r in run.parse_errors.collect()) == sorted(
        [(web, 1), (first, 16), (missing, 0)])
    assert [r.source for r in run.skipped.collect()] == [junk]
    totals = run.totals.first().asDict()
    assert totals == {"lines_read": 58, "parsed": 55, "malformed": 2, "skipped_blank": 1, "findings": 9, "incidents": 2}

    out = str(tmp_path / "reports")
    assert list_reports(spark, out).count() == 0
    moments = [datetime(2024, 5, 1, h, tzinfo=timezone.utc) for h in (1, 3, 2)]
    for moment in moments:
        write_report_tables(run.tables, out, generated_at=moment)
    assert [r.run_id for r in list_reports(spark, out).collect()] == [run_id(m) for m in sorted(moments)[::-1]]
    assert read_report_table(spark, out, "findings", run_id(moments[0])).count() == 9

    none = analyze(spark, [web], max_evidence=0, window_minutes=0)
    assert {len(r.evidence) for r in none.findings.collect()} == {0} and none.incidents.count() == 0
    with pytest.raises(ValueError, match="max_evidence"):
        analyze(spark, [web], max_evidence=-1)
    with pytest.raises(RuleError, match="no recognized log files"):
        analyze(spark, [junk])


def test_a_failing_rule_costs_only_itself(spark, tmp_path):
    @register_rule("explodes")
    def explodes(entries, rule):
        return entries.select(F.raise_error(F.lit("no")).alias("rule_id"))

    @register_rule("cannot_plan")
    def cannot_plan(entries, rule):
        raise KeyError(rule.extra["missing"])

    web = write(tmp_path / "w.log", [hit("1.1.1.1", 1, "/.env")])
    specs = [
        {"id": "e", "type": "explodes"},
        {"id": "p", "type": "cannot_plan"},
        {"id": "s", "type": "signature", "params": {"patterns": [r"\.env$"]}},
    ]
    assert [r.rule_id for r in analyze(spark, [web], specs).findings.collect()] == ["s"]


def test_no_file_is_lost_by_its_name_or_place(spark, tmp_path):
    names = ["with space.log", "per%20cent.log", "plus+.log", "a[1].log", "b{x}.log", "nest/host1/auth.log", "part=1/x.log", "plain.log"]
    for n in names:
        write(tmp_path / "in" / n, [n, "second"])
    write(tmp_path / "in" / "_SUCCESS", ["no source"])
    folder = str(tmp_path / "in")
    want = sorted((f"{folder}/{n}", i, v) for n in names for i, v in ((1, n), (2, "second")))
    for given in ([folder], [f"{folder}/{n}" for n in names], [f"{folder}/plain.log", folder, f"{folder}/*"]):
        lines = read_log_lines(spark, given, with_total=True).collect()
        assert sorted((r.source, r.line_no, r.value) for r in lines) == want
        assert sorted(r.pos for r in lines) == list(range(1, len(want) + 1))
        assert unreadable_sources(spark, given).count() == 0
    hidden, broken = write(tmp_path / "_auth.log", ["x"]), tmp_path / "bad.gz"
    broken.write_bytes(b"\x1f\x8b no archive at all")
    errors = unreadable_sources(spark, [hidden, str(broken), f"{folder}/none*", folder]).collect()
    assert {(r.source, r.line_no) for r in errors} == {(hidden, 0), (str(broken), 0), (f"{folder}/none*", 0)}
    good = read_log_lines(spark, [str(broken), f"{folder}/plain.log"]).collect()
    assert sorted(r.value for r in good) == ["plain.log", "second"]


def test_files_that_break_off_are_error_rows(spark, tmp_path):
    rng = random.Random(5)
    data = gzip.compress("\n".join(hit("1.1.1.1", i % 60, f"/{rng.random()}") for i in range(20_000)).encode())
    cut, other = tmp_path / "in" / "cut +%20.log.gz", tmp_path / "in" / "cut +%20.log"
    good = write(tmp_path / "in" / "good.log", [hit("2.2.2.2", 1)])
    cut.write_bytes(data[: len(data) // 2])
    other.write_text(hit("3.3.3.3", 2) + "\n")
    (tmp_path / "in" / "bad.gz").write_bytes(b"\x1f\x8b no archive at all")
    folder = str(tmp_path / "in")
    rows = read_log_lines(spark, [folder], with_total=True).collect()
    n = sum(r.source == str(cut) for r in rows)
    assert 0 < n < 20_000 and {r.source for r in rows} == {str(cut), str(other), good}
    assert sorted(r.line_no for r in rows if r.source == str(cut)) == list(range(1, n + 1))
    assert sorted(r.pos for r in rows) == list(range(1, len(rows) + 1))
    want = {(str(cut), f"OSError: broke off after {n} lines: {cut}"), (f"{folder}/bad.gz", f"OSError: no line could be read from {folder}/bad.gz")}
    assert {(r.source, r.reason) for r in unreadable_sources(spark, [folder]).collect()} == want
    errors = analyze(spark, [folder], []).parse_errors.where("line_no = 0").collect()
    assert {(r.source, r.reason) for r in errors} == want


def test_many_broken_files_cost_a_few_passes(spark, tmp_path, monkeypatch):
    from logwarden.sources import lines as L

    folder = tmp_path / "in"
    folder.mkdir()
    data = gzip.compress("\n".join(hit("1.1.1.1", i % 60, f"/{random.Random(i).random()}") for i in range(3_000)).encode())
    want, names = set(), []
    for i in range(24):
        path = folder / f"{i:02d}.log.gz"
        cut = i % 3 == 1 or i in (20, 21, 22)
        path.write_bytes(data[: len(data) // 2] if cut else data)
        want |= {str(path)} if cut else set()
        names.append(str(path))
    monkeypatch.setattr(L, "FAN_OUT", 4)
    read, counts = [], []
    text, blocks = L._text, L._blocks
    monkeypatch.setattr(L, "_text", lambda spark, paths, skip: read.append((len(paths), skip)) or text(spark, paths, skip))
    monkeypatch.setattr(L, "_blocks", lambda numbered: counts.append(1) or blocks(numbered))
    scan = L.scan_files(spark, [str(folder)])
    assert set(scan.broken) == want and len(want) == 10
    # Levels of 24, 6, 2 and 1 files, each file once at most in each, then the count of what is whole.
    assert sum(n for n, skip in read if not skip) <= 1 + 4 * 24 + 14 and len(counts) == 3
    whole, broken = L.sift_files(spark, names)
    assert whole == [n for n in names if n not in want] and broken == [n for n in names if n in want]
    assert L.sift_files(spark, []) == ([], []) and L.sift_files(spark, names[:1]) == (names[:1], [])
    numbered = read_log_lines(spark, [str(folder)], scan=scan)
    assert numbered.where(F.col("source").isin([n for n in names if n not in want])).count() == 14 * 3_000


def test_faults_of_machines_are_not_blamed_on_files(spark, tmp_path, monkeypatch):
    from logwarden.sources import lines as L

    path = write(tmp_path / "a.log", ["x"])
    failing = lambda spark, paths, skip: spark.read.text(paths).where("raise_error('lost') IS NULL")
    monkeypatch.setattr(L, "_text", failing)
    with pytest.raises(Exception, match="lost"):
        L.sift_files(spark, [path])


def test_a_thousand_names_are_one_reader(spark, tmp_path):
    paths = [write(tmp_path / f"{i}.log", [hit("1.1.1.1", i % 60)]) for i in range(200)]
    assert len(source_files(spark, paths).collect()) == 200
    assert read_log_lines(spark, paths).count() == 200
