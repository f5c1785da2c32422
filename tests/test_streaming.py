import random

import pytest
from pyspark.sql import functions as F

from logwarden.operators.entries import entries_of, parse_lines
from logwarden.operators.threshold import threshold_findings
from logwarden.plans.analyze import analyze_parsed
from logwarden.plans.rules import build_rules
from logwarden.streaming.alerts import fold_counts
from logwarden.streaming.follow import TAILS, assemble_partial_lines
from logwarden.streaming.live import LiveRun

CHUNKS = "source STRING, chunk STRING, text STRING"
SOURCES = "source STRING, source_idx INT, format STRING"


def test_partial_lines_are_held_and_numbered(spark):
    rng = random.Random(5)
    texts = {s: "".join(rng.choice(["a", "b", "", "\n", "\r\n", "\r", "line\n"]) for _ in range(120)) for s in "xyz"}
    chunks = []
    for source, text in texts.items():
        at = 0
        while at < len(text):
            size = rng.randint(1, 12)
            chunks.append((source, f"{len(chunks):05d}", text[at : at + size]))
            at += size
    tails = spark.createDataFrame([], TAILS)
    got = []
    for start in range(0, len(chunks), 17):
        batch = spark.createDataFrame(chunks[start : start + 17], CHUNKS).repartition(3)
        lines, left = assemble_partial_lines(batch, tails)
        got += [tuple(r) for r in lines.select("source", "line_no", "value").collect()]
        tails = spark.createDataFrame(left.collect(), TAILS)
    for source, text in texts.items():
        held = text[:-1] if text.endswith("\r") else text
        want = held.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        assert sorted((n, v) for s, n, v in got if s == source) == list(enumerate(want[:-1], 1))
        state = {r.source: r for r in tails.collect()}[source]
        assert (state.lines, state.tail) == (len(want) - 1, want[-1] + ("\r" if text.endswith("\r") else ""))


SPECS = [
    {"id": "burst", "type": "threshold", "params": {"match": "auth_failure", "threshold": 4, "window_seconds": 20}},
    {"id": "users", "type": "threshold",
     "params": {"match": "auth_failure", "threshold": 3, "window_seconds": 30, "distinct_by": "username"}},
    {"id": "sig", "type": "signature", "params": {"patterns": ["etc/passwd"], "min_hits": 3}},
]


def make_lines(seed, size):
    rng = random.Random(seed)
    t, out = 0, {"auth": [], "web": []}
    for _ in range(size):
        t += rng.choice([0, 0, 1, 2, 7])
        stamp = max(t - (rng.randint(0, 25) if rng.random() < 0.2 else 0), 0)
        clock = f"{stamp // 3600:02d}:{stamp // 60 % 60:02d}:{stamp % 60:02d}"
        ip = f"10.0.0.{rng.randint(1, 3)}"
        if rng.random() < 0.6:
            out["auth"].append(f"Jan 05 {clock} h sshd[1]: Failed password for u{rng.randint(1, 5)} from {ip} port 22 ssh2")
        else:
            path = rng.choice(["/home", "/x?f=%2e%2e/etc/passwd", "bad"])
            out["web"].append(f'{ip} - - [05/Jan/2024:{clock} +0000] "GET {path} HTTP/1.1" 200 1')
    return out


def test_stream_finds_what_a_run_over_the_same_lines_finds(spark, tmp_path):
    text = {s: "\n".join(v) + "\nunfinished" for s, v in make_lines(3, 400).items()}
    landing = tmp_path / "landing"
    sources = spark.createDataFrame([("web", 0, "web"), ("auth", 1, "auth")], SOURCES)
    run = LiveRun(spark, str(tmp_path / "run"), sources, SPECS, default_year=2024)
    cuts = {s: sorted(random.Random(4).sample(range(len(t)), 2)) for s, t in text.items()}
    for number in range(3):
        for source, whole in text.items():
            edges = [0, *cuts[source], len(whole)]
            (landing / source).mkdir(parents=True, exist_ok=True)
            (landing / source / f"{number:03d}").write_text(whole[edges[number] : edges[number + 1]])
        run.follow(str(landing), availableNow=True).awaitTermination()

    parsed = run.table("parsed").cache()
    lines = {s: t.split("\n")[:-1] for s, t in text.items()}
    assert {r.source: (r.n, r.last) for r in parsed.groupBy("source").agg(
        F.count("*").alias("n"), F.max("line_no").alias("last")).collect()} == {
            s: (len(v), len(v)) for s, v in lines.items()}
    again = parse_lines(
        parsed.selectExpr("source", "source_idx", "line_no", "pos", "raw AS value",
                          "if(source = 'web', 'web', 'auth') AS format"), default_year=2024)
    assert again.exceptAll(parsed.select(again.columns)).count() == 0

    rules = build_rules(SPECS)
    bursts = threshold_findings(entries_of(parsed), rules)
    alerts = run.live_alerts().collect()
    assert sorted((r.rule_id, r.source_ip, r.pos) for r in alerts if r.rule_id != "sig") == sorted(
        (r.rule_id, r.source_ip, r.emit_pos) for r in bursts.collect())
    report = run.finalize()
    want = analyze_parsed(parsed, rules)
    for table in ("findings", "incidents", "totals"):
        rows = lambda a: sorted(str(r) for r in a.tables[table].collect())  # noqa: B023,E731
        assert rows(report) == rows(want)
    sig = [(r.source_ip, r.emit_pos) for r in report.findings.collect() if r.rule_id == "sig"]
    assert sorted(sig) == sorted((r.source_ip, r.pos) for r in alerts if r.rule_id == "sig") and sig
    assert all(r["count"] == 3 for r in alerts if r.rule_id == "sig")


def test_a_chunk_that_comes_too_late_stops_the_run(spark):
    schema = "source STRING, chunk STRING, text STRING"
    _, tails = assemble_partial_lines(spark.createDataFrame([("s", "001", "a\nb")], schema), spark.createDataFrame([], TAILS))
    assert [tuple(r) for r in tails.collect()] == [("s", 1, "b", "001")]
    tails = spark.createDataFrame(tails.collect(), TAILS)
    done, left = assemble_partial_lines(spark.createDataFrame([("s", "002", "c\n")], schema), tails)
    assert [(r.line_no, r.value) for r in done.collect()] == [(2, "bc")] and left.first()["last"] == "002"
    late, _ = assemble_partial_lines(spark.createDataFrame([("s", "000", "x\n")], schema), tails)
    with pytest.raises(Exception, match="came after"):
        late.collect()


def test_alerts_before_the_first_batch(spark, tmp_path):
    sources = spark.createDataFrame([], "source STRING, source_idx INT, format STRING")
    assert LiveRun(spark, str(tmp_path / "run"), sources).live_alerts().count() == 0


def test_a_source_that_joins_later_loses_no_line(spark, tmp_path):
    landing = tmp_path / "landing"
    sources = spark.createDataFrame([("web", 0, "web")], SOURCES)
    run = LiveRun(spark, str(tmp_path / "run"), sources, SPECS, default_year=2024)
    web = '1.1.1.1 - - [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 5 "-" "a"\n'
    auth = "Jan  1 00:00:01 host sshd[1]: Failed password for root from 2.2.2.2 port 22 ssh2\n"
    batches = [{"web": web}, {"late": auth, "junk": "no log\n\n", "slow": "\n"}, {"late": "odd\n" + auth, "junk": "nor this\n", "slow": auth, "web": web}]
    for number, chunks in enumerate(batches):
        for source, text in chunks.items():
            (landing / source).mkdir(parents=True, exist_ok=True)
            (landing / source / f"{number:03d}").write_text(text)
        run.follow(str(landing), availableNow=True).awaitTermination()
    rows = run.table("parsed").orderBy("source", "line_no").collect()
    assert [(r.source, r.line_no, r.kind) for r in rows] == [
        ("junk", 1, "error"), ("junk", 2, "blank"), ("junk", 3, "error"), ("late", 1, "auth"), ("late", 2, "error"),
        ("late", 3, "auth"), ("slow", 1, "blank"), ("slow", 2, "auth"), ("web", 1, "web"), ("web", 2, "web"),
    ]
    assert sorted(r.pos for r in rows) == list(range(1, 11))
    assert {r.source: r.source_idx for r in rows} == {"web": 0, "junk": 1, "late": 2, "slow": 3}
    assert {r.source for r in run.finalize().parse_errors.collect()} == {"junk", "late"}


def batches_of(spark, run, seed, size, number, sources=("auth", "web")):
    """Lines of ``make_lines`` dealt over batches, given to the run one after another."""
    lines = make_lines(seed, size)
    for batch in range(number):
        rows = [(s, n + 1, v) for s in sources for n, v in enumerate(lines[s]) if n * number // len(lines[s]) == batch]
        run.on_lines(spark.createDataFrame(rows, "source STRING, line_no BIGINT, value STRING").repartition(2), batch)


def test_keyed_state_gives_the_alerts_of_a_whole_run(spark, tmp_path):
    sources = spark.createDataFrame([("web", 0, "web"), ("auth", 1, "auth")], SOURCES)
    run = LiveRun(spark, str(tmp_path / "run"), sources, SPECS, default_year=2024, state_buckets=2, fold_after=2)
    batches_of(spark, run, 11, 300, 6)
    parsed = run.table("parsed").cache()
    bursts = threshold_findings(entries_of(parsed), build_rules(SPECS)).collect()
    alerts = run.live_alerts().collect()
    assert sorted((r.rule_id, r.source_ip, r.pos) for r in alerts if r.rule_id != "sig") == sorted(
        (r.rule_id, r.source_ip, r.emit_pos) for r in bursts)
    assert len({r.rule_id for r in bursts}) == 2 and run.late_rows().count() == 0
    found = [(r.source_ip, r.emit_pos) for r in run.finalize().findings.collect() if r.rule_id == "sig"]
    assert sorted(found) == sorted((r.source_ip, r.pos) for r in alerts if r.rule_id == "sig")


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    sources = spark.createDataFrame([("web", 0, "web"), ("auth", 1, "auth")], SOURCES)
    run = LiveRun(spark, str(tmp_path / "run"), sources, SPECS[2:], default_year=2024, state_buckets=2, fold_after=1)
    lines = make_lines(12, 60)["web"] + ['10.0.0.1 - - [05/Jan/2024:00:00:00 +0000] "GET /etc/passwd HTTP/1.1" 200 1'] * 4
    for batch in range(3):
        rows = [("web", n + 1, v) for n, v in enumerate(lines) if n % 3 == batch]
        frame = spark.createDataFrame(rows, "source STRING, line_no BIGINT, value STRING")
        for _ in range(1 + (batch > 1)):
            run.on_lines(frame, batch)
    counts = fold_counts(run.counts.read(3, {0, 1})).groupBy().agg(F.sum("hits")).first()[0]
    assert counts == sum("etc/passwd" in v for v in lines)


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    """Fifty batches of new keys: the last ones write no more than the first, but for the buckets they fold."""
    run = LiveRun(spark, str(tmp_path / "run"), spark.createDataFrame([], SOURCES), [], state_buckets=8, fold_after=12)
    written, folded = [], 0
    for batch in range(50):
        rows = spark.createDataFrame([(0, f"10.{batch}.0.{i}", 1, batch) for i in range(3)], "rule INT, ip STRING, hits BIGINT, at BIGINT")
        run.counts.append(rows, batch, run.counts.buckets_of(rows), fold_counts)
        run.counts.forget(batch)
        written.append(spark.read.parquet(str(tmp_path / "run" / "counts" / f"batch={batch}")).count())
        folded += written[-1] > 3
    assert len(written) == 50 and sum(n == 3 for n in written) == 50 - folded and 0 < folded <= 16
    left = run.counts.read(50, set(range(8)))
    assert left.count() == left.distinct().count() == 150
    kept = {p.parent.parent.name for p in (tmp_path / "run" / "counts").rglob("*.parquet")}
    assert len(list((tmp_path / "run" / "counts_pieces").iterdir())) == 2 and len(kept) < 50


def test_expiry_drops_idle_addresses_and_counts_late_rows(spark, tmp_path):
    sources = spark.createDataFrame([("web", 0, "web")], SOURCES)
    line = '{} - - [05/Jan/2024:00:{:02d}:00 +0000] "GET /etc/passwd HTTP/1.1" 404 1'
    specs = [SPECS[2], {"id": "scan", "type": "threshold", "params": {"match": "web_404", "threshold": 3, "window_seconds": 90}}]

    def lines_of(batch):
        return [line.format(f"10.0.0.{batch}", batch)] + ([line.format("10.9.9.9", 0)] if batch in (4, 5, 6) else [])

    def all_of(name, expire_after):
        run = LiveRun(spark, str(tmp_path / name), sources, specs, default_year=2024, state_buckets=2, fold_after=4, expire_after=expire_after)
        at = 0
        for batch in range(9):
            values = lines_of(batch)
            run.on_lines(spark.createDataFrame([("web", at + i + 1, v) for i, v in enumerate(values)], "source STRING, line_no BIGINT, value STRING"), batch)
            at += len(values)
        return run

    bounded, whole = all_of("bounded", 120), all_of("whole", None)
    assert {r["source_ip"] for r in whole.live_alerts().collect()} == {"10.9.9.9"}
    assert bounded.live_alerts().count() == 0 and [tuple(r) for r in bounded.late_rows().collect()] == [("web", 3)]
    keys = lambda run, log: {r["ip"] for r in log.read(9, {0, 1}).collect()}
    assert len(keys(whole, whole.counts)) == 10
    # a bucket is folded every second batch: what was idle for longer than that, the window and the two minutes is gone
    for log in (bounded.counts, bounded.windows):
        assert keys(bounded, log) <= {f"10.0.0.{b}" for b in range(3, 9)}
    assert bounded.table("parsed").count() == whole.table("parsed").count() == 12
    with pytest.raises(ValueError):
        LiveRun(spark, str(tmp_path / "x"), sources, specs, expire_after=-1)
