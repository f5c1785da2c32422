import re
from datetime import datetime, timezone
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from logwarden.functions.decode import decode_variants
from logwarden.functions.presets import normal_path
from logwarden.operators.entries import parse_auth_log, parse_errors, parse_lines
from logwarden.plans.analyze import analyze_lines

WEB = [
    '10.0.0.1 - bob [10/Oct/2023:13:55:36 +0000] "GET /a?b=1?c HTTP/1.1" 200 2326 "-" "Mozilla/5.0"',
    '10.0.0.2 id - [9/oct/2023:3:5:6 -0730] "GET /x" 404 -',
    'host-a - - [10/Oct/2023:13:55:36 +05:30] "A  b   c d HTTP/2" - 12 "" ""',
    '- - - [10/Oct/2023:13:55:36 Z] "ONE" 200 0 "r" "a"  ',
    '::1 - - [10/Oct/2023:13:55:36 +0000] "" 200 0',
    '1.1.1.1 - - [10/Oct/2023:13:55:60 +0000] "GET / HTTP/1.1" 200 0',
    '1.1.1.1 - - [31/Feb/2023:13:55:00 +0000] "GET / HTTP/1.1" 200 0',
    '1.1.1.1 - - [10/Oct/2023:13:55:00] "GET / HTTP/1.1" 200 0',
    '1.1.1.1 - - [10/Oct/2023:13:55:00 +2400] "GET / HTTP/1.1" 200 0',
    '1.1.1.1 - - [10/Oct/2023:13:55:00 +0530:00] "GET / HTTP/1.1" 200 0',
    "garbage",
    "   ",
    '1.1.1.1 - - [10/Oct/2023:13:55:00 +0000] "GET / HTTP/1.1" 20 0',
    '1.1.1.1 - - [10/Oct/2023:13:55:00 +0000] "GET /é HTTP/1.1" 200 5 "only referrer"',
]


def lines(spark, values, source="s", fmt="web"):
    rows = [(source, 0, i, v) for i, v in enumerate(values, 1)]
    frame = spark.createDataFrame(rows, "source STRING, source_idx INT, line_no BIGINT, value STRING")
    return frame.withColumn("format", F.lit(fmt))


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc).timestamp()


def test_web_fields(spark):
    rows = {r.line_no: r for r in parse_lines(lines(spark, WEB)).withColumn("us", F.unix_micros("ts")).collect()}
    stamp = {n: r.us / 1e6 for n, r in rows.items() if r.us is not None}
    assert stamp == {
        1: utc(2023, 10, 10, 13, 55, 36),
        2: utc(2023, 10, 9, 10, 35, 6),
        3: utc(2023, 10, 10, 8, 25, 36),
        4: utc(2023, 10, 10, 13, 55, 36),
        5: utc(2023, 10, 10, 13, 55, 36),
    }
    picked = ["source_ip", "method", "target", "path", "query", "protocol", "status", "size", "identity", "user",
              "referrer", "user_agent"]
    got = {n: tuple(rows[n][c] for c in picked) for n in (1, 2, 3, 4, 5)}
    assert got == {
        1: ("10.0.0.1", "GET", "/a?b=1?c", "/a", "b=1?c", "HTTP/1.1", 200, 2326, None, "bob", "-", "Mozilla/5.0"),
        2: ("10.0.0.2", "GET", "/x", "/x", None, None, 404, 0, "id", None, None, None),
        3: ("host-a", "A", "b c d", "b c d", None, "HTTP/2", None, 12, None, None, "", ""),
        4: (None, "ONE", None, None, None, None, 200, 0, None, None, "r", "a"),
        5: ("::1", None, None, None, None, None, 200, 0, None, None, None, None),
    }
    assert {n: r.kind for n, r in rows.items() if n > 5} == {
        6: "error", 7: "error", 8: "error", 9: "error", 10: "error", 11: "error", 12: "blank", 13: "error", 14: "error"}
    assert [rows[n].reason for n in range(6, 15)] == ["bad timestamp"] * 5 + [
        "does not match Combined log format", None] + ["does not match Combined log format"] * 2


AUTH = [
    ("Jan  5 01:02:03 h sshd[77]: Failed password for root from 1.2.3.4 port 22 ssh2", "failure", "root", "1.2.3.4", 22, 77),
    ("Jan  5 01:02:03 h sshd[7]: Failed password for invalid user  bob from 1.2.3.4 port 22", "invalid_user", "bob", "1.2.3.4", 22, 7),
    ("Jan 15 01:02:03 h sshd: Accepted publickey for al from 999.2.3.4", "success", "al", "999.2.3.4", None, None),
    ("Jan 15 01:02:03 h sshd: FAILED none for Invalid User x1 [preauth]", "invalid_user", "x1", None, None, None),
    ("Jan 15 01:02:03 h sshd[1]: Connection closed by 5.6.7.8 port 4242 [preauth]", "other", None, "5.6.7.8", 4242, 1),
    ("Jan 15 01:02:03 h sudo: u : COMMAND=/bin/cat /etc/shadow", "other", None, None, None, None),
    ("Jan 15 01:02:03 h x[1]: message from 1.2.3.4 then port 9", "other", None, "1.2.3.4", None, 1),
    ("Jan 15 01:02:03 h x[1]:", "other", None, None, None, 1),
]


def test_only_newlines_go_from_the_end(spark):
    rows = parse_lines(lines(spark, ["Jan 15 01:02:03 h x: in\\n\n", "nnn"], fmt="auth"), default_year=2024)
    assert [r.raw for r in rows.orderBy("line_no").collect()] == ["Jan 15 01:02:03 h x: in\\n", "nnn"]


def test_auth_fields(spark):
    parsed = parse_auth_log(lines(spark, [a[0] for a in AUTH]).drop("format"), default_year=2024)
    got = [(r.outcome, r.username, r.source_ip, r.source_port, r.pid) for r in parsed.orderBy("line_no").collect()]
    assert got == [a[1:] for a in AUTH]


@pytest.mark.parametrize(
    "stamp,anchor,want",
    [
        ("Oct 10 10:00:00", datetime(2026, 7, 30), "2025-10-10 10:00:00"),
        ("Jan 10 10:00:00", datetime(2026, 7, 30), "2026-01-10 10:00:00"),
        ("Jul 30 00:00:00", datetime(2026, 7, 30), "2026-07-30 00:00:00"),
        ("Feb 29 10:00:00", datetime(2024, 2, 1), "2023-02-28 10:00:00"),
        ("Feb 29 10:00:00", datetime(2025, 3, 1), None),
        ("Feb 30 10:00:00", datetime(2024, 3, 1), None),
        ("Xyz 10 10:00:00", datetime(2024, 3, 1), None),
        ("Jan 00 10:00:00", datetime(2024, 3, 1), None),
        ("Jan 10 24:00:00", datetime(2024, 3, 1), None),
        ("Jan 10 10:00:60", datetime(2024, 3, 1), None),
    ],
)
def test_syslog_year(spark, stamp, anchor, want):
    parsed = parse_lines(lines(spark, [f"{stamp} h p: m"], fmt="auth"), reference_time=anchor)
    row = parsed.select(F.col("ts").cast("string").alias("ts"), "reason").first()
    assert row.ts == want and (row.reason == "bad timestamp") == (want is None)


def test_anchor_year_is_read_in_its_own_offset(spark):
    anchor = datetime.fromisoformat("2026-01-01T01:00:00+03:00")  # 2025-12-31T22:00Z
    parsed = parse_lines(lines(spark, ["Dec 31 21:00:00 h p: m"], fmt="auth"), reference_time=anchor)
    assert parsed.select(F.col("ts").cast("string")).first()[0] == "2025-12-31 21:00:00"


def test_errors_keep_source_line_and_reason(spark):
    got = parse_errors(parse_lines(lines(spark, ["x", "", "y"], source="f", fmt="auth"), default_year=2024)).collect()
    assert [tuple(r) for r in got] == [("f", 1, "x", "does not match BSD syslog format"),
                                       ("f", 3, "y", "does not match BSD syslog format")]


HOSTILE = ["", "a+b", "%41%zz%", "%252e%252e", "%25252e", "%C3%A9", "%C3", "é%C3é%A9", "%e2%82x", "%00%ff%2B",
           "%f0%9f%98%80", "%ed%a0%80", "%ed%a0x", "%ed%9f%bf", "%e0%80%80", "%f0%80%80%80", "%f5%80", "%f4%90%80%80", "%f0%9f%98",
           "%c0%80", "%ed%bf", "100%", "%%41", "%2", "漢%E6%BC%A2"]


@pytest.mark.parametrize("passes", [0, 1, 2, 3])
def test_decode_variants(spark, passes):
    def model(value):
        forms = [value]
        for _ in range(passes):
            forms.append(unquote(forms[-1], errors="replace"))
        return list(dict.fromkeys(forms))

    frame = spark.createDataFrame([(v,) for v in HOSTILE], "v STRING")
    for r in frame.select("v", decode_variants(F.col("v"), passes).alias("d")).collect():
        assert r.d == model(r.v), r.v


def test_normal_path(spark):
    frame = spark.createDataFrame([("/",), ("//",), ("/a//",), ("/a",), ("",), (None,)], "p STRING")
    assert [r[0] for r in frame.select(F.expr(normal_path("p"))).collect()] == ["/", "/", "/a", "/a", "", None]


def test_white_space_follows_python(spark):
    gaps = ["\x1c", "\x85", "\xa0", " ", "　", "\t", "\x0b"]
    values = [f'1.1.1.1{g}-{g}-{g}[10/Oct/2023:13:55:36 +0000]{g}"GET{g}/{g}HTTP/1.1"{g}200{g}0' for g in gaps]
    rows = parse_lines(lines(spark, values + gaps)).orderBy("line_no").collect()
    assert [(r.kind, r.method, r.target, r.protocol) for r in rows[: len(gaps)]] == [("web", "GET", "/", "HTTP/1.1")] * len(gaps)
    assert [r.kind for r in rows[len(gaps):]] == ["blank" for g in gaps if re.fullmatch(r"\s", g)]


def test_a_line_that_holds_the_separator_parses(spark):
    odd = "\uffff\ufffe\ufffes\ufffee"
    web = f'9.9.9.9 - {odd} [01/Jan/2024:00:00:00 +0000] "GET /a{odd}?q=union+select HTTP/1.1" 200 5 "-" "agent {odd}"'
    got = parse_lines(lines(spark, [web, web + "x", odd])).collect()
    assert [r.kind for r in got] == ["web", "error", "error"]
    assert (got[0].source_ip, got[0].user, got[0].path, got[0].query, got[0].user_agent) == ("9.9.9.9", odd, f"/a{odd}", "q=union+select", f"agent {odd}")
    assert [r.raw for r in got] == [web, web + "x", odd]
    auth = f"Jan  1 00:00:00 host sshd[1]: Failed password for u{odd} from 9.9.9.9 port 22 ssh2"
    entry = parse_lines(lines(spark, [auth], fmt="auth"), default_year=2024).first()
    assert (entry.kind, entry.username, entry.source_ip) == ("auth", f"u{odd}", "9.9.9.9")


def test_an_attack_with_the_separator_is_found(spark):
    web = '9.9.9.9 - - [01/Jan/2024:00:00:00 +0000] "GET /?q=1+union+select+2\uffff HTTP/1.1" 200 5 "-" "Mozilla/5.0"'
    specs = [{"id": "sqli", "type": "signature", "params": {"patterns": ["union.select"]}}]
    found = analyze_lines(lines(spark, [web]), specs).findings.collect()
    assert [(r.rule_id, r.source_ip) for r in found] == [("sqli", "9.9.9.9")]
