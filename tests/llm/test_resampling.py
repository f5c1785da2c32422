"""Importance resampling against a plain version that reads every text whole."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from llm.edge import edge_docs, empty_docs, prose, rows
from logwarden.llm.op13_resampling import crossing_features, line_features, pair_crcs, ranked, resample, word_crcs, _cut

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str | None) -> tuple[int, list[int]]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain(docs: list[tuple], target: list[str | None]) -> list[tuple]:
    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000) / ((s[b] + 1.0) * (all_t + 10000))))
    out = []
    for i, n, f in made:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(drawn[: 25 * len(drawn) // 100], 1):
        x[4] = rank
    return [tuple(x[:5]) for x in out]


def in_order(found) -> list[tuple]:
    return sorted((tuple(x) for x in found), key=lambda x: tuple((v is None, v or 0) for v in x))


def test_draws_equal_the_plain_version(spark):
    rng = random.Random(6)
    made = [(r[0], r[1]) for r in rows(n=120)]
    lines = [prose(rng, rng.randint(0, 9)) for _ in range(30)]
    made += [(1000 + i, "\n".join(rng.choice([*lines, "", "...", lines[0]]) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    made += [(2000, "w" * 200 + " " + "v" * 100 + "\n" + "u" * 99), (2001, "\n\n"), (2002, "É x É.　y \U0001f600"), (2003, made[3][1]), (2003, made[3][1])]
    target = [prose(rng, 40) for _ in range(10)] + [lines[0] + "\n" + lines[1], None, ""]
    docs = spark.createDataFrame([(*x, "k", 1, "r", 2) for x in made], "doc_id long, text string, line string, times long, digest string, row long").repartition(5)
    got = resample(docs, spark.createDataFrame([(x,) for x in target], "text string"))
    assert in_order(got.collect()) == in_order(plain(made, target))


def test_hard_rows_and_empty_tables(spark):
    made = [(r[0], r[1]) for r in rows()]
    bench = spark.createDataFrame([("the house of light",)], "text string")
    assert in_order(resample(edge_docs(spark), bench).collect()) == in_order(plain(made, ["the house of light"]))
    assert in_order(resample(edge_docs(spark), bench.limit(0)).collect()) == in_order(plain(made, []))
    assert resample(empty_docs(spark), bench).count() == 0


def test_hashes_of_lines_are_those_of_their_words():
    rng = random.Random(3)
    texts = [("".join(rng.choice("ab é.,-Z9") for _ in range(rng.randint(0, 300))) + "x" * rng.choice([0, 47, 48, 49, 300])).lower().encode() for _ in range(200)]
    for text, (n, found) in zip(texts, line_features(texts)):
        assert (n, found.tolist()) == features(text.decode())
    data, starts, ends, _ = _cut(texts)
    crcs = word_crcs(data, starts, ends)
    assert crcs.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    left, right = np.arange(len(crcs) - 1), np.arange(1, len(crcs))
    assert pair_crcs(data, crcs, starts, ends, left, right)[:50].tolist() == [zlib.crc32(data[starts[a] : ends[a]].tobytes() + b" " + data[starts[b] : ends[b]].tobytes()) for a, b in zip(left[:50], right[:50])]


def test_lines_and_crossing_pairs_make_up_a_text():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", "é", " ", ".", "\n", "\r", "\n\n"]) for _ in range(rng.randint(0, 60)))
        lines, crossing = crossing_features(text.encode())
        found = Counter(crossing)
        for _, own in line_features(lines) if lines else []:
            found.update(own.tolist())
        assert found == Counter(features(text)[1])


def test_ranks_of_ties_and_repeated_rows(spark):
    made = [(i % 7, None if i % 11 == 0 else i % 50, i) for i in range(3000)]
    got = ranked(spark.createDataFrame(made, "score long, doc_id long, row long").repartition(9)).collect()
    want = sorted(made, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
    assert [(r["score"], r["doc_id"], r["row"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))
