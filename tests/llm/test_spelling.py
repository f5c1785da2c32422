"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from llm.edge import edge_docs, empty_docs, rows
from logwarden.llm.op11_spelling import Block, count_words, near_pairs, spelling_variants


def plain_words(docs, every: int | None = 97, least: int = 3) -> Counter:
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return Counter({w: n for w, n in total.items() if n >= least})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words: Counter) -> dict:
    near = {w: sorted((-n, v) for v, n in words.items() if one_edit(w, v)) for w in words}
    form = {w: x[0][1] if x and -x[0][0] >= 2 * words[w] else None for w, x in near.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def told(df) -> dict:
    got = df.collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def some_words(seed: int, n: int) -> Counter:
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 12))) for _ in range(n)]
    for w in list(base):
        for _ in range(3):
            at = rng.randrange(len(w))
            base.append(rng.choice([w[:at] + "c" + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + w[at] + w[at:], w + "ÿ"]))
    return Counter({w: rng.choice([3, 3, 4, 8, 20, 90]) for w in base if len(w) >= 5} | {"x" * 900: 3, "x" * 901: 9, "x" * 450 + "y" + "x" * 450: 40})


@pytest.mark.parametrize(("block", "shared"), [(1024, 128), (16, 2)])  # 16: groups of many block pairs
def test_variants_equal_all_pairs(spark, monkeypatch, block, shared):
    monkeypatch.setattr("logwarden.llm.op11_spelling.BLOCK", block)
    monkeypatch.setattr("logwarden.llm.op11_spelling.SHARED_ROWS", shared)
    words = some_words(3, 150)
    assert told(spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain_variants(words)


def test_a_tile_finds_each_pair_in_one_part():
    rng = random.Random(1)
    for lg in (5, 6, 7, 11):
        words = list({"".join(rng.choice("ab") for _ in range(lg - rng.randint(0, 1))) for _ in range(60)})
        block = Block([w.encode() for w in words], lg)
        import numpy as np

        found = sum(near_pairs(block, block, lg, np.full(len(words), p)).astype(int) for p in range(3))
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                assert found[i, j] == (one_edit(a, b) and max(len(a), len(b)) == lg), (a, b)


def test_words_of_hard_rows(spark):
    made = [(r[0], r[1]) for r in rows()] + [(None, "Größe größe GRÖßE Naïveİ ab×cd÷ef straßen" * 3), (7, "Z" * 2_000_000 + " zz")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in made], "doc_id long, text string, word string")
    for every in (97, 3, None):
        got = {r["word"]: r["n"] for r in count_words(docs, drop_every=every, min_count=1).collect()}
        assert got == plain_words(made, every, 1)
    got = told(spelling_variants(count_words(edge_docs(spark), drop_every=97)))
    assert got == plain_variants(plain_words([(r[0], r[1]) for r in rows()]))
    assert spelling_variants(count_words(empty_docs(spark), drop_every=97)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    words = Counter({"stone": 200, "stona": 100, "stina": 50, "spina": 25, "spine": 12, "apine": 6, "apines": 3})
    got = told(spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_variants(words) and got["apines"][1] == "stone"
