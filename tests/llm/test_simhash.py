"""Fingerprints and their classes against all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from llm.edge import edge_docs, empty_docs, prose, rows, words_of
from logwarden.llm.common import join_spread
from logwarden.llm.op12_simhash import fingerprint, list_positions, near_fingerprints, open_links, simhash_classes, tally_links
from logwarden.llm.op2_jaccard import components


def plain_fingerprint(text: str | None) -> int:
    w = words_of(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(items: list, near) -> dict:
    label = {x: x for x in items}
    pairs = [(a, b) for a, b in combinations(items, 2) if near(a, b)]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def plain_classes(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    prints: dict[int, set] = {}
    for i, t in docs:
        prints.setdefault(i, set()).add(plain_fingerprint(t))
    near = lambda a, b: any((x ^ y).bit_count() <= 2 for x in prints[a] for y in prints[b])
    return classes(list(prints), near)


def test_any_pair_of_enough_shared_positions_has_a_list():
    lists = list_positions()
    assert len(lists) == 6 and all(len(set(x)) == 4 for x in lists)
    for differing in combinations(range(8), 2):
        assert any(not set(x) & set(differing) for x in lists)


def walk(rng: random.Random, start: int, n: int, step: int, within: int = 64) -> list[int]:
    out = [start]
    for _ in range(n):
        x = rng.choice(out)
        for _ in range(step):
            x ^= 1 << rng.randrange(within)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("longest", [2048, 20])  # 20: lists are refined
def test_links_join_what_all_pairs_join(spark, monkeypatch, longest):
    monkeypatch.setattr("logwarden.llm.op12_simhash.LIST", longest)
    rng = random.Random(8)
    numbers = walk(rng, 0, 150, 2) + walk(rng, rng.getrandbits(64), 150, 3) + walk(rng, rng.getrandbits(64), 200, 2, 16) + [rng.getrandbits(64) for _ in range(100)]
    numbers = sorted(set(numbers))
    signed = np.array(numbers, np.uint64).view(np.int64).tolist()
    want = classes(numbers, lambda a, b: (a ^ b).bit_count() <= 2)
    nodes = spark.createDataFrame([(x,) for x in signed], "node long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in near_fingerprints(nodes).collect()]
    assert all((a ^ b).bit_count() <= 2 or want[a] == want[b] for a, b in links)
    linked = classes(numbers, lambda a, b, have={frozenset(x) for x in links}: frozenset((a, b)) in have)
    assert linked == want


def test_lists_are_linked_by_tally_and_by_trial():
    rng = random.Random(2)
    nodes = np.array(walk(rng, 7 << 40, 900, 2, 16), np.uint64)
    want = classes(nodes.tolist(), lambda a, b: (a ^ b).bit_count() <= 2)
    for links in (tally_links(nodes, rows=100), open_links(nodes, (0, 1))):
        label = {x: x for x in nodes.tolist()}
        for a, b in links:
            label[b] = a
        assert label == want and len(links) < len(nodes)


def test_fingerprints_of_hard_rows(spark):
    long = prose(random.Random(3), 90_000)
    for text in [r[1] for r in rows()] + [long, "\x00 \x1c a\x0bb", "A a A a A a"]:
        assert fingerprint(text or "") == plain_fingerprint(text)
    docs = edge_docs(spark)
    got = simhash_classes(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fingerprint"]) for r in got if r["doc_id"] is not None) == sorted((False, r[0], f"{plain_fingerprint(r[1]):016x}") for r in rows() if r[0] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    want = plain_classes([(r[0], r[1]) for r in rows() if r[0] is not None])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert want[61] == 60 == want[69]  # texts without a word
    assert simhash_classes(empty_docs(spark)).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    rng = random.Random(5)
    a, b = prose(rng, 200), prose(rng, 200)
    made = [(5, a), (5, b), (9, b), (3, a), (12, "apart from all"), (12, "apart from all")]
    got = simhash_classes(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 3), (9, 3), (3, 3), (12, 12)} and len(got) == 6


def test_hot_keys_meet_like_others(spark):
    rows_ = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id) AS node", "id AS place")
    facts = rows_.groupBy("node").count().withColumnRenamed("count", "times").where("node <> 7").selectExpr("node", "times", "node * 2 AS double")
    got = {r["place"]: r["double"] for r in join_spread(rows_, facts, "node", "times", 5000, 10).collect()}
    assert got == {i: None if i == 7 else 0 if i % 3 == 0 else 2 * i for i in range(5000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
