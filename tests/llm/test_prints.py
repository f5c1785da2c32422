"""Whole sets of op2_jaccard are made for pairs that their prints leave possible, and for all of these."""

import random

import numpy as np
import pytest

from logwarden.llm import op2_jaccard
from logwarden.llm.op2_jaccard import near_duplicates, parity_print, possible_pairs


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_no_similar_pair_is_left_out(percent):
    rng = np.random.default_rng(percent)
    similar = possible = pairs = 0
    for _ in range(150):
        base = rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)
        sets = [np.unique(np.append(base[rng.random(len(base)) > 0.3 * rng.random() ** 4], rng.integers(0, 2**63, int((3 + len(base) // 8) * rng.random() ** 4), dtype=np.uint64))) for _ in range(5)]
        sets += [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (63, 64, 65, 129)]
        sizes = np.array([len(s) for s in sets])
        got = possible_pairs(sizes, [parity_print(s) for s in sets], percent)
        common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        want = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(want, False)
        assert (got == got.T).all() and not (want & ~got).any()
        similar, possible, pairs = similar + want.sum(), possible + got.sum(), pairs + len(sets) * (len(sets) - 1)
    assert 0 < similar <= possible < 0.7 * pairs


@pytest.mark.parametrize("block", [400, 3])  # clusters of one block, and of several
def test_texts_that_share_some_shingles_do_not_move(spark, monkeypatch, block):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    # five texts of each group share what is rare in them, a quarter of their words: candidates, but not similar enough; the rest is in more texts
    common = [words(110) for _ in range(5)]
    texts = [" ".join(rare + rest) for rare in [words(40) for _ in range(8)] for rest in common]
    same = words(100)
    texts += [" ".join(same), " ".join([*same, "more"])]
    blocks, prints = [], []

    def watched(df, name, kept=op2_jaccard.written_once):
        out = kept(df, name)
        if name in ("blocks", "prints"):
            (blocks if name == "blocks" else prints).append(out.select("rep").distinct().count())
        return out

    monkeypatch.setattr(op2_jaccard, "written_once", watched)
    monkeypatch.setattr(op2_jaccard, "BLOCK", block)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    last = len(texts) - 2
    assert got == {i: min(i, last) for i in range(len(texts))}
    assert prints[0] == len(texts) and blocks[0] == 2 and sum(blocks) == 2
