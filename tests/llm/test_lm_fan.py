"""What the shards of the language model send to each other, and its sorted look-ups."""

import numpy as np
import pytest

from llm.edge import edge_docs
from logwarden.llm import op10_lm
from logwarden.llm.common import fold
from logwarden.llm.op10_lm import HashTable, distinct, fit_lm, score_lm


def test_shards_follow_the_texts_and_not_the_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert fit_lm(edge_docs(spark), fold("doc_id", 7) != 2).shards == 32
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("fan", [3, 5])
def test_packets_of_a_shard_are_bounded_and_give_the_same_scores(spark, monkeypatch, fan):
    docs = edge_docs(spark)
    want = {tuple(r) for r in score_lm(docs, fit_lm(docs, fold("doc_id", 7) != 2)).collect()}
    monkeypatch.setattr(op10_lm, "SHARD_BYTES", 500)
    sent = {}

    def counted(df, name, kept=op10_lm.written_once):
        written = kept(df, name)
        sent[name] = max(sent.get(name, 0), written.count())
        return written

    monkeypatch.setattr(op10_lm, "written_once", counted)
    totals = fit_lm(docs, fold("doc_id", 7) != 2, rounds=1, fan=fan)
    assert totals.shards >= 32 and totals.word_shards > fan
    assert sent["lm-sums"] <= totals.shards * (2 * fan + 1)
    assert {tuple(r) for r in score_lm(docs, totals).collect()} == want


def test_distinct_gives_a_place_of_each():
    keys = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    at, times, which = distinct(keys)
    values, counts = np.unique(keys, return_counts=True)
    assert (keys[at] == values).all() and (times == counts).all() and (values[which] == keys).all()
    assert [len(x) for x in distinct(keys[:0])] == [0, 0, 0]


def test_hashes_that_differ_in_their_last_byte_are_told_apart():
    step = np.uint64(1) << np.uint64(16)
    keys = np.uint64(7 << 56) + np.arange(200, dtype=np.uint64) * step
    found = HashTable(np.frombuffer(HashTable.bytes_of(keys, np.arange(1, 201)[:, None]), np.uint8))
    assert found.find(keys)[:, 0].tolist() == list(range(1, 201))
    assert not found.find(keys + np.uint64(200) * step).any()
