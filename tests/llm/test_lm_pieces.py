"""Texts are scored in pieces whose bytes are bounded."""

import pyarrow as pa

from logwarden.llm.op10_lm import SCORE_BYTES, scored_together


def test_pieces_follow_the_bytes_and_keep_every_row():
    texts = ["a" * n for n in [5, 0, 9, 10, 30, 1, 0, 0, 4]]
    column = pa.array(texts)
    pieces = list(scored_together(column, 10))
    assert [row for lo, n in pieces for row in range(lo, lo + n)] == list(range(len(texts)))
    for lo, n in pieces:
        assert n == 1 or sum(map(len, texts[lo : lo + n])) <= 10
    assert list(scored_together(column.slice(3, 2), 10)) == [(0, 1), (1, 1)]
    assert list(scored_together(pa.array([], pa.string()))) == []


def test_long_texts_are_not_scored_by_thousands():
    column = pa.array(["word " * 20_000] * 200)
    assert max(n for _, n in scored_together(column)) <= SCORE_BYTES // 100_000
