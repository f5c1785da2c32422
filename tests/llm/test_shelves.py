"""Queries of op1_topk move once for each shelf of annuli, and shelves, packets and products are bounded by bytes."""

import numpy as np
import pytest

from llm.test_models_and_pipeline import plain_best, vectors_table
from logwarden.llm import op1_topk
from logwarden.llm.op1_topk import PivotIndex, best_of_shelf, integer_vectors


def test_what_moves_follows_queries_and_shelves_and_not_annuli(spark, monkeypatch):
    data, table = vectors_table(spark)
    probes = []

    def counted(df, name, kept=op1_topk.written_once):
        out = kept(df, name)
        probes.extend([out.count()] if name == "probes" else [])
        return out

    monkeypatch.setattr(op1_topk, "written_once", counted)
    monkeypatch.setattr(op1_topk, "ROUNDS", (2, 5))
    vectors = integer_vectors(table).distinct()
    index = PivotIndex(vectors, pivots=16, annuli=6)
    queries = vectors.where("vec_id % 50 = 0")
    assert sorted(tuple(r) for r in index.search(queries).collect()) == plain_best(data)
    assert len(index.shelves) <= 2 and len(index.directory) > 30
    assert len(probes) == 3 and max(probes) <= len(index.shelves) * queries.count()


def test_small_shelves_packets_and_products_give_the_same_rows(spark, monkeypatch):
    data, table = vectors_table(spark, 400)
    for name, value in (("SHELF_BYTES", 600), ("PACKET_BYTES", 100), ("PROBE_BYTES", 3000), ("CELLS", 50), ("ROUNDS", (1, 3))):
        monkeypatch.setattr(op1_topk, name, value)
    vectors = integer_vectors(table).distinct()
    index = PivotIndex(vectors, pivots=3, annuli=2)
    # annuli of more vectors than a shelf holds are several shelves
    assert len(index.shelves) > len(index.directory)
    assert sorted(tuple(r) for r in index.search(vectors.where("vec_id % 50 = 0")).collect()) == plain_best(data)


@pytest.mark.parametrize("scale", [10, 2**20, 2**28])  # products in single, double and 64-bit precision
def test_the_best_of_a_shelf(scale):
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (60, 2)) * scale + rng.integers(0, 2, (60, 2))
    q = rng.integers(-3, 4, (9, 2)) * scale
    ids, query_ids = rng.permutation(60), np.array([0, 1, 2, 3, 3, 70, 71, 72, 73])
    annuli, needed = np.sort(rng.integers(0, 3, 60)), rng.random((9, 3)) < 0.7
    least = np.where(np.arange(9) % 2, -(2**63), scale * scale)
    row, near, score = best_of_shelf(query_ids, q, least, needed, ids, x, annuli, 4)
    want = []
    for i in range(9):
        found = sorted((-int(q[i] @ x[j]), int(ids[j])) for j in range(60) if needed[i, annuli[j]] and ids[j] != query_ids[i] and q[i] @ x[j] >= least[i])
        want += [(i, n, -s) for s, n in found[:4]]
    assert list(zip(row.tolist(), near.tolist(), score.tolist())) == want
