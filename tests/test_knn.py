import numpy as np
import pytest

from pertscope.operators.knn import cosine_knn
from pertscope.operators.pairs import pairwise_cosine


def _brute(q, r, k, qg=None, rg=None):
    qn = q / np.where(np.linalg.norm(q, axis=1, keepdims=True) == 0, 1, np.linalg.norm(q, axis=1, keepdims=True))
    rn = r / np.where(np.linalg.norm(r, axis=1, keepdims=True) == 0, 1, np.linalg.norm(r, axis=1, keepdims=True))
    d = 1 - qn @ rn.T
    out = {}
    for i in range(len(q)):
        cand = [(d[i, j], j) for j in range(len(r)) if qg is None or qg[i] != rg[j]]
        out[i] = [j for _, j in sorted(cand)[:k]]
    return out


@pytest.mark.parametrize("exclude", [False, True])
def test_knn_matches_brute_force(spark, exclude):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(30, 6))
    r = rng.normal(size=(45, 6))
    r[3] = 0.0                                      # zero vector: distance 1
    qg = rng.integers(0, 5, 30)
    rg = rng.integers(0, 5, 45)
    qdf = spark.createDataFrame([(int(i), int(qg[i]), q[i].tolist()) for i in range(30)], "sig_id long, g long, embedding array<double>")
    rdf = spark.createDataFrame([(int(100 + j), int(rg[j]), r[j].tolist()) for j in range(45)], "sig_id long, g long, embedding array<double>")
    nb = cosine_knn(qdf, rdf, 7, group_col="g", exclude_same_group=exclude, query_block_rows=8,
                    ref_block_rows=10, checkpoint=False)
    got = {}
    for row in nb.orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.ref_id - 100)
        if exclude:
            assert row.query_group != row.ref_group
    want = _brute(q, r, 7, qg if exclude else None, rg if exclude else None)
    assert got == want


def test_knn_k_larger_than_reference(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "sig_id long, embedding array<double>")
    nb = cosine_knn(df, df, 10, checkpoint=False).collect()
    assert len(nb) == 4


def test_pairwise_upper_triangle_and_zero_vector(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 0, [1.0, 1.0]), (4, 1, [1.0, 2.0])],
                               "id long, seed int, v array<double>")
    rows = pairwise_cosine(df, "id", "v", by=["seed"]).collect()
    pairs = {(r.id_a, r.id_b): r.similarity for r in rows}
    assert set(pairs) == {(1, 2), (1, 3), (2, 3)}
    assert pairs[(1, 2)] is None and abs(pairs[(1, 3)] - 2 ** -0.5) < 1e-12


def test_knn_cuts_ties_by_id_inside_a_tile(spark):
    """Zero and duplicated vectors tie with everything: at most k rows leave a tile."""
    import pandas as pd

    from pertscope.operators.knn import _tile_topk
    left = pd.DataFrame({"qid": [1, 2], "v": [np.zeros(2), np.array([1.0, 0.0])]})
    right = pd.DataFrame({"rid": np.arange(500)[::-1], "v": [np.array([2.0, 0.0])] * 500})
    out = _tile_topk(5, False, False, False)(left, right)
    assert {q: sorted(g["ref_id"]) for q, g in out.groupby("query_id")} == {1: [0, 1, 2, 3, 4], 2: [0, 1, 2, 3, 4]}

    ids = [f"r{j:03d}" for j in range(40)]
    ref = spark.createDataFrame([(i, [1.0, 0.0]) for i in ids], "sig_id string, embedding array<double>")
    query = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 0.0])], "sig_id string, embedding array<double>")
    nb = cosine_knn(query, ref, 6, ref_block_rows=7, checkpoint=False).collect()
    for q in "ab":
        assert [r.ref_id for r in sorted(nb, key=lambda r: r.rank) if r.query_id == q] == ids[:6]
