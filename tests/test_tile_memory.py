"""What a task of the tiled joins holds at a time."""

import numpy as np
import pandas as pd

from pertscope.operators import cross_reduce as cr
from pertscope.operators import knn


def test_a_tile_holds_few_distances_at_a_time():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(16384, 3))
    held = []

    def tile(left, right):
        distances = knn._cosine_tile(left, right)

        def some(rows):
            out = distances(rows)
            held.append(out.size)
            return out
        return some

    left = pd.DataFrame({"qid": np.arange(300), "v": list(x[:300])})
    right = pd.DataFrame({"rid": np.arange(16384), "v": list(x)})
    got = knn._tile_topk(4, False, True, False, tile)(left, right)
    assert max(held) <= 1 << 21 and sum(held) == 300 * 16384
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    d = 1 - unit[:300] @ unit.T
    d[np.arange(300), np.arange(300)] = np.inf
    want = {(q, r) for q in range(300) for r in np.argsort(d[q], kind="stable")[:4]}
    assert set(zip(got["query_id"], got["ref_id"])) == want


def test_pairs_leave_in_small_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, f"L{i % 7}", [float(v) for v in rng.normal(size=2)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, label string, v array<double>")
    seen = []
    met = cr._met

    def watched(q, r, n_q, n_r, fn, schema):
        tiles = q.groupBy("qb").count().agg({"count": "max"}).first()[0]
        seen.append(tiles)
        return met(q, r, n_q, n_r, fn, schema)

    monkeypatch.setattr(cr, "_met", watched)
    out = cr.cross_distances(df, df, "id", "v", "label", "label")
    assert out.count() == out.select("id_a", "id_b").distinct().count() == 1500 * 1500
    assert seen[0] <= 1024


def test_nearest_cells_are_those_of_a_full_sort():
    rng = np.random.default_rng(6)
    for n, k in ((400, 3), (403, 3), (90, 3), (20, 30), (640, 5)):
        dist = rng.integers(0, 40, size=(50, n)).astype(float)
        dist[0], dist[1, : n - 2], dist[2, 5], dist[3, ::2] = np.inf, np.inf, -np.inf, np.nan
        dist[4] = 7.0
        row, col = knn._nearest(dist, k)
        for i in range(50):
            order = np.lexsort((np.arange(n), dist[i]))[:k]
            want = {j for j in order if np.isfinite(dist[i, j])}
            if np.isnan(dist[i]).sum() <= n - k:
                assert set(col[row == i]) == want, (n, k, i)


def test_few_cells_are_sorted(monkeypatch):
    """A row's k nearest are found without a partition of the whole row."""
    widths = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **kw: (widths.append(x.shape[1]), partition(x, *a, **kw))[1])
    knn._nearest(np.random.default_rng(7).normal(size=(4, 16384)), 15)
    assert max(widths) < 200


def test_repeated_tokens_are_hashed_once(spark):
    from pertscope.operators.pairs import fold_fingerprint
    df = spark.createDataFrame([(1, ["a", "b", "a", None, "", "a"]), (2, []), (3, None)], "id long, t array<string>")
    out = df.select("id", fold_fingerprint("t").alias("bits"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 2
    bits = {r["id"]: r["bits"] for r in out.collect()}
    assert len([b for b in bits[1] if b is not None]) == 3 and bits[2] == [] and bits[3] is None
