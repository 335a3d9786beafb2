import numpy as np
import pytest

from pertscope.operators import cells
from pertscope.operators.cells import Cells, approx_knn, compared_pairs, fit_cells
from pertscope.operators.knn import cosine_knn


def _vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)],
                                 "sig_id long, embedding array<double>")


def _clustered(rng, n, centres, noise=0.25):
    return centres[rng.integers(0, len(centres), n)] + noise * rng.normal(size=(n, centres.shape[1]))


def _recall(q, r, got, k):
    exact = {(x.query_id, x.ref_id): x.distance for x in cosine_knn(q, r, k, checkpoint=False).collect()}
    hits = [x for x in got if (x.query_id, x.ref_id) in exact]
    assert all(abs(x.distance - exact[x.query_id, x.ref_id]) < 1e-9 for x in hits)
    return len(hits) / len(exact)


def test_clustered_vectors_meet_in_few_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    q, r = _vectors(spark, _clustered(rng, 200, centres)), _vectors(spark, _clustered(rng, 3000, centres), 10000)
    index = fit_cells(r, 10)
    got = approx_knn(q, r, 10, index=index).collect()
    assert sorted((x.query_id, x.rank) for x in got) == [(i, k) for i in range(200) for k in range(1, 11)]
    assert _recall(q, r, got, 10) >= 0.9
    met = compared_pairs(q, r, index).first()
    assert met["pairs"] == 200 * 3000 and met["share"] <= 0.25
    assert met["share"] == met["compared"] / met["pairs"]


def test_vectors_without_structure_keep_their_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    x[5] = 0.0
    q, r = _vectors(spark, rng.normal(size=(60, 64))), _vectors(spark, x, 1000)
    assert _recall(q, r, approx_knn(q, r, 10).collect(), 10) >= 0.9


@pytest.mark.parametrize("cell_rows, query_rows", [(7, 3), (10000, 10000)])
def test_hot_cells_are_dealt_out_without_loss(spark, cell_rows, query_rows):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.tile(rng.normal(size=8), (60, 1)) + 1e-3 * rng.normal(size=(60, 8)), rng.normal(size=(30, 8))])
    q, r = _vectors(spark, x[::3]), _vectors(spark, x, 1000)
    index = Cells(np.eye(8)[:4], 4)                    # every cell is visited: the search is exact
    got = approx_knn(q, r, 5, index=index, cell_rows=cell_rows, query_rows=query_rows).collect()
    exact = cosine_knn(q, r, 5, checkpoint=False).collect()
    assert sorted((x.query_id, x.rank, x.ref_id) for x in got) == sorted((x.query_id, x.rank, x.ref_id) for x in exact)
    assert compared_pairs(q, r, index).first()["share"] == 1.0


def test_fewer_references_than_k_and_null_vectors(spark):
    rng = np.random.default_rng(5)
    q, r = _vectors(spark, rng.normal(size=(4, 8))), _vectors(spark, rng.normal(size=(3, 8)))
    gone = spark.createDataFrame([(77, None)], q.schema)
    got = approx_knn(q.unionByName(gone), r.unionByName(gone), 10).collect()
    assert sorted((x.query_id, x.rank) for x in got) == [(i, k) for i in range(4) for k in (1, 2, 3)]
    assert approx_knn(q, r.limit(0), 10).collect() == [] and approx_knn(q.limit(0), r, 10).collect() == []


def test_copies_for_many_cells_leave_a_few_at_a_time(monkeypatch):
    import pandas as pd
    from pyspark.sql import types as T

    class Table:
        schema = T.StructType([T.StructField("qid", T.LongType())])

        def mapInPandas(self, run, schema):
            return run

    monkeypatch.setattr(cells, "COPIES", 12, raising=False)
    x = np.random.default_rng(1).normal(size=(20, 4))
    run = cells._in_cells(Table(), Cells(x[:6] / np.linalg.norm(x[:6], axis=1)[:, None], 5), 5)
    parts = list(run(iter([pd.DataFrame({"qid": range(20), "v": list(x)})])))
    assert max(map(len, parts)) <= 12
    rows = pd.concat(parts)
    assert rows["qid"].tolist() == [i for i in range(20) for _ in range(5)]
    assert (rows.groupby("qid")["cell"].nunique() == 5).all()
