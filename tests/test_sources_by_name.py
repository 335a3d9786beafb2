import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pertscope.operators.clean import concat_matrices
from pertscope.operators.embed import batch_embed, ship_parameters
from pertscope.operators.knn import knn_graph
from pertscope.sources import io

import numpy as np


def test_prior_results_by_name(spark, tmp_path):
    (tmp_path / "prior.csv").write_text("compound,moa,conf\nc1,M1;M2,0.5\nc2,,x\n")
    schema = T.StructType([T.StructField("conf", T.DoubleType()), T.StructField("compound", T.StringType()),
                           T.StructField("moa", T.StringType())])
    rows = io.read_prior_results(spark, str(tmp_path / "prior.csv"), schema, ["moa"]).collect()
    assert rows[0]["conf"] == 0.5 and rows[0]["compound"] == "c1" and len(rows[0]["moa"]) == 2
    assert rows[1]["conf"] is None
    with pytest.raises(ValueError, match="wanted"):
        io.read_prior_results(spark, str(tmp_path / "prior.csv"),
                              T.StructType([T.StructField("wanted", T.StringType())]), [])
    with pytest.raises(ValueError, match="wanted"):
        io.read_metadata_tsv(spark, str(tmp_path / "prior.csv"), ["wanted"])


def test_only_finished_neighbours_are_kept(spark, tmp_path):
    path, df = str(tmp_path / "nb"), spark.range(3).select(F.col("id").alias("query_id"))
    (tmp_path / "nb").mkdir()
    (tmp_path / "nb" / "part-00000.parquet").write_text("left by a write that failed")
    io.write_neighbors(df, path)
    io.write_neighbors(df.limit(0), path)
    assert spark.read.parquet(path).count() == 3


def test_concat_matrices(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "sig_id long, expr array<double>")
    b = spark.createDataFrame([(3, [5.0, None, 7.0])], "sig_id long, expr array<double>")
    rows, genes = concat_matrices([(a, ["g2", "g1"]), (b, ["g3", "g2", "g0"])])
    assert genes == ["g0", "g1", "g2", "g3"]
    assert {r["sig_id"]: r["expr"] for r in rows.collect()} == {
        1: [None, 2.0, 1.0, None], 2: [None] * 4, 3: [7.0, None, None, 5.0]}
    with pytest.raises(ValueError):
        concat_matrices([(a, ["g1", "g1"])])


def test_euclidean_graph(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6)) * 1000
    x[7] = x[6] + 1e-5                                     # near rows keep their distance
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sig_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["ref_id"], r["distance"]) for r in knn_graph(df, 3, metric="euclidean").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(50):
        for r, j in enumerate(np.argsort(d[i], kind="stable")[:3], 1):
            assert got[i, r][0] == j and got[i, r][1] == pytest.approx(d[i, j], rel=1e-9)


def test_shipped_parameters(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "sig_id long, v array<double>").repartition(3)
    name = ship_parameters(spark, weights=np.array([[2.0], [0.5]]))
    out = batch_embed(df, "v", lambda x, held: x @ held["weights"], 1, batch_size=4, shipped=name)
    assert {r["sig_id"]: r["embedding"] for r in out.collect()} == {i: [2.0 * i + 0.5] for i in range(10)}
