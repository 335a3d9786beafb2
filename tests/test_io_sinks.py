"""Round trips of the sinks (S6-S9) and workers started in another folder."""
import os
import subprocess
import sys

from pertscope.sources import io

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_csv_round_trip_with_label_lists(spark, tmp_path):
    from pyspark.sql import types as T
    path = str(tmp_path / "results")
    rows = [("a", 1.5, ["x", "y"]), ("b", None, ["z"])]
    io.write_csv(spark.createDataFrame(rows, "k string, v double, labels array<string>"), path)
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType()),
                           T.StructField("labels", T.StringType())])
    plain = spark.read.schema(schema).option("header", True).csv(path)
    assert sorted(tuple(r) for r in plain.collect()) == [("a", 1.5, "x;y"), ("b", None, "z")]
    back = io.read_prior_results(spark, path, schema, ["labels"])
    assert dict(back.dtypes)["labels"] == "array<string>" and back.count() == 2


def test_prior_results_parse_encoded_lists(spark, tmp_path):
    from pyspark.sql import types as T
    (tmp_path / "r.csv").write_text('k,labels\na,"[\'x\', \'y\']"\n')
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("labels", T.StringType())])
    got = io.read_prior_results(spark, str(tmp_path / "r.csv"), schema, ["labels"]).collect()
    assert [sorted(r.labels) for r in got] == [["x", "y"]]


def test_roc_is_partitioned_and_read_back(spark, tmp_path):
    path = str(tmp_path / "roc")
    rows = [("run", "raw", 0.0, 0.1), ("run", "embedding", 0.5, 0.9)]
    io.write_roc(spark.createDataFrame(rows, "label string, space string, fpr double, tpr double"), path)
    assert os.path.isdir(os.path.join(path, "label=run", "space=raw"))
    back = spark.read.parquet(path).select("label", "space", "fpr", "tpr")
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_neighbours_by_block(spark, tmp_path):
    path = str(tmp_path / "nn")
    io.write_neighbors(spark.createDataFrame([(1, 2, 0.1, 0), (3, 4, 0.2, 1)],
                                             "query_id long, ref_id long, distance double, block int"), path, "block")
    assert sorted(x for x in os.listdir(path) if x.startswith("block=")) == ["block=0", "block=1"]


def test_queries_run_from_another_folder(tmp_path):
    """The driver knows the repository only by a path of its own process."""
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__
print("rows", __spark_entry__.queries()["cosine_knn"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-2000:]
    assert int(run.stdout.split("rows")[1]) > 0
