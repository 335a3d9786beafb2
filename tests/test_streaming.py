import os
import tempfile

from pyspark.sql import functions as F

from pertscope.streaming.scoring import start_scoring


def test_stream_scores_each_batch(spark):
    d = tempfile.mkdtemp(prefix="pertscope-stream-")
    src, sink, ckpt = (os.path.join(d, x) for x in ("src", "sink", "ckpt"))
    schema = "sig_id long, pert_id long, embedding array<double>"
    ref = spark.createDataFrame([(100 + i, i % 4, [1.0, i / 10.0]) for i in range(12)], schema)
    labels = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A"), (3, "C")], "group long, label string")
    spark.createDataFrame([(1, 50, [1.0, 0.05]), (2, 50, [1.0, 0.9])], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    query = start_scoring(stream, ref, labels, sink, ckpt, k_raw=5, available_now=True)
    query.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == 2
    assert out.filter(F.col("top_moa").isNotNull()).count() == 2
