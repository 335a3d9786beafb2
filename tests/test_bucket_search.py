"""Buckets of a running aggregate are found by halving."""

from pertscope.operators.ranks import _with_bucket


def test_buckets_are_found_by_halving(spark):
    rows = [(float(i % 53),) for i in range(300)] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "x double")
    for descending in (False, True):
        out = _with_bucket(df, "x", 16, "b", descending)
        assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
        told = sorted((x["x"], x["b"]) for x in out.collect() if x["x"] is not None and x["x"] == x["x"])
        buckets = [b for _, b in told]
        assert buckets == sorted(buckets, reverse=descending) and set(buckets) <= set(range(16)) and len(set(buckets)) > 8
        assert all(x["b"] == 0 for x in out.collect() if x["x"] is None)
