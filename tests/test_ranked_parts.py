"""Ranked lists dealt out by their size."""

import random

from pertscope.operators import ranking as rk
from pertscope.sources import fixtures as fx
from pertscope.sources.tables import Tables


def test_ranked_lists_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(o, rng.randint(1, 30), 1, n, float(rng.randint(1, 9)), "A") for o in range(60) for n in range(5)]
    tables = {"lineitem": (rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string"),
              "orders": ([(o, o % 7) for o in range(60)], "o_orderkey long, o_custkey long"),
              "part": ([(p, f"Brand#{p % 11}") for p in range(1, 31)], "p_partkey long, p_brand string")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    t = Tables(spark, str(tmp_path))
    want = sorted(map(str, rk.topk_unique_per_row(fx.ranked_hits(t)).collect()))
    monkeypatch.setattr(fx, "TASK_ROWS", 10)
    hits = fx.ranked_hits(t)
    pairs = rk.topk_unique_per_row(hits)
    assert hits.rdd.getNumPartitions() == pairs.rdd.getNumPartitions() == 30 == fx.task_parts(t.lineitem)
    assert sorted(map(str, pairs.collect())) == want


def test_parts_do_not_change_target_positions(spark):
    top = spark.createDataFrame([("C1", 1, "a"), ("C1", 2, "B"), ("c1", 1, "z"), ("c2", 1, "q"), (None, 1, "a")],
                                "compound string, rank int, gene string")
    targets = spark.createDataFrame([("c1", "b"), ("c1", "Z"), ("C2", "x"), ("c3", "q"), (None, "a")],
                                    "compound string, target string")
    got = [sorted(map(str, rk.best_target_position(top, targets, parts=n).collect())) for n in (None, 3)]
    assert got[0] == got[1]
