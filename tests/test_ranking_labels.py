from pyspark.sql import functions as F

from pertscope.functions.labels import clean_label_set, shorten_label
from pertscope.operators import ranking as rk


def test_unique_hits_skip_null_and_repeats(spark):
    hits = spark.createDataFrame(
        [(1, "c", 1, "G1"), (1, "c", 2, None), (1, "c", 3, "G1"), (1, "c", 4, "G2"), (1, "c", 5, "G3")],
        "cp_sig long, compound string, rank int, gene string")
    got = [(r.gene, r.pos) for r in rk.topk_unique_per_row(hits, 2).orderBy("pos").collect()]
    assert got == [("G1", 1), ("G2", 2)]


def test_percentile_single_candidate_and_missing_modes(spark):
    cg = spark.createDataFrame([("a", "G1", 0.5), ("b", "G1", 0.9), ("b", "G2", 0.9), ("b", "G3", 0.1)],
                               "compound string, gene string, robustness double")
    r = rk.min_rank_percentile(cg)
    rows = {(x.compound, x.gene): x for x in r.collect()}
    assert rows[("a", "G1")].percentile == 100.0
    assert rows[("b", "G2")].rank1 == 1 and rows[("b", "G3")].percentile == 0.0
    tg = spark.createDataFrame([("b", "G9"), ("z", "G1")], "compound string, target string")
    nan = {x.compound: x for x in rk.target_rank_best(r, tg, missing="nan").collect()}
    worst = {x.compound: x for x in rk.target_rank_best(r, tg, missing="worst").collect()}
    assert nan["b"].rank1 is None and worst["b"].rank1 == 4 and worst["b"].percentile == 0.0
    assert worst["z"].n_candidates == 0 and worst["z"].rank1 is None


def test_clean_label_set(spark):
    df = spark.createDataFrame([(None,), ("nan",), ("['a', 'B']",), ("a|b;c",), (" x ; None ;X",)], "s string")
    got = [r.c for r in df.select(clean_label_set("s").alias("c")).collect()]
    assert got == [[], [], ["a", "b"], ["a", "b", "c"], ["x"]]


def test_shorten_label_order(spark):
    df = spark.createDataFrame([("Dopamine receptor  antagonist",)], "s string")
    # 'agonist' is replaced before 'antagonist' (fixed order), then spaces collapse
    assert df.select(shorten_label("s").alias("t")).collect()[0].t == "DA rec. antago."
