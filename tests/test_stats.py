import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertscope.functions.mathx import log_factorial
from pertscope.operators.enrichment import upper_tails
from pertscope.operators import stats
from pertscope.operators.enrichment import bh_adjust


def test_bh_matches_step_up_with_ties(spark):
    ps = [0.01, 0.04, 0.04, 0.03, 0.5, 0.2, 0.2, 0.9, 0.001, 0.04]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "id long, p double")
    got = {r.id: r.adj for r in bh_adjust(df, "p", "adj").collect()}
    m = len(ps)
    order = np.argsort(ps, kind="stable")
    raw = np.array(ps)[order] * m / np.arange(1, m + 1)
    adj = np.minimum.accumulate(raw[::-1])[::-1].clip(max=1)
    want = {int(order[i]): adj[i] for i in range(m)}
    for i in range(m):
        assert abs(got[i] - want[i]) < 1e-12


def test_auroc_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    s = rng.integers(0, 6, 200) / 5.0
    y = rng.random(200) < 0.4
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "score double, label boolean")
    got = stats.roc_auc(df, "score", "label").collect()[0].auroc
    pos, neg = s[y], s[~y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(got - want) < 1e-12


def test_auroc_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, True), (0.2, True)], "score double, label boolean")
    assert stats.roc_auc(df, "score", "label").collect()[0].auroc is None


def test_mann_whitney_u(spark):
    a = [1.0, 2.0, 2.0, 5.0]
    b = [0.5, 2.0, 3.0]
    df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b], "x double, g boolean")
    r = stats.mann_whitney_greater(df, "x", "g").collect()[0]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert abs(r.u - u) < 1e-12 and 0 < r.p_value < 1


def test_threshold_edges(spark):
    df = spark.createDataFrame([(0.15,), (0.1500000001,), (1.0,), (0.0,)], "m double")
    got = [r.b for r in df.select(stats.threshold_bin(F.col("m")).alias("b")).collect()]
    # 0.15 < 3 * 0.05 in doubles, so it sits in bin 2 like the reference's edges
    assert got == [2, 3, 20, 0]


def test_spearman_against_numpy(spark):
    x = [1, 2, 2, 4, 7, 3]
    y = [2, 1, 4, 4, 9, 0]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = stats.spearman(df, "x", "y").collect()[0]

    def avg_rank(v):
        v = np.array(v, dtype=float)
        return np.array([np.mean(np.where(np.sort(v) == t)[0] + 1) for t in v])
    want = np.corrcoef(avg_rank(x), avg_rank(y))[0, 1]
    assert abs(r.rho - want) < 1e-12 and 0 <= r.p_value <= 1


def test_hypergeom_tails_exact(spark):
    total = 2000
    cases = [(1, 20, 5), (3, 150, 40), (4, 150, 40), (2, 10, 12), (0, 10, 12), (900, 1500, 1400), (910, 1500, 1400),
             (10, 10, 1999), (5, 5, 5), (0, 7, 0)]
    df = spark.createDataFrame(cases + cases[:2], "k long, n_genes long, n long")
    got = {(r.k, r.n_genes, r.n): r.p for r in upper_tails(df, F.lit(total)).collect()}
    assert len(got) == len(cases)
    for k, size, n in cases:
        want = sum(Fraction(math.comb(size, i) * math.comb(total - size, n - i), math.comb(total, n))
                   for i in range(max(k, 0), min(size, n) + 1))
        assert got[k, size, n] == pytest.approx(float(want), rel=1e-9, abs=1e-300)


def test_log_factorial():
    m = np.arange(300)
    assert np.allclose(log_factorial(m), [math.lgamma(x + 1) for x in m], rtol=1e-12, atol=1e-12)


def test_range_histogram(spark):
    values = [0.5, 0.5, 3.0, 7.25, 10.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = sorted(stats.range_histogram(df, "x", 37).collect())
    counts, edges = np.histogram([v for v in values if v is not None], bins=37)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["left"] for r in rows] == pytest.approx(edges[:-1].tolist())
    alone = stats.range_histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 5).collect()
    assert sorted(r["count"] for r in alone) == [0, 0, 0, 0, 2]


def test_thresholds_by_group_equal_each_group_alone(spark):
    rows = [("a", 0.95, True), ("a", 0.4, False), ("a", None, True), ("b", 0.05, True), ("b", 0.0, False),
            ("b", -0.2, True), (None, 1.3, True), ("c", None, True), ("d", -0.5, True)]
    df = spark.createDataFrame(rows, "g string, m double, t boolean")
    got = {}
    for r in stats.accuracy_above_threshold(df, "m", "t", by=["g"]).collect():
        got.setdefault(r["g"], set()).add(tuple(r)[1:])
    assert set(got) == {"a", "b", "d", None}      # a group without a measure has no table
    for g in got:
        alone = stats.accuracy_above_threshold(df.filter(df["g"].eqNullSafe(g)), "m", "t")
        assert got[g] == {tuple(r) for r in alone.collect()}


def test_threshold_correlation(spark):
    rows = ([("up", k / 20, float(k)) for k in range(21)] + [("down", k / 20, float(-k)) for k in range(5)]
            + [("flat", k / 20, 3.0) for k in range(5)] + [("one", 0.0, 1.0), ("none", 0.0, None)]
            + [("tied", 0.0, 1.0), ("tied", 0.1, 1.0), ("tied", 0.2, 5.0), ("tied", 0.3, None)])
    df = spark.createDataFrame(rows, "g string, threshold double, pct_true double")
    got = {r["g"]: (r["n"], r["rho"]) for r in stats.threshold_correlation(df, ["g"]).collect()}
    assert got.pop("tied") == (3, pytest.approx(3 ** 0.5 / 2))      # ranks 1.5, 1.5, 3 against 1, 2, 3
    assert got == {"up": (21, 1.0), "down": (5, -1.0), "flat": (5, None), "one": (1, None)}


def test_metrics_by_split_equal_each_split_alone(spark):
    rows = [("train", "a", "a"), ("train", "a", "b"), ("train", "b", "c"), ("valid", "a", "a"), ("valid", "c", "a")]
    df = spark.createDataFrame(rows, "split string, truth string, pred string")
    for r in stats.classification_metrics(df, "truth", "pred", ["split"]).collect():
        alone = stats.classification_metrics(df.filter(df["split"] == r["split"]), "truth", "pred").first()
        assert tuple(r)[1:] == pytest.approx(tuple(alone))
