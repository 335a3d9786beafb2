from pertscope.operators.propagation import propagate_labels


def _run(spark, nb_rows, **kw):
    nb = spark.createDataFrame(nb_rows, "query_id long, rank int, ref_id long, distance double, ref_group long")
    samples = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "query_id long, query_group long")
    labels = spark.createDataFrame([(100, "A"), (101, "B"), (102, "A"), (102, "C"), (103, "D")],
                                   "group long, label string")
    return propagate_labels(samples, nb, labels, **kw)


NB = [
    # query 1: four labelled compounds, closest sample per compound counts
    (1, 1, 1, 0.10, 100), (1, 2, 2, 0.20, 101), (1, 3, 3, 0.30, 102), (1, 4, 4, 0.05, 100), (1, 5, 5, 0.40, 999),
    (1, 6, 6, 0.50, 103),
    # query 2: only two distinct labelled compounds -> abstains
    (2, 1, 1, 0.10, 100), (2, 2, 2, 0.20, 101),
    # query 3: all neighbours unlabelled
    (3, 1, 7, 0.10, 999),
]


def test_probabilities_sum_to_one_or_absent(spark):
    p = _run(spark, NB)
    sums = {r.query_id: r.s for r in p.sample_probs.groupBy("query_id").agg({"p": "sum"}).withColumnRenamed("sum(p)", "s").collect()}
    assert set(sums) == {1}
    assert abs(sums[1] - 1) < 1e-9


def test_abstention_and_counts(spark):
    st = {r.query_id: r for r in _run(spark, NB).sample_top.collect()}
    assert st[2].top_moa is None and st[2].top_conf == 0.0 and st[2].n_unique_ref_compounds == 2
    assert st[3].top_moa is None and st[3].n_unique_ref_compounds == 0
    assert st[1].n_unique_ref_compounds == 4
    # compound 102 carries A and C: half of its weight to each
    assert st[1].top_moa == "A"


def test_compound_means_include_abstainers(spark):
    p = _run(spark, NB, weighting="uniform")
    ct = {r.query_group: r for r in p.compound_top.collect()}
    # group 10: query 1 (A: 1/4 + 1/8) and abstaining query 2 -> mean over 2 samples
    assert abs(ct[10].top_conf - (0.25 + 0.125) / 2) < 1e-6
    assert ct[10].n_samples == 2 and ct[10].n_abstained == 1
    assert ct[10].agreement == 1.0
    assert ct[20].top_moa is None


def test_ties_joined_in_label_order(spark):
    nb = [(1, 1, 1, 0.1, 100), (1, 2, 2, 0.1, 101), (1, 3, 3, 0.1, 103)]
    st = {r.query_id: r for r in _run(spark, nb, weighting="uniform").sample_top.collect()}
    assert st[1].top_moa == "A;B;D"
