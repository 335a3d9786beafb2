"""Results must not depend on the number of shuffle partitions."""

import numpy as np

from pertscope.operators.enrichment import bh_adjust
from pertscope.operators.knn import cosine_knn
from pertscope.operators.propagation import propagate_labels


def _run(spark):
    rng = np.random.default_rng(5)
    n = 60
    vec = rng.normal(size=(n, 5))
    grp = [i // 4 for i in range(n)]
    prof = spark.createDataFrame([(i, grp[i], vec[i].tolist()) for i in range(n)],
                                 "sig_id long, pert_id long, embedding array<double>")
    labels = spark.createDataFrame([(g, f"L{g % 3}") for g in range(0, 15) if g % 5 != 0] + [(3, "L9")],
                                   "group long, label string")
    ann = prof.filter("pert_id % 5 <> 0")
    nb = cosine_knn(prof, ann, 12, group_col="pert_id", exclude_same_group=True, checkpoint=False)
    samples = prof.selectExpr("sig_id AS query_id", "pert_id AS query_group")
    ct = propagate_labels(samples, nb, labels, k_raw=12).compound_top
    ct_rows = sorted((r.query_group, r.top_moa, round(r.top_conf, 9), round(r.agreement, 9)) for r in ct.collect())
    ps = spark.createDataFrame([(i, float(p)) for i, p in enumerate(rng.random(40) ** 3)], "id long, p double")
    bh = sorted((r.id, round(r.q, 12)) for r in bh_adjust(ps, "p", "q").collect())
    return ct_rows, bh


def test_partition_count_invariance(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = _run(spark)
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = _run(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
