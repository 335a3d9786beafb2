"""Headline-query benchmark.

Runs the flagship plans on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is fully executed (results written to a no-op sink via ``count``
on the final plan), timed after one warm-up query so JVM start-up is excluded.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "moa_inference",            # kNN among annotated profiles + propagation (entry)
    "loo_benchmark",            # leave-one-compound-out kNN + propagation
    "accuracy_above_threshold",  # calibration of the benchmark
    "cosine_knn",               # compound vs knock-down exact kNN
    "top_genes_by_robustness",  # unique hits -> robustness -> ranked genes (600k hits at sf0.1)
    "hypergeom_enrichment",     # overlap join + exact hypergeometric tails
    "composite_score",          # four scores incl. BH-adjusted enrichment
    "shuffled_null_best",       # permutation null (perm as a key)
    "shuffled_null_single",     # 200 permutations, target ranks counted
    "repeated_auroc",           # 10 draws x 2 spaces of pair AUROC
    "argsort_unique_rank",      # external profiles vs reference
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["PERTSCOPE_MASTER"] = f"local[{cpus}]"
    from pertscope.plans.catalog import QUERIES
    from pertscope.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]
    # warm-up: JVM, Python workers, parquet footers
    QUERIES["value_counts"](spark, sf_dir).count()
    times = {}
    for k in keys:
        t0 = time.time()
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
