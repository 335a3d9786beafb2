"""Label inference for unannotated compounds (the flagship plan) and the
leave-one-compound-out benchmark over annotated compounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.knn import cosine_knn
from ..session import materialize
from ..operators.propagation import Propagation, propagate_labels
from ..sources import fixtures as fx
from ..sources.tables import Tables


def _labels(t: Tables) -> DataFrame:
    return fx.pert_moa(t).select(F.col("pert_id").alias("group"), F.col("moa").alias("label"))


def infer_labels(spark, sf_dir: str, *, k_raw: int = 50, weighting: str = "softmax",
                 temperature: float = 0.07, collapse_mode: str = "closest",
                 min_unique_ref_compounds: int = 3) -> Propagation:
    """Unannotated compound profiles -> kNN among annotated profiles -> labels."""
    t = Tables(spark, sf_dir)
    labels = materialize(_labels(t), "labels")       # small dictionary, read by many branches
    query = fx.compound_profiles(t).join(labels.select(F.col("group").alias("pert_id")).distinct(), "pert_id",
                                         "left_anti").select("sig_id", "pert_id", "embedding")
    ref = fx.compound_profiles(t).join(labels.select(F.col("group").alias("pert_id")).distinct(), "pert_id",
                                       "left_semi").select("sig_id", "pert_id", "embedding")
    # only the first k_raw neighbours are used downstream, so search for k_raw
    nb = cosine_knn(query, ref, k_raw, group_col="pert_id")
    samples = materialize(query.select(F.col("sig_id").alias("query_id"), F.col("pert_id").alias("query_group")),
                          "samples")
    return propagate_labels(samples, nb, labels, k_raw=k_raw, weighting=weighting,
                            temperature=temperature, collapse_mode=collapse_mode,
                            min_unique_ref_compounds=min_unique_ref_compounds)


def compound_annotations(spark, sf_dir: str, **kw) -> DataFrame:
    """F20 + F21: compounds with support, named; the 'all annotations' output."""
    t = Tables(spark, sf_dir)
    ct = infer_labels(spark, sf_dir, **kw).compound_top
    names = fx.compound_profiles(t).groupBy("pert_id").agg(F.min("cmap_name").alias("cmap_name"))
    return (ct.filter(F.col("mean_support_top_moa_count") != 0)
            .withColumnRenamed("query_group", "pert_id")
            .join(names, "pert_id", "left"))


def loo_benchmark(spark, sf_dir: str, *, k_raw: int = 50, weighting: str = "softmax",
                  temperature: float = 0.07, collapse_mode: str = "closest",
                  min_unique_ref_compounds: int = 3) -> Propagation:
    """P10: every annotated compound predicted from all *other* annotated
    compounds - one kNN join with ``query_group <> ref_group``, not one index
    per held-out compound."""
    t = Tables(spark, sf_dir)
    labels = materialize(_labels(t), "labels")
    ann = fx.compound_profiles(t).join(labels.select(F.col("group").alias("pert_id")).distinct(), "pert_id",
                                       "left_semi").select("sig_id", "pert_id", "embedding")
    nb = cosine_knn(ann, ann, k_raw, group_col="pert_id", exclude_same_group=True)
    samples = materialize(ann.select(F.col("sig_id").alias("query_id"), F.col("pert_id").alias("query_group")),
                          "samples")
    return propagate_labels(samples, nb, labels, k_raw=k_raw, weighting=weighting,
                            temperature=temperature, collapse_mode=collapse_mode,
                            min_unique_ref_compounds=min_unique_ref_compounds)


def true_label_sets(t: Tables) -> DataFrame:
    """(pert_id, true_moa) with labels joined by ';' in label order."""
    return (fx.pert_moa(t).groupBy("pert_id")
            .agg(F.array_join(F.array_sort(F.collect_list("moa")), ";").alias("true_moa")))


def prevalent_compounds(t: Tables) -> DataFrame:
    """compounds having at least one label shared with another compound."""
    pm = fx.pert_moa(t)
    common = pm.groupBy("moa").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return pm.join(common, "moa", "left_semi").select("pert_id").distinct()


def benchmark_table(spark, sf_dir: str, **kw) -> DataFrame:
    """P10 output restricted to compounds with a prevalent label (F19), with
    the true label set and whether the prediction overlaps it."""
    from ..operators.stats import label_set_overlap
    t = Tables(spark, sf_dir)
    ct = loo_benchmark(spark, sf_dir, **kw).compound_top.withColumnRenamed("query_group", "pert_id")
    return (ct.join(prevalent_compounds(t), "pert_id", "left_semi")
            .join(true_label_sets(t), "pert_id", "left")
            .withColumn("is_true", label_set_overlap(F.col("top_moa"), F.col("true_moa"))))
