"""kNN label propagation from annotated to unannotated groups.

Inputs are long tables:
  * ``neighbors(query_id, rank, ref_id, distance, ref_group)`` from the kNN
    operator (``ref_group`` = the reference compound),
  * ``labels(group, label)`` multi-valued, distinct,
  * ``samples(query_id, query_group)`` - every query sample, so that abstaining
    samples still count in compound means (they add zero probability).

The probability matrix stays sparse: ``(query_id, label, p)`` with zeros absent.
Every step is a join, window or grouped aggregate keyed by query sample or query
compound; windows are partitioned by query so their groups hold at most
``k_raw`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

WEIGHTINGS = ("uniform", "inverse", "softmax")
COLLAPSE_MODES = ("closest", "sum")


def neighbor_weights(df: DataFrame, dist_col: str, part_cols: list[str],
                     weighting: str = "softmax", temperature: float = 0.07,
                     out_col: str = "w") -> DataFrame:
    """Per-partition weights of ``dist_col``, normalised by ``sum + 1e-12``."""
    w = Window.partitionBy(*part_cols)
    d = F.col(dist_col)
    if weighting == "uniform":
        raw = F.lit(1.0)
    elif weighting == "inverse":
        raw = F.lit(1.0) / (F.greatest(d, F.lit(0.0)) + F.lit(1e-8))
    elif weighting == "softmax":
        t = max(float(temperature), 1e-8)
        z = -d / F.lit(t)
        raw = F.exp(z - F.max(z).over(w))
    else:
        raise ValueError("weighting must be 'uniform', 'inverse', or 'softmax'")
    tmp = f"__{out_col}_raw"
    return (df.withColumn(tmp, raw)
            .withColumn(out_col, F.col(tmp) / (F.sum(tmp).over(w) + F.lit(1e-12)))
            .drop(tmp))


def top_with_ties(probs: DataFrame, key: str, label: str = "label", p: str = "p") -> DataFrame:
    """``(key, top_label, top_conf)``; ties by |p-max| <= 1e-8 + 1e-5*|max|,
    joined with ';' in label order."""
    w = Window.partitionBy(key)
    m = probs.withColumn("__max", F.max(p).over(w))
    tied = m.filter(F.abs(F.col(p) - F.col("__max")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col("__max")))
    return tied.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(label)), ";").alias("top_label"),
        F.max("__max").alias("top_conf"))


def top_tied_labels(probs: DataFrame, key: str, label: str = "label", p: str = "p") -> DataFrame:
    """The exploded form of P4: one row per (key, tied top label)."""
    w = Window.partitionBy(key)
    m = probs.withColumn("__max", F.max(p).over(w))
    return (m.filter(F.abs(F.col(p) - F.col("__max")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col("__max")))
            .select(key, label))


@dataclass
class Propagation:
    sample_probs: DataFrame     # (query_id, label, p)
    sample_top: DataFrame       # P6
    compound_probs: DataFrame   # (query_group, label, p)
    compound_top: DataFrame     # P9


def collapse_neighbors(neighbors: DataFrame, labels: DataFrame, *, k_raw: int = 50,
                       weighting: str = "softmax", temperature: float = 0.07,
                       collapse_mode: str = "closest") -> DataFrame:
    """Cut to ``k_raw``, keep labelled refs, collapse samples to compounds.

    Returns ``(query_id, ref_group, w, n_unique)``: one row per (query sample,
    reference compound) with its normalised weight and the number of distinct
    reference compounds of that sample.
    """
    if collapse_mode not in COLLAPSE_MODES:
        raise ValueError("collapse_mode must be 'closest' or 'sum'")
    labelled = labels.select(F.col("group").alias("ref_group")).distinct()
    nb = (neighbors.filter(F.col("rank") <= k_raw)            # cut first, then filter (Q4)
          .join(labelled, "ref_group", "left_semi"))
    if collapse_mode == "closest":
        per_cmp = nb.groupBy("query_id", "ref_group").agg(F.min("distance").alias("d"))
        per_cmp = neighbor_weights(per_cmp, "d", ["query_id"], weighting, temperature, "w")
    else:
        ws = neighbor_weights(nb, "distance", ["query_id"], weighting, temperature, "ws")
        per_cmp = ws.groupBy("query_id", "ref_group").agg(F.sum("ws").alias("ws"))
        per_cmp = per_cmp.withColumn(
            "w", F.col("ws") / (F.sum("ws").over(Window.partitionBy("query_id")) + F.lit(1e-12)))
    per_cmp = per_cmp.withColumn("n_unique", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    return per_cmp.select("query_id", "ref_group", "w", "n_unique")


def propagate_labels(samples: DataFrame, neighbors: DataFrame, labels: DataFrame, *,
                     k_raw: int = 50, weighting: str = "softmax", temperature: float = 0.07,
                     collapse_mode: str = "closest", min_unique_ref_compounds: int = 3) -> Propagation:
    """P2/P3 + P4-P9.  ``samples(query_id, query_group)``, ``labels(group, label)``."""
    labels = labels.select("group", "label").distinct()
    n_lab = labels.groupBy("group").agg(F.count(F.lit(1)).alias("n_labels"))
    # (sample, reference compound) weights and the sparse P table are each read
    # by several branches below; writing them once keeps every branch from
    # re-deriving them (and cuts lineage for executor loss)
    collapsed_all = materialize(collapse_neighbors(neighbors, labels, k_raw=k_raw, weighting=weighting,
                                                   temperature=temperature, collapse_mode=collapse_mode),
                                "collapsed")
    n_unique = collapsed_all.groupBy("query_id").agg(F.max("n_unique").alias("n_unique_ref_compounds"))
    collapsed = collapsed_all.filter(F.col("n_unique") >= min_unique_ref_compounds)

    # each compound's weight is split equally over its labels, then rows renormalised
    shares = (collapsed.join(n_lab.withColumnRenamed("group", "ref_group"), "ref_group")
              .join(labels.withColumnRenamed("group", "ref_group"), "ref_group")
              .groupBy("query_id", "label")
              .agg(F.sum(F.col("w") / F.col("n_labels")).alias("raw")))
    sample_probs = materialize(
        shares.withColumn("p", F.col("raw") / (F.sum("raw").over(Window.partitionBy("query_id")) + F.lit(1e-12)))
        .select("query_id", "label", "p"), "sample_probs")

    sample_best = top_with_ties(sample_probs, "query_id")
    sample_tied = top_tied_labels(sample_probs, "query_id")

    # P5: collapsed compounds carrying any top label (each compound once)
    support = (collapsed.join(labels.withColumnRenamed("group", "ref_group"), "ref_group")
               .join(sample_tied, ["query_id", "label"], "left_semi")
               .select("query_id", "ref_group", "w").distinct()
               .groupBy("query_id")
               .agg(F.count(F.lit(1)).alias("support_top_moa_count"),
                    F.sum("w").alias("support_top_moa_weight")))

    # Every query sample, abstainers included
    sample_top = (samples.select("query_id", "query_group")
                  .join(sample_best, "query_id", "left")
                  .join(n_unique, "query_id", "left")
                  .join(support, "query_id", "left")
                  .select("query_id", "query_group",
                          F.col("top_label").alias("top_moa"),
                          F.coalesce("top_conf", F.lit(0.0)).alias("top_conf"),
                          F.coalesce("n_unique_ref_compounds", F.lit(0)).cast("long").alias("n_unique_ref_compounds"),
                          F.coalesce("support_top_moa_count", F.lit(0)).cast("long").alias("support_top_moa_count"),
                          F.coalesce("support_top_moa_weight", F.lit(0.0)).alias("support_top_moa_weight"),
                          F.col("top_label").isNull().alias("abstained")))

    # Compound mean over all of its samples (abstainers add zeros)
    n_samples = samples.groupBy("query_group").agg(F.count(F.lit(1)).alias("n_samples"))
    compound_probs = (sample_probs.join(samples.select("query_id", "query_group"), "query_id")
                      .groupBy("query_group", "label").agg(F.sum("p").alias("sum_p"))
                      .join(n_samples, "query_group")
                      .select("query_group", "label", (F.col("sum_p") / F.col("n_samples")).alias("p")))
    compound_best = top_with_ties(compound_probs, "query_group")
    compound_tied = top_tied_labels(compound_probs, "query_group")

    # A sample agrees when its top set meets the compound's top set;
    # abstaining samples count as agreeing (reference behaviour, Q2)
    overlap = (sample_tied.join(samples.select("query_id", "query_group"), "query_id")
               .join(compound_tied, ["query_group", "label"], "left_semi")
               .select("query_id").distinct().withColumn("overlap", F.lit(True)))
    per_sample = (sample_top.join(overlap, "query_id", "left")
                  .withColumn("agree", F.when(F.col("abstained") | F.col("overlap").isNotNull(), 1.0)
                              .otherwise(0.0)))

    compound_top = (per_sample.groupBy("query_group").agg(
        F.avg("agree").alias("agreement"),
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("n_unique_ref_compounds").alias("mean_unique_ref_compounds"),
        F.avg("support_top_moa_count").alias("mean_support_top_moa_count"),
        F.avg("support_top_moa_weight").alias("mean_support_top_moa_weight"),
        F.sum(F.col("abstained").cast("long")).alias("n_abstained"))
        .join(compound_best, "query_group", "left")
        .select("query_group", F.col("top_label").alias("top_moa"),
                F.coalesce("top_conf", F.lit(0.0)).alias("top_conf"),
                "agreement", "n_samples", "mean_unique_ref_compounds",
                "mean_support_top_moa_count", "mean_support_top_moa_weight", "n_abstained"))

    return Propagation(sample_probs, sample_top.drop("abstained"), compound_probs, compound_top)


def high_confidence(compound_top: DataFrame, threshold: float = 0.25) -> DataFrame:
    """keep compounds with support, and (strictly) above the confidence cut."""
    return compound_top.filter((F.col("mean_support_top_moa_count") != 0) & (F.col("top_conf") > threshold))
