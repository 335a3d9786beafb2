"""Repeated pair-AUROC recapitulation (E8, E9, E11, E12) and the external
dataset contextualisation (F17, V6, E19, W9, W10, A16)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clip_negative
from ..operators import pairs as pr
from ..operators.cross_reduce import cross_distances, cross_summary, label_rank
from ..operators.pair_ranks import pair_auroc, pair_percentile
from ..operators.set_similarity import tanimoto_extreme
from ..session import materialize
from ..sources import fixtures as fx
from ..sources.tables import Tables

N_SAMPLES = 10          # reference: 10 draws
POS_PERCENTILE = 0.1    # reference: positives below the 0.1th percentile (of 100)


def sampled_knockdowns(t: Tables) -> DataFrame:
    """One knock-down profile per hairpin (pert_id) for each seed 0..9."""
    sh = fx.knockdown_profiles(t).select("sig_id", "pert_id", "cmap_name", "embedding")
    return pr.stratified_sample(sh, "pert_id", "sig_id", 1, list(range(N_SAMPLES)))


def space_pairs(t: Tables) -> DataFrame:
    """Pairs of sampled profiles per seed in two spaces: the embedding and the
    clipped raw vector; ``same`` = both profiles target the same gene."""
    s = sampled_knockdowns(t)
    emb = pr.pairwise_cosine(s, "sig_id", "embedding", by=["seed"]).withColumn("space", F.lit("embedding"))
    raw = pr.pairwise_cosine(s.withColumn("raw", clip_negative("embedding")), "sig_id", "raw", by=["seed"]) \
        .withColumn("space", F.lit("raw"))
    genes = s.select("seed", "sig_id", "cmap_name")
    p = emb.unionByName(raw)
    p = (p.join(genes.withColumnRenamed("sig_id", "id_a").withColumnRenamed("cmap_name", "gene_a"), ["seed", "id_a"])
         .join(genes.withColumnRenamed("sig_id", "id_b").withColumnRenamed("cmap_name", "gene_b"), ["seed", "id_b"]))
    # the sampled-pair table feeds several rank computations: write it once
    return materialize(p.withColumn("same", F.col("gene_a") == F.col("gene_b")), "sampled_pairs")


def _with_raw(rows: DataFrame) -> DataFrame:
    """The clipped profile beside the embedding, on the table that all tile passes read."""
    return materialize(rows.withColumn("raw", clip_negative("embedding")), "sampled_profiles")


SPACES = {"embedding": "embedding", "raw": "raw"}


def repeated_auroc(t: Tables) -> DataFrame:
    """E12 (genetic consistency): AUROC of similarity for same-gene pairs, per seed and space."""
    return pair_auroc(_with_raw(sampled_knockdowns(t)), "sig_id", SPACES, ["seed"], label_col="cmap_name")


def percentile_positive(t: Tables) -> DataFrame:
    """Per seed, pairs whose raw-space distance is strictly below the
    0.1th percentile are positives; AUROC of the embedding similarity."""
    s = _with_raw(sampled_knockdowns(t))
    thr = materialize(pair_percentile(s, "sig_id", "raw", POS_PERCENTILE / 100.0, ["seed"]), "pair-threshold")
    auc = pair_auroc(s, "sig_id", {"embedding": "embedding"}, ["seed"], reference=("raw", thr))
    return thr.drop("n").join(auc.drop("space"), "seed")


def chemical_auroc(t: Tables) -> DataFrame:
    """E8 + E12 (chemical form): one profile of each compound with a readable
    structure per seed; pairs of compounds below the 0.1th percentile of the
    Tanimoto distance are positives; AUROC in both spaces."""
    info = fx.compound_info(t).where("canonical_smiles IS NOT NULL AND canonical_smiles <> 'restricted'")
    bits = info.select("pert_id", pr.fold_fingerprint(F.filter(F.split("canonical_smiles", " "), lambda x: x != ""))
                       .alias("bits")).where(F.size("bits") > 0)
    s = pr.stratified_sample(fx.compound_profiles(t).join(bits.select("pert_id"), "pert_id", "left_semi")
                             .select("sig_id", "pert_id", "embedding"), "pert_id", "sig_id", 1, list(range(N_SAMPLES)))
    s = _with_raw(s)
    # every compound is drawn by every seed, so one join of structures serves all
    drawn = bits.join(s.select("pert_id").distinct(), "pert_id", "left_semi")
    told, below = tanimoto_extreme(drawn, "pert_id", "bits", POS_PERCENTILE / 100.0)
    sig = s.select("seed", "pert_id", "sig_id")
    listed = (below.join(sig.withColumnsRenamed({"pert_id": "id_a", "sig_id": "a"}), "id_a")
              .join(sig.withColumnsRenamed({"pert_id": "id_b", "sig_id": "b", "seed": "seed_b"}), "id_b")
              .where("seed = seed_b").select("seed", F.col("a").alias("id_a"), F.col("b").alias("id_b")))
    auc = pair_auroc(s, "sig_id", SPACES, ["seed"], listed=listed)
    return auc.withColumn("threshold", told.select("threshold").scalar())


def target_profile_auroc(t: Tables) -> DataFrame:
    """E8 + E12 (target-profile form): positives are the pairs below the 0.1th
    percentile of the cosine distance between target signatures, which join by
    key; of repeated keys the first row counts on both sides."""
    sign = fx.target_signatures(t).groupBy("key").agg(F.min_by("v", "row_no").alias("target"))
    info = fx.compound_info(t).where("inchi_key IS NOT NULL AND inchi_key <> 'restricted'")
    info = info.groupBy("inchi_key").agg(F.min("pert_id").alias("pert_id"))
    known = info.join(sign, F.col("inchi_key") == F.col("key"))
    s = pr.stratified_sample(fx.compound_profiles(t).select("sig_id", "pert_id", "embedding")
                             .join(known.select("pert_id", "inchi_key", "target"), "pert_id"),
                             "inchi_key", "sig_id", 1, list(range(N_SAMPLES)))
    s = _with_raw(s)
    thr = materialize(pair_percentile(s, "sig_id", "target", POS_PERCENTILE / 100.0, ["seed"]), "pair-threshold")
    auc = pair_auroc(s, "sig_id", SPACES, ["seed"], reference=("target", thr))
    return thr.drop("n").join(auc, "seed")


# ------------------------------------------------------------- external --

def harmonized_external(t: Tables) -> DataFrame:
    """external names mapped through the alias table; unlisted names drop.
    Spark broadcasts the table only while its size allows."""
    return fx.external(t).join(fx.external_aliases(t), "treatment")


def _external(t: Tables) -> tuple[DataFrame, DataFrame]:
    return harmonized_external(t), fx.external_reference(t).select("sig_id", "cmap_name", "embedding")


def external_distances(t: Tables) -> DataFrame:
    """V6: ``(id_a, id_b, distance, same)`` of every harmonised external profile
    and every reference profile; the tile knows both names."""
    ext, ref = _external(t)
    return cross_distances(ext, ref, "sig_id", "embedding", "ref_name", "cmap_name")


def background_vs_same(t: Tables) -> DataFrame:
    """Number, mean and minimum of the distances of an external profile to
    its own compound and to all others."""
    ext, ref = _external(t)
    return cross_summary(ext, ref, "sig_id", "embedding", "ref_name", "cmap_name")


def unique_rank(t: Tables) -> DataFrame:
    """Per external profile, rank (0-based) of its true compound among
    reference compounds ordered by (minimum distance, name)."""
    ext, ref = _external(t)
    found = label_rank(ext, ref, "sig_id", "embedding", "ref_name", "cmap_name")
    return (found.join(ext.select(F.col("sig_id").alias("id"), "treatment", "ref_name"), "id")
            .select(F.col("id").alias("sig_id"), "treatment", "ref_name", "rank0", "n_compounds", "true_distance",
                    (F.col("rank0") / F.col("n_compounds")).alias("rel_rank")))


def best_example(ranks: DataFrame) -> DataFrame:
    """Per treatment, the external profile with the lowest rank (first id on ties)."""
    return ranks.groupBy("treatment").agg(
        F.min_by(F.struct("sig_id", "rank0", "true_distance"), F.struct("rank0", "sig_id")).alias("b"),
        F.count(F.lit(1)).alias("n_queries")).select(
        "treatment", F.col("b.sig_id").alias("sig_id"), F.col("b.rank0").alias("rank0"),
        F.col("b.true_distance").alias("true_distance"), "n_queries")


KERNEL_ROWS = 512       # neighbouring values whose kernels are held at a time
REACH = 39.0            # bandwidths beyond which exp(-z * z / 2) is zero as a double


def _kernels(values: np.ndarray, at: np.ndarray, bw: float) -> np.ndarray:
    """Sum of the Gaussian kernels of all values at each point of an even grid.
    Sorted values share the points that they reach; the others get exact zeros."""
    total = np.zeros(len(at))
    values = np.sort(values)
    for k in range(0, len(values), KERNEL_ROWS):
        v = values[k:k + KERNEL_ROWS]
        near = slice(None)
        if np.isfinite(v[[0, -1]]).all() and bw > 0:
            near = slice(np.searchsorted(at, v[0] - REACH * bw), np.searchsorted(at, v[-1] + REACH * bw, "right"))
        z = (at[None, near] - v[:, None]) / bw
        total[near] += np.exp(-0.5 * z * z).sum(axis=0)
    return total


def kde_grid(samples: DataFrame, value: str, group: str, n_grid: int = 200) -> DataFrame:
    """Gaussian KDE per group on a shared grid over [min, max] of all
    values; bandwidth = sd * n^(-1/5) (Scott).  Every task adds the kernels of
    its samples into one array a group; the arrays are then summed.  A group
    with one value has no bandwidth and a null density.  The samples are read
    twice: for all bandwidths and bounds at once, and for the kernels."""
    bw = materialize(samples.groupBy(group).agg(
        F.count(F.col(value)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"),
        (F.stddev_samp(value) * F.pow(F.count(F.col(value)), -0.2)).alias("bw")), "kde-bandwidths")
    lo, hi = bw.agg(F.min("least")).scalar(), bw.agg(F.max("most")).scalar()
    told = bw.select(group, "bw").withColumns({"lo": lo, "step": (hi - lo) / F.lit(n_grid - 1)})
    rows = samples.select(group, F.col(value).alias("v")).where("v IS NOT NULL").join(F.broadcast(told), group)

    def run(frames):
        sums = {}
        for frame in frames:
            for key, part in frame.groupby(group, dropna=False):
                at = part["lo"].iloc[0] + np.arange(n_grid) * part["step"].iloc[0]
                sums[key] = sums.get(key, 0.0) + _kernels(part["v"].to_numpy(), at, part["bw"].iloc[0])
        yield pd.DataFrame({group: list(sums), "grid": [x.tolist() for x in sums.values()]})

    kind = samples.schema[group].dataType.simpleString()
    grids = rows.mapInPandas(run, f"`{group}` {kind}, grid array<double>")
    summed = grids.select(group, F.posexplode("grid").alias("g", "k")).groupBy(group, "g").agg(F.sum("k").alias("k"))
    density = F.col("k") / (F.col("n") * F.col("bw") * F.lit((2 * np.pi) ** 0.5))
    return (summed.join(bw, group).withColumns({"_lo": lo, "_hi": hi})
            .select(group, "g", (F.col("_lo") + F.col("g") * ((F.col("_hi") - F.col("_lo")) / F.lit(n_grid - 1))).alias("x"),
                    F.when(~F.isnan(density), density).alias("density")))
