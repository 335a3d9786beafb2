"""Compound -> gene ranking by replicate robustness (P11) and the
known-target benchmarks on top of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking as rk
from ..operators.knn import cosine_knn
from ..session import by_shuffle, drop_tables, in_round, materialize, materialize_rounds, rounds_of
from ..sources import fixtures as fx
from ..sources.tables import Tables

K_GENES = 100


def robustness_tables(spark, sf_dir: str, k: int = K_GENES, max_scan: int | None = None):
    """P11 on the ranked-hit lists: returns (pairs, cg, top_long)."""
    t = Tables(spark, sf_dir)
    # written: the shuffles that rank the hits are gone before those that count them are made
    pairs = _unique_hits(spark, t, k, max_scan)
    cg = rk.robustness(pairs, fx.cp_signatures(t), parts=fx.task_parts(t.lineitem))
    top = rk.top_genes(cg, k)
    return pairs, cg, top


def _unique_hits(spark, t: Tables, k: int, max_scan: int | None = None) -> DataFrame:
    """The pairs of all signatures, ranked some signatures at a time."""
    rounds = rounds_of(t.lineitem.count())
    return materialize_rounds(
        spark, lambda i: rk.topk_unique_per_row(fx.ranked_hits(t, (i, rounds)), k, max_scan), rounds, "unique-hits")


def written_signatures(spark, t: Tables) -> DataFrame:
    """The compound signatures as a table, for those who read them more than once."""
    rounds = rounds_of(t.lineitem.count())
    return materialize_rounds(spark, lambda i: fx.cp_signatures(t, (i, rounds)), rounds, "signatures")


def written_ranking(spark, sf_dir: str, samples: DataFrame) -> DataFrame:
    """The cg of ``robustness_tables`` as a table, made some compounds at a time."""
    t = Tables(spark, sf_dir)
    pairs = _unique_hits(spark, t, K_GENES)
    n_rows = t.lineitem.count()
    rounds = rounds_of(n_rows)
    mine = lambda df, i: df.where(in_round("compound", i, rounds))
    cg = materialize_rounds(
        spark, lambda i: rk.robustness(mine(pairs, i), mine(samples, i), parts=fx.parts_of(spark, n_rows // rounds)),
        rounds, "robustness")
    drop_tables(pairs)
    return cg


def knn_robustness(spark, sf_dir: str, k_neighbors: int = 1000, k: int = K_GENES) -> DataFrame:
    """The end-to-end form: compound profiles searched against knock-down
    profiles; each neighbour carries its knock-down gene (cmap_name)."""
    t = Tables(spark, sf_dir)
    cp = fx.compound_profiles(t)
    sh = fx.knockdown_profiles(t)
    nb = cosine_knn(cp, sh, k_neighbors)
    genes = sh.select(F.col("sig_id").alias("ref_id"), F.col("cmap_name").alias("gene"))
    comp = cp.select(F.col("sig_id").alias("query_id"), F.col("cmap_name").alias("compound"))
    hits = (nb.join(genes, "ref_id").join(comp, "query_id")
            .select(F.col("query_id").alias("cp_sig"), "compound", "rank", "gene"))
    pairs = rk.topk_unique_per_row(hits, k)
    sigs = cp.select(F.col("sig_id").alias("cp_sig"), F.col("cmap_name").alias("compound"))
    return rk.robustness(pairs, sigs)


def single_targets(t: Tables) -> DataFrame:
    return fx.targets(t).filter(F.col("target_order") == 1).select("compound", "target")


def null_inputs(spark, sf_dir: str, k: int = K_GENES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Observed rank table, hits, reference genes and signatures for the null analyses."""
    t = Tables(spark, sf_dir)
    _, cg, _ = robustness_tables(spark, sf_dir, k)
    observed = materialize(rk.min_rank_percentile(cg), "observed_ranks")
    return observed, fx.ranked_hits(t), fx.ref_genes(t), fx.cp_signatures(t)


def recovery(spark, sf_dir: str) -> DataFrame:
    """Confidence rows of compounds matched to a known-target entry, with
    the best target rank and whether a target was recovered (normalised keys
    on both sides)."""
    from .confidence import confidence_table
    from ..functions.labels import normalize_compound
    t = Tables(spark, sf_dir)
    # read by the target match and by the confidence scores: ranked once
    samples = written_signatures(spark, t)
    cg = written_ranking(spark, sf_dir, samples)
    n_rows = t.lineitem.count()
    rounds = rounds_of(n_rows)
    parts = fx.parts_of(spark, n_rows // rounds)

    def found(i: int) -> DataFrame:
        """The target positions of a round's normalised names."""
        mine = in_round(normalize_compound("compound"), i, rounds)
        top = rk.top_genes(cg.where(mine).repartition(parts, "compound"), K_GENES)
        pos = rk.best_target_position(top, fx.targets(t).where(mine), parts=parts).filter(F.col("note") == "ok")
        return pos.select(normalize_compound("compound").alias("key"), F.col("best_target_rank").alias("robustness_rank"))

    keyed = materialize_rounds(spark, found, rounds, "target-positions")
    conf = confidence_table(spark, sf_dir, cg, samples)
    return (conf.withColumn("key", normalize_compound("compound")).join(by_shuffle(keyed), "key")
            .drop("key").withColumn("recover", F.col("robustness_rank").isNotNull()))
