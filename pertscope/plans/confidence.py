"""Confidence scoring of ranked gene lists (score 1-4 and composite) and the
enrichment pipeline feeding score 3."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrichment as en
from ..operators import ranking as rk
from ..operators import scores as sc
from ..session import by_shuffle, drop_tables, in_round, materialize, materialize_rounds, rounds_of
from ..sources import fixtures as fx
from ..sources.tables import Tables
from .gene_ranking import K_GENES, written_ranking, written_signatures


def gene_sets(t: Tables) -> DataFrame:
    """Fixture gene sets with library priority (later library wins)."""
    gs = fx.gene_sets(t)
    prio = (F.when(F.col("library") == "A", 0).when(F.col("library") == "N", 1)
            .when(F.col("library") == "R", 2).otherwise(3))
    # the merged library is reference data read by several branches (universe,
    # term sizes, overlap join): resolve it once, some terms at a time, and keep it as a table
    rounds = rounds_of(t.lineitem.count())
    gs = gs.withColumn("priority", prio)
    return materialize_rounds(
        t.spark, lambda i: en.resolve_library_overrides(gs.where(in_round("term", i, rounds))), rounds, "gene_sets")


def listed_genes(t: Tables) -> DataFrame:
    """The gene lists as a table; a gene stands in it once for each hit."""
    rounds = rounds_of(t.lineitem.count())
    return materialize_rounds(t.spark, lambda i: fx.listed_genes(t, (i, rounds)), rounds, "listed-genes")


def overlap_report(t: Tables) -> DataFrame:
    """Per compound: number, sum and maximum of its overlaps with terms."""
    lists, gs = listed_genes(t), gene_sets(t)
    out = en.term_overlap(lists, gs, each=lambda ov: ov.groupBy("compound").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("k").alias("sum_overlap"), F.max("k").alias("max_overlap")))
    drop_tables(lists, gs)
    return out


def best_p(t: Tables) -> DataFrame:
    lists, gs = listed_genes(t), gene_sets(t)
    out = en.compound_best_p(lists, gs)
    drop_tables(lists, gs)
    return out


def enrichment(spark, sf_dir: str) -> DataFrame:
    return en.enrichment_scores(best_p(Tables(spark, sf_dir)))


def confidence_table(spark, sf_dir: str, ranking: DataFrame | None = None,
                     samples: DataFrame | None = None) -> DataFrame:
    """``conf``: n_sigs, score_n_sigs, mean_tas, score_tas, enrich_score_raw,
    score_enrichment, robustness_100, score_robustness, composite_score.
    ``ranking``, ``samples``: the written cg of ``robustness_tables`` and the
    written signatures where the caller has them."""
    t = Tables(spark, sf_dir)
    samples = samples if samples is not None else written_signatures(spark, t)
    ranked = ranking if ranking is not None else written_ranking(spark, sf_dir, samples)
    enr = materialize(enrichment(spark, sf_dir).select("compound", "enrich_score_raw"), "enrichment_scores")
    n_rows = t.lineitem.count()
    rounds = rounds_of(n_rows)

    def raw(i: int) -> DataFrame:
        """The rows of a round's compounds."""
        mine = in_round("compound", i, rounds)
        # the ranked compounds and their means read one shuffle, in parts that follow the input
        cg = ranked.where(mine).repartition(fx.parts_of(spark, n_rows // rounds), "compound")
        compounds = rk.top_genes(cg, K_GENES).select("compound").distinct()
        told = samples.where(mine)
        return (sc.n_sigs_qc(told, compounds)
                .join(by_shuffle(sc.mean_tas(told, compounds)), "compound")
                .join(by_shuffle(enr), "compound", "left")
                .withColumn("enrich_score_raw", F.coalesce("enrich_score_raw", F.lit(0.0)))
                .join(by_shuffle(rk.mean_top_k(cg, 100)), "compound", "left"))

    # one row per compound; written once so the four global min/max scalars
    # below read it instead of recomputing the ranking and enrichment jobs
    conf = materialize_rounds(spark, raw, rounds, "confidence_raw")
    conf = conf.withColumn("log_n_sigs", F.log1p(F.col("n_sigs").cast("double")))
    conf = sc.minmax(conf, "log_n_sigs", "score_n_sigs").drop("log_n_sigs")
    conf = sc.minmax(conf, "mean_tas", "score_tas")
    conf = sc.max_scaled(conf, "enrich_score_raw", "score_enrichment")
    conf = sc.minmax(conf, "robustness_100", "score_robustness")
    conf = conf.withColumn("composite_score", sc.mean_ignoring_null(
        ["score_n_sigs", "score_tas", "score_enrichment", "score_robustness"]))
    return conf.select("compound", "n_sigs", "score_n_sigs", "mean_tas", "score_tas", "enrich_score_raw",
                       "score_enrichment", "robustness_100", "score_robustness", "composite_score")
