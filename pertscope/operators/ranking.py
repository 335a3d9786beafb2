"""Per-signature unique hits, replicate robustness, ranked gene lists and the
target-position statistics built on them (W1-W7, A2-A4, A7, P11).

All windows are partitioned by a signature or a compound and hold at most one
row per distinct gene of that signature/compound, so a hot compound costs
rows-per-gene, never rows-per-input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import normalize_compound, normalize_gene
from ..session import by_shuffle


def _dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` in ``parts`` parts by its keys, so that a caller who knows the
    size bounds what a task sorts; as Spark likes without a number."""
    return df.repartition(parts, *keys) if parts else df


def topk_unique_per_row(hits: DataFrame, k: int = 100, max_scan: int | None = None,
                        by: list[str] | None = None) -> DataFrame:
    """Walk each signature's neighbours in rank order, keep the first
    occurrence of every gene (NULL genes skipped), stop at ``k`` genes.

    ``hits(cp_sig, compound, rank, gene, ...)`` -> ``(*by, cp_sig, compound, gene, pos)``.
    """
    by = list(by or [])
    h = hits.filter(F.col("gene").isNotNull())
    if max_scan is not None:
        h = h.filter(F.col("rank") <= max_scan)
    first = h.groupBy(*by, "cp_sig", "compound", "gene").agg(F.min("rank").alias("first_rank"))
    w = Window.partitionBy(*by, "cp_sig").orderBy("first_rank")
    return (first.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
            .select(*by, "cp_sig", "compound", "gene", "pos"))


def signatures_per_compound(signatures: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A3: number of all signatures per compound (NULL names excluded)."""
    by = list(by or [])
    return (signatures.filter(F.col("compound").isNotNull())
            .groupBy(*by, "compound").agg(F.count(F.lit(1)).alias("n_cp_sigs")))


def support_counts(pairs: DataFrame, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """A2: signatures per (compound, gene); ``pairs`` has each (signature, gene) once."""
    by = list(by or [])
    told = pairs.select(*by, "compound", "gene", F.col("cp_sig").isNotNull().alias("told"))
    return _dealt(told, parts, *by, "compound", "gene").groupBy(*by, "compound", "gene").agg(F.count_if("told").alias("n_support"))


def robustness(pairs: DataFrame, signatures: DataFrame, by: list[str] | None = None,
               parts: int | None = None) -> DataFrame:
    """A4: ``cg(compound, gene, n_support, n_cp_sigs, robustness)``."""
    by = list(by or [])
    sup = _dealt(support_counts(pairs, by, parts), parts, "compound")
    n = _dealt(signatures_per_compound(signatures), parts, "compound")
    return (sup.join(by_shuffle(n), "compound", "left")
            .withColumn("robustness", F.col("n_support") / F.col("n_cp_sigs")))


def top_genes(cg: DataFrame, k: int = 100, metric: str = "robustness") -> DataFrame:
    """``(compound, rank, gene, metric)``, metric desc then gene, first k."""
    w = Window.partitionBy("compound").orderBy(F.col(metric).desc(), F.col("gene"))
    return (cg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("compound", "rank", "gene", metric))


def pivot_ranked(top: DataFrame, k: int = 100) -> DataFrame:
    """Long ranked list -> ``compound, gene_1 .. gene_k`` (export layout)."""
    wide = top.groupBy("compound").pivot("rank", list(range(1, k + 1))).agg(F.first("gene"))
    return wide.select("compound", *[F.col(str(i)).alias(f"gene_{i}") for i in range(1, k + 1)])


def mean_top_k(cg: DataFrame, k: int = 100, metric: str = "robustness") -> DataFrame:
    """Mean of the k largest metric values per compound."""
    w = Window.partitionBy("compound").orderBy(F.col(metric).desc(), F.col("gene"))
    return (cg.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
            .groupBy("compound").agg(F.avg(metric).alias(f"{metric}_{k}")))


def min_rank_percentile(cg: DataFrame, metric: str = "robustness", by: list[str] | None = None) -> DataFrame:
    """Per compound, ``rank1`` = min-method rank of metric descending,
    ``percentile = 100 * (1 - (rank1-1)/(n-1))`` (100 when n = 1), and the
    0-based plot position ordered by (metric desc, gene)."""
    by = list(by or [])
    wr = Window.partitionBy(*by, "compound").orderBy(F.col(metric).desc())
    wp = Window.partitionBy(*by, "compound").orderBy(F.col(metric).desc(), F.col("gene"))
    wn = Window.partitionBy(*by, "compound")
    out = (cg.withColumn("rank1", F.rank().over(wr))
           .withColumn("n_candidates", F.count(F.lit(1)).over(wn))
           .withColumn("plot_position", F.row_number().over(wp) - 1))
    pct = F.when(F.col("n_candidates") == 1, F.lit(100.0)).otherwise(
        100.0 * (1.0 - (F.col("rank1") - 1) / (F.col("n_candidates") - 1)))
    return out.withColumn("percentile", pct)


def target_rank_single(ranked: DataFrame, targets: DataFrame, metric: str = "robustness",
                       by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """rank/percentile/value of the expected gene per compound (exact
    name match).  Target absent -> ``found`` false and NULL ranks; compound
    absent from the table -> no row."""
    by = list(by or [])
    tg = targets.select("compound", F.col("target").alias("target_gene"))
    n = ranked.groupBy(*by, "compound").agg(F.max("n_candidates").alias("n_candidates"))
    present = n.join(tg, "compound")
    hit = ranked.select(*by, "compound", F.col("gene").alias("target_gene"), "rank1", "percentile",
                        F.col(metric).alias("value"))
    keys = [*by, "compound", "target_gene"]
    j = _dealt(present, parts, *keys).join(_dealt(hit, parts, *keys), keys, "left")
    return j.select(*by, "compound", "target_gene", F.col("rank1").isNotNull().alias("found"),
                    (F.col("rank1") - 1).alias("rank0"), "rank1", "percentile", "n_candidates", "value")


def target_rank_best(ranked: DataFrame, targets: DataFrame, metric: str = "robustness",
                     missing: str = "nan", by: list[str] | None = None) -> DataFrame:
    """Several targets per compound; best = min rank1, then metric desc,
    then gene.  ``missing='worst'`` gives rank n+1 / percentile 0 when no target
    is found; a compound absent from the table keeps a row with 0 candidates
    and NULL rank under both modes."""
    if missing not in ("nan", "worst"):
        raise ValueError("missing must be 'nan' or 'worst'")
    by = list(by or [])
    tg = targets.filter(F.col("target").isNotNull()).select("compound", F.col("target").alias("gene"))
    n_in = tg.groupBy("compound").agg(F.count(F.lit(1)).alias("n_targets_input"))
    n = ranked.groupBy(*by, "compound").agg(F.max("n_candidates").alias("n_candidates"))
    found = ranked.join(tg, ["compound", "gene"])
    best = found.groupBy(*by, "compound").agg(
        F.min_by(F.struct("gene", "rank1", "percentile", F.col(metric).alias("value")),
                 F.struct("rank1", (-F.col(metric)).alias("neg"), "gene")).alias("b"),
        F.count(F.lit(1)).alias("n_targets_found"))
    base = n_in.join(n, "compound", "left") if not by else n.join(n_in, "compound")
    j = base.join(best, [*by, "compound"], "left")
    has_table = F.col("n_candidates").isNotNull()
    ok = F.col("b").isNotNull()
    worst = F.lit(missing == "worst") & has_table & ~ok
    rank1 = F.when(ok, F.col("b.rank1")).when(worst, F.col("n_candidates") + 1)
    return j.select(
        *by, "compound", F.col("b.gene").alias("target_gene"), ok.alias("found"),
        (rank1 - 1).alias("rank0"), rank1.alias("rank1"),
        F.when(ok, F.col("b.percentile")).when(worst, F.lit(0.0)).alias("percentile"),
        F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        "n_targets_input",
        F.coalesce("n_targets_found", F.lit(0)).cast("long").alias("n_targets_found"),
        F.col("b.value").alias("value"))


def best_target_position(top: DataFrame, targets: DataFrame, k: int = 100, parts: int | None = None) -> DataFrame:
    """W7 + J9: match known compounds to ranked compounds case-insensitively;
    first rank whose gene is a known target, overlap counts, recall/precision
    (4 decimals, half-even), sorted ';' overlap list and a note."""
    t = (targets.filter(F.col("target").isNotNull())
         .select("compound", normalize_compound("compound").alias("key"),
                 normalize_gene("target").alias("tnorm")))
    t = _dealt(t, parts, "key").distinct()
    n_known = t.groupBy("compound", "key").agg(F.count(F.lit(1)).alias("n_known_targets"))
    tl = top.filter(F.col("rank") <= k).filter(F.col("gene").isNotNull())
    tl = tl.select(F.col("compound").alias("matched_compound"), normalize_compound("compound").alias("key"),
                   "rank", "gene", normalize_gene("gene").alias("gnorm"))
    tl = _dealt(tl, parts, "key")
    # one ranked compound per normalised key (the last name in name order)
    name = tl.groupBy("key").agg(F.max("matched_compound").alias("matched_compound"))
    tl = tl.join(by_shuffle(name.withColumnRenamed("matched_compound", "last")), "key").where(
        F.col("matched_compound") == F.col("last")).drop("last")
    pred = tl.groupBy("key").agg(F.countDistinct("gnorm").alias("n_pred"))
    ov = (tl.join(by_shuffle(t.select("key", "tnorm")), (tl.key == t.key) & (tl.gnorm == t.tnorm))
          .drop(t.key))
    ov_agg = ov.groupBy("key").agg(
        F.countDistinct("gnorm").alias("n_overlap"),
        F.min_by("gene", "rank").alias("best_target_gene"),
        F.min("rank").alias("best_target_rank"),
        F.array_join(F.array_sort(F.collect_set("gnorm")), ";").alias("overlapping_targets"))
    j = n_known
    for more in (name, pred, ov_agg):
        j = j.join(by_shuffle(more), "key", "left")
    matched = F.col("matched_compound").isNotNull()
    n_ov = F.coalesce(F.col("n_overlap"), F.lit(0))
    recall = F.when(F.col("n_known_targets") > 0, n_ov / F.col("n_known_targets")).otherwise(0.0)
    prec = F.when(F.col("n_pred") > 0, n_ov / F.col("n_pred")).otherwise(0.0)
    return j.select(
        "compound", "matched_compound", F.col("n_known_targets").cast("long").alias("n_known_targets"),
        F.when(matched, n_ov).cast("long").alias("n_overlap"),
        F.when(matched, F.bround(recall, 4)).alias("target_recall"),
        F.when(matched, F.bround(prec, 4)).alias("target_precision"),
        F.col("best_target_rank").cast("long").alias("best_target_rank"),
        "best_target_gene",
        F.when(matched, F.coalesce("overlapping_targets", F.lit(""))).alias("overlapping_targets"),
        F.when(matched, F.lit("ok")).otherwise(F.lit("compound_not_in_top_genes_df")).alias("note"))
