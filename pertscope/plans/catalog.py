"""Registry of named queries: key -> callable(spark, sf_dir) -> DataFrame.

Every key runs over the whole derived tables of ``sf_dir``.  Floating columns
are rounded to 6 places at the output so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.knn import cosine_knn, knn_graph
from ..sources import fixtures as fx
from ..sources.tables import Tables
from . import inference

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def normalized(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output contract: integral columns as BIGINT, fractional as DOUBLE
    rounded to ``digits`` places (so results compare across engines)."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------ kNN --

@register("cosine_knn")
def q_cosine_knn(spark, d):
    t = Tables(spark, d)
    nb = cosine_knn(fx.compound_profiles(t), fx.knockdown_profiles(t), 10)
    return rounded(nb.select("query_id", "rank", "ref_id", "distance"))


@register("cosine_knn_excluding_group")
def q_knn_loo(spark, d):
    t = Tables(spark, d)
    ann = fx.annotated_profiles(t)
    nb = cosine_knn(ann, ann, 10, group_col="pert_id", exclude_same_group=True)
    return rounded(nb.select("query_id", "rank", "ref_id", "ref_group", "distance"))


@register("knn_graph")
def q_knn_graph(spark, d):
    t = Tables(spark, d)
    return rounded(knn_graph(fx.profiles(t), 15))


# ---------------------------------------------------------- propagation --

_CT = ["top_moa", "top_conf", "agreement", "n_samples", "mean_unique_ref_compounds",
       "mean_support_top_moa_count", "mean_support_top_moa_weight", "n_abstained"]


@register("moa_inference")
def q_moa_inference(spark, d):
    ca = inference.compound_annotations(spark, d)
    return rounded(ca.select("pert_id", "cmap_name", *_CT))


@register("sample_top")
def q_sample_top(spark, d):
    st = inference.infer_labels(spark, d).sample_top
    return rounded(st.select(F.col("query_id").alias("sig_id"), F.col("query_group").alias("pert_id"),
                             "top_moa", "top_conf", "n_unique_ref_compounds",
                             "support_top_moa_count", "support_top_moa_weight"))


@register("sample_probs")
def q_sample_probs(spark, d):
    sp = inference.infer_labels(spark, d).sample_probs
    return rounded(sp.select(F.col("query_id").alias("sig_id"), F.col("label").alias("moa"), "p"))


@register("compound_probs")
def q_compound_probs(spark, d):
    cp = inference.infer_labels(spark, d).compound_probs
    return rounded(cp.select(F.col("query_group").alias("pert_id"), F.col("label").alias("moa"), "p"))


@register("high_confidence")
def q_high_conf(spark, d):
    from ..operators.propagation import high_confidence
    ct = inference.infer_labels(spark, d).compound_top
    return rounded(high_confidence(ct).select(F.col("query_group").alias("pert_id"), *_CT))


def _variant(weighting="softmax", mode="closest"):
    def q(spark, d):
        ct = inference.infer_labels(spark, d, weighting=weighting, collapse_mode=mode).compound_top
        return rounded(ct.select(F.col("query_group").alias("pert_id"), *_CT))
    return q


register("moa_inference_uniform")(_variant("uniform"))
register("moa_inference_inverse")(_variant("inverse"))
register("moa_inference_sum")(_variant(mode="sum"))


# ------------------------------------------------------ benchmark, E5.. --

from ..operators import stats  # noqa: E402
from ..operators.stats import label_set_overlap  # noqa: E402


@register("keep_prevalent_labels")
def q_prevalent(spark, d):
    return inference.prevalent_compounds(Tables(spark, d))


@register("labels_per_pert")
def q_labels_per_pert(spark, d):
    pm = fx.pert_moa(Tables(spark, d)).dropDuplicates(["pert_id", "moa"])
    return pm.groupBy("pert_id").agg(F.array_join(F.array_sort(F.collect_list("moa")), ";").alias("moas"),
                                     F.count(F.lit(1)).alias("n_moas"))


@register("loo_benchmark")
def q_loo(spark, d):
    b = inference.benchmark_table(spark, d)
    return rounded(b.select("pert_id", *_CT, "true_moa", "is_true"))


@register("accuracy_above_threshold")
def q_acc_thr(spark, d):
    b = inference.benchmark_table(spark, d)
    return rounded(stats.accuracy_above_threshold(b, "top_conf", "is_true"))


@register("calibration_accuracy")
def q_cal_acc(spark, d):
    return rounded(stats.accuracy_above_threshold(fx.calibration(Tables(spark, d)), "measure", "truth"))


@register("value_counts")
def q_value_counts(spark, d):
    return rounded(stats.value_proportions(fx.pert_moa(Tables(spark, d)), "moa"))


def _pred_props(spark, d):
    ca = inference.compound_annotations(spark, d)
    return stats.fractional_proportions(ca, "top_moa", out="moa")


@register("fractional_proportions")
def q_frac(spark, d):
    return rounded(_pred_props(spark, d))


def _aligned(spark, d):
    a = stats.value_proportions(fx.pert_moa(Tables(spark, d)), "moa").select(
        "moa", F.col("proportion").alias("ref_prop"))
    b = _pred_props(spark, d).select("moa", F.col("proportion").alias("pred_prop"))
    return a.join(b, "moa")          # J5: outer concat + dropna == inner join


@register("align_proportions")
def q_align(spark, d):
    return rounded(_aligned(spark, d))


@register("spearman")
def q_spearman(spark, d):
    return rounded(stats.spearman(_aligned(spark, d), "ref_prop", "pred_prop").drop("p_value"))


@register("spearman_test")
def q_spearman_test(spark, d):
    return rounded(stats.spearman(_aligned(spark, d), "ref_prop", "pred_prop"))


@register("proportion_abs_diff")
def q_absdiff(spark, d):
    a = _aligned(spark, d).withColumn("abs_diff", F.abs(F.col("ref_prop") - F.col("pred_prop")))
    return rounded(stats.top_n(a, [F.col("abs_diff").desc(), F.col("moa")], 15))


def _cal(spark, d):
    return fx.calibration(Tables(spark, d))


@register("group_summary")
def q_group_summary(spark, d):
    return rounded(stats.group_summary(_cal(spark, d), "lang", "measure"))


@register("histogram")
def q_hist(spark, d):
    return rounded(stats.histogram(_cal(spark, d), "measure", 20))


@register("five_number_summary")
def q_five(spark, d):
    c = _cal(spark, d).withColumn("truth", F.col("truth").cast("string"))
    return rounded(stats.five_number_summary(c, "measure", ["lang", "truth"]))


@register("unpivot_scores")
def q_unpivot(spark, d):
    c = _cal(spark, d).select("doc_id", "measure", (1 - F.col("measure")).alias("inverse"),
                              F.when(F.col("truth"), F.col("measure")).alias("measure_if_true"))
    u = c.unpivot("doc_id", ["measure", "inverse", "measure_if_true"], "metric", "score")
    return rounded(u.filter(F.col("score").isNotNull()))


@register("roc_curve")
def q_roc(spark, d):
    return rounded(stats.roc_curve(_cal(spark, d), "measure", "truth"))


@register("roc_auc")
def q_auc(spark, d):
    return rounded(stats.roc_auc(_cal(spark, d), "measure", "truth"))


@register("mann_whitney_greater")
def q_mwu(spark, d):
    return rounded(stats.mann_whitney_greater(_cal(spark, d), "measure", "truth").select("n1", "n2", "u", "z"))


@register("mann_whitney_test")
def q_mwu_test(spark, d):
    return rounded(stats.mann_whitney_greater(_cal(spark, d), "measure", "truth"))


@register("ecdf")
def q_ecdf(spark, d):
    return rounded(stats.ecdf(_cal(spark, d), "measure"))


def _predictions(spark, d):
    t = Tables(spark, d)
    p = fx.profiles(t)
    nn = knn_graph(p, 1).filter(F.col("rank") == 1)
    lab = p.select("sig_id", "label")
    return (nn.join(lab.withColumnRenamed("sig_id", "query_id"), "query_id")
            .join(lab.select(F.col("sig_id").alias("ref_id"), F.col("label").alias("prediction")), "ref_id")
            .select("query_id", F.col("label").alias("truth"), "prediction"))


@register("classification_metrics")
def q_cls(spark, d):
    return rounded(stats.classification_metrics(_predictions(spark, d), "truth", "prediction"))


@register("classification_metrics_by_split")
def q_cls_split(spark, d):
    """The metrics of training and validation rows apart."""
    pred = cl.train_valid_split(_predictions(spark, d), "query_id")
    return rounded(stats.classification_metrics(pred, "truth", "prediction", ["split"]))


# ---------------------------------------------------------- gene ranking --

from ..operators import ranking as rk  # noqa: E402
from . import gene_ranking as gr  # noqa: E402


@register("topk_unique_per_row")
def q_w1(spark, d):
    return gr.robustness_tables(spark, d)[0]


@register("support_counts")
def q_a2(spark, d):
    return rk.support_counts(gr.robustness_tables(spark, d)[0], parts=fx.task_parts(Tables(spark, d).lineitem))


@register("signatures_per_compound")
def q_a3(spark, d):
    return rk.signatures_per_compound(fx.cp_signatures(Tables(spark, d)))


@register("robustness")
def q_a4(spark, d):
    return rounded(gr.robustness_tables(spark, d)[1])


@register("top_genes_by_robustness")
def q_w2(spark, d):
    return rounded(gr.robustness_tables(spark, d)[2])


@register("pivot_ranked")
def q_w3(spark, d):
    return rk.pivot_ranked(gr.robustness_tables(spark, d)[2], gr.K_GENES)


@register("mean_top_k")
def q_a7(spark, d):
    return rounded(rk.mean_top_k(gr.robustness_tables(spark, d)[1], 100))


@register("min_rank_percentile")
def q_w4(spark, d):
    r = rk.min_rank_percentile(gr.robustness_tables(spark, d)[1])
    return rounded(r.select("compound", "gene", "robustness", "rank1", "n_candidates", "plot_position", "percentile"))


@register("target_rank_single")
def q_w5(spark, d):
    t = Tables(spark, d)
    r = rk.min_rank_percentile(gr.robustness_tables(spark, d)[1])
    return rounded(rk.target_rank_single(r, gr.single_targets(t), parts=fx.task_parts(t.lineitem)))


@register("target_rank_best")
def q_w6(spark, d):
    r = rk.min_rank_percentile(gr.robustness_tables(spark, d)[1])
    return rounded(rk.target_rank_best(r, fx.targets(Tables(spark, d)), missing="nan"))


@register("target_rank_best_worst")
def q_w6w(spark, d):
    r = rk.min_rank_percentile(gr.robustness_tables(spark, d)[1])
    return rounded(rk.target_rank_best(r, fx.targets(Tables(spark, d)), missing="worst"))


@register("best_target_position")
def q_w7(spark, d):
    t = Tables(spark, d)
    top = gr.robustness_tables(spark, d)[2]
    return rounded(rk.best_target_position(top, fx.targets(t), parts=fx.task_parts(t.lineitem)))


@register("case_insensitive_match")
def q_j9(spark, d):
    t = Tables(spark, d)
    top = gr.robustness_tables(spark, d)[2]
    return rk.best_target_position(top, fx.targets(t), parts=fx.task_parts(t.lineitem)).select("compound", "matched_compound", "note")


@register("knn_gene_ranking")
def q_knn_rank(spark, d):
    return rounded(rk.top_genes(gr.knn_robustness(spark, d), gr.K_GENES))


# ------------------------------------------------------ enrichment, conf --

from ..operators import enrichment as en  # noqa: E402
from . import confidence as cf  # noqa: E402


@register("load_gene_sets")
def q_s4(spark, d):
    return cf.gene_sets(Tables(spark, d))


@register("term_size_filter")
def q_e1(spark, d):
    t = Tables(spark, d)
    gs = cf.gene_sets(t)
    n_univ = en.gene_universe(gs).agg(F.count(F.lit(1))).scalar()
    return en.term_sizes(gs).withColumn("universe_size", n_univ)


@register("gene_term_overlap")
def q_j8(spark, d):
    return cf.overlap_report(Tables(spark, d))


@register("hypergeom_enrichment")
def q_e2(spark, d):
    best = cf.best_p(Tables(spark, d))
    return best.select("compound", "n", F.round(-F.log10(F.col("best_p")), 6).alias("neg_log10_p"), "has_result")


@register("bh_adjust")
def q_e3(spark, d):
    e = cf.enrichment(spark, d)
    return e.select("compound", F.round(-F.log10("best_p"), 6).alias("neg_log10_p"),
                    F.round(-F.log10("p_adj"), 6).alias("neg_log10_adj"))


@register("enrich_score")
def q_e4(spark, d):
    return rounded(cf.enrichment(spark, d).select("compound", "enrich_score_raw"))


@register("term_coverage_report")
def q_e21(spark, d):
    return rounded(en.coverage_report(cf.confidence_table(spark, d)))


@register("n_sigs_qc")
def q_a5(spark, d):
    return cf.confidence_table(spark, d).select("compound", "n_sigs")


@register("mean_tas")
def q_a6(spark, d):
    return rounded(cf.confidence_table(spark, d).select("compound", "mean_tas"))


@register("score_minmax")
def q_p12(spark, d):
    return rounded(cf.confidence_table(spark, d).select("compound", "score_n_sigs", "score_tas", "score_robustness"))


@register("score_max_scaled")
def q_p13(spark, d):
    return rounded(cf.confidence_table(spark, d).select("compound", "score_enrichment"))


@register("composite_score")
def q_p14(spark, d):
    return rounded(cf.confidence_table(spark, d))


# ------------------------------------------------------- permutation nulls --

from ..operators import nulls as nl  # noqa: E402

N_PERM_SINGLE = 200      # reference: panel D null
N_PERM_BEST = 2          # reference: panels E1/E2 null


@register("permute_labels")
def q_e13(spark, d):
    return nl.permute_labels(fx.ref_genes(Tables(spark, d)), N_PERM_BEST)


def _single(spark, d):
    return nl.shuffled_null_single(*gr.null_inputs(spark, d), gr.single_targets(Tables(spark, d)), N_PERM_SINGLE)


@register("shuffled_null_single")
def q_e14(spark, d):
    return rounded(_single(spark, d)[0])


@register("shuffled_null_single_p")
def q_e14p(spark, d):
    return rounded(_single(spark, d)[3])


def _best(spark, d):
    return nl.shuffled_null_best(*gr.null_inputs(spark, d), fx.targets(Tables(spark, d)), N_PERM_BEST)


@register("shuffled_null_best")
def q_e15(spark, d):
    return rounded(_best(spark, d)[0])


@register("empirical_p")
def q_e16(spark, d):
    return rounded(_best(spark, d)[3])


@register("cumulative_hit_curve")
def q_w12(spark, d):
    return rounded(nl.cumulative_hit_curve(_best(spark, d)[0], 100))


@register("cumulative_hit_curve_recovered")
def q_w12_recovered(spark, d):
    """The hit curve of the compounds whose known target was recovered."""
    r = gr.recovery(spark, d).filter("recover").select("compound")
    return rounded(nl.cumulative_hit_curve(_best(spark, d)[0], 100, selected=r))


@register("recover_flag")
def q_p15(spark, d):
    r = gr.recovery(spark, d)
    return rounded(r.select("compound", "composite_score", "robustness_rank", "recover"))


@register("mann_whitney_recover")
def q_e17_recover(spark, d):
    """Whether recovered compounds have the greater composite score."""
    r = gr.recovery(spark, d).select(F.round("composite_score", 9).alias("score"), "recover")
    return rounded(stats.mann_whitney_greater(r, "score", "recover").select("n1", "n2", "u", "z"))


@register("recover_calibration")
def q_e5_recover(spark, d):
    """Share of recovered compounds at or above each composite-score threshold."""
    r = gr.recovery(spark, d).select(F.round("composite_score", 9).alias("score"), "recover")
    return rounded(stats.accuracy_above_threshold(r, "score", "recover"))


def _score_calibration(spark, d):
    long = _conf_long(spark, d).select("metric", F.round("score", 9).alias("score"), "recover")
    return stats.accuracy_above_threshold(long, "score", "recover", by=["metric"])


@register("score_calibration")
def q_e5_scores(spark, d):
    """Share of recovered compounds above each threshold of the composite score
    and of the four scores it is made of."""
    return rounded(_score_calibration(spark, d))


@register("threshold_correlation")
def q_e6_scores(spark, d):
    """Whether that share rises with the threshold, score by score."""
    return rounded(stats.threshold_correlation(_score_calibration(spark, d), ["metric"]))


@register("recovery_split")
def q_e20(spark, d):
    r = gr.recovery(spark, d)
    n = r.agg(F.count(F.lit(1))).scalar()
    return rounded(r.groupBy("recover").agg(F.count(F.lit(1)).alias("n"))
                   .withColumn("pct", 100.0 * F.col("n") / n))


# ----------------------------------------------------- ingest, QC, prep --

from ..functions import labels as lb  # noqa: E402
from ..functions.vectors import clip_negative  # noqa: E402
from ..operators import clean as cl  # noqa: E402


def _expr(spark, d):
    return fx.expr_profiles(Tables(spark, d))


@register("landmark_filter")
def q_f1(spark, d):
    t = Tables(spark, d)
    return rounded(cl.landmark_filter(cl.to_long(fx.expr_profiles(t)), fx.gene_vocab(t)))


@register("clip_negative")
def q_f2(spark, d):
    e = _expr(spark, d).withColumn("expr", clip_negative("expr"))
    return rounded(cl.to_long(e))


@register("global_min_gate")
def q_a17(spark, d):
    e = _expr(spark, d)
    g = e.agg(F.min(F.array_min("expr")).alias("global_min"))
    return rounded(g.select("global_min", (F.col("global_min") < 0).alias("clipped")))


@register("drop_empty_profiles")
def q_f3(spark, d):
    e = cl.drop_empty_profiles(cl.global_min_gate(_expr(spark, d)))
    return rounded(e.select("sig_id", F.aggregate("expr", F.lit(0.0), lambda a, x: a + x).alias("total")))


@register("hq_signature_filter")
def q_f4(spark, d):
    return cl.hq_signature_filter(fx.signatures(Tables(spark, d))).select("sig_id")


@register("explode_instance_ids")
def q_f5(spark, d):
    return cl.explode_instance_ids(fx.signatures(Tables(spark, d)))


@register("hq_instances")
def q_f6(spark, d):
    t = Tables(spark, d)
    return cl.hq_instances(fx.signatures(t), fx.instances(t)).select("instance_id")


@register("map_tas_to_instances")
def q_f7(spark, d):
    t = Tables(spark, d)
    return cl.map_tas_to_instances(fx.signatures(t), fx.instances(t))


@register("clean_label_set")
def q_f8(spark, d):
    ls = fx.label_strings(Tables(spark, d))
    c = lb.clean_label_set("raw")
    return ls.select("pert_id", F.array_join(c, ";").alias("labels"), F.size(c).alias("n_labels"))


@register("label_set_split")
def q_f9(spark, d):
    ls = fx.label_strings(Tables(spark, d))
    c = F.array_sort(lb.label_set_split("raw", ";"))
    return ls.select("pert_id", F.array_join(c, "#").alias("items"), F.size(c).alias("n_items"))


@register("category_codes")
def q_f10(spark, d):
    p = fx.profiles(Tables(spark, d))
    return (cl.category_codes(cl.category_codes(p, "cmap_name", "drug_code"), "pert_type", "type_code")
            .select("sig_id", "drug_code", "type_code"))


@register("vocab_filter")
def q_f11(spark, d):
    t = Tables(spark, d)
    vocab = fx.gene_vocab(t).filter(F.col("feature_space") == "landmark")
    j = cl.vocab_filter(cl.to_long(fx.expr_profiles(t)), vocab)
    return rounded(j.filter(F.col("flag") == 1).select("sig_id", "pos", "value"))


@register("vocab_report")
def q_f11r(spark, d):
    t = Tables(spark, d)
    vocab = fx.gene_vocab(t).filter(F.col("feature_space") == "landmark")
    genes = fx.gene_vocab(t).select("pos")
    j = cl.vocab_filter(genes.withColumn("sig_id", F.lit(0)), vocab)
    return j.agg(F.sum(F.when(F.col("flag") == 1, 1).otherwise(0)).cast("long").alias("n_matched"),
                 F.count(F.lit(1)).alias("n_total"))


def _binned(spark, d):
    e = cl.global_min_gate(_expr(spark, d))
    return cl.bin_values(e.select("sig_id", "expr"), "expr", "binned", 51).select(
        "sig_id", F.col("binned").alias("expr"))


@register("value_binning")
def q_f12(spark, d):
    return cl.to_long(_binned(spark, d)).withColumnRenamed("value", "bin")


@register("tokenize_profile")
def q_f13(spark, d):
    return cl.tokenize(cl.to_long(_binned(spark, d)), 1000)


@register("random_value_mask")
def q_f14(spark, d):
    b = _binned(spark, d)
    m = b.select("sig_id", cl.random_value_mask(F.col("expr"), F.col("sig_id"), 0.0).alias("expr"))
    return cl.to_long(m)


@register("random_value_mask_share")
def q_f14_share(spark, d):
    m = _binned(spark, d).select("sig_id", cl.random_value_mask(F.col("expr"), F.col("sig_id"), 0.4).alias("expr"))
    return cl.to_long(m)


@register("tokenize_padded")
def q_f13_padded(spark, d):
    return cl.pad_tokens(cl.tokenize(cl.to_long(_binned(spark, d)), 40), 40)


@register("train_valid_split")
def q_f15(spark, d):
    return cl.train_valid_split(fx.profiles(Tables(spark, d)).select("sig_id"), "sig_id")


@register("group_holdout_split")
def q_f16(spark, d):
    return cl.group_holdout_split(fx.profiles(Tables(spark, d)).select("sig_id", "pert_id"), "pert_id")


@register("normalize_key")
def q_f18(spark, d):
    tg = fx.targets(Tables(spark, d))
    return tg.select("compound", lb.normalize_compound("compound").alias("compound_key"), "target",
                     lb.normalize_gene("target").alias("gene_key"))


@register("label_shortening")
def q_f22(spark, d):
    p = Tables(spark, d).part.select("p_type").distinct()
    return p.select("p_type", lb.shorten_label("p_type").alias("short"))


@register("concat_matrices")
def q_j6(spark, d):
    t = Tables(spark, d)
    a = fx.compound_profiles(t).select("sig_id", "pert_type")
    b = fx.knockdown_profiles(t).select("sig_id", "pert_type")
    return a.unionByName(b)


@register("concat_matrix_values")
def q_j6_values(spark, d):
    """Compounds lack the genes of every ninth position; knock-downs come in the
    opposite gene order and lack the first five."""
    t = Tables(spark, d)
    width = fx.gene_vocab(t).count()
    own = [i for i in range(width) if i % 9]
    other = list(range(width - 1, 4, -1))
    pick = lambda places: F.transform(F.array(*[F.lit(i) for i in places]), lambda i: F.get("expr", i)).alias("expr")
    e = fx.expr_profiles(t)
    sources = [(e.filter(F.col("pert_type") == kind).select("sig_id", pick(places)), [f"g{i}" for i in places])
               for kind, places in (("trt_cp", own), ("trt_sh", other))]
    rows, genes = cl.concat_matrices(sources)
    names = F.array(*[F.lit(g) for g in genes])
    return rounded(rows.select("sig_id", F.explode(F.arrays_zip(names.alias("gene"), F.col("expr").alias("value"))).alias("x"))
                   .select("sig_id", "x.gene", "x.value"))


@register("knn_graph_euclidean")
def q_v4_l2(spark, d):
    return rounded(knn_graph(fx.profiles(Tables(spark, d)), 15, metric="euclidean"))


# ------------------------------------------- files, written first, then read --

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import io  # noqa: E402


def _folder(spark, name: str) -> str:
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


@register("read_metadata_tsv")
def q_s1(spark, d):
    """Metadata written with another column order and one column more."""
    p = fx.profiles(Tables(spark, d)).select(
        "qc_pass", F.lit("unused").alias("note"),
        F.when(F.col("pert_id") % 7 == 0, "nan").otherwise(F.col("cmap_name")).alias("cmap_name"), "sig_id")
    path = _folder(spark, "metadata")
    p.write.option("sep", "\t").option("header", True).csv(path)
    return io.read_metadata_tsv(spark, path, ["sig_id", "cmap_name", "qc_pass"])


@register("read_compound_info")
def q_s2(spark, d):
    path = _folder(spark, "compounds")
    fx.compound_info(Tables(spark, d)).select("inchi_key", "pert_id").write.option("sep", "\t").option("header", True).csv(path)
    schema = T.StructType([T.StructField("pert_id", T.LongType()), T.StructField("inchi_key", T.StringType())])
    return io.read_compound_info(spark, path, schema, ["inchi_key"])


@register("read_gene_set_text")
def q_s4_text(spark, d):
    """Three libraries whose terms repeat; a later library replaces a term of an earlier one."""
    li = Tables(spark, d).lineitem.select(
        F.col("l_returnflag").alias("library"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("term"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene")).where("l_suppkey % 3 < 2 OR l_returnflag <> 'R'")
    lines = li.groupBy("library", "term").agg(F.collect_set("gene").alias("g")).select(
        "library", F.concat_ws("\t", "term", F.lit("na"), "g").alias("value"))
    paths = [(k, _folder(spark, f"library-{k}")) for k in ("A", "N", "R")]
    for k, path in paths:
        lines.filter(F.col("library") == k).select("value").write.text(path)
    return io.read_gmt(spark, paths)


@register("read_prior_results")
def q_s8(spark, d):
    """Label lists written as text and read back by name."""
    path = _folder(spark, "prior")
    moa = fx.pert_moa(Tables(spark, d)).groupBy("pert_id").agg(F.array_sort(F.collect_set("moa")).alias("moa"))
    io.write_csv(moa.select("moa", F.col("pert_id").alias("compound"), (F.col("pert_id") % 10 / 10).alias("conf")), path)
    schema = T.StructType([T.StructField("compound", T.LongType()), T.StructField("conf", T.DoubleType()),
                           T.StructField("moa", T.StringType())])
    back = io.read_prior_results(spark, path, schema, ["moa"])
    return rounded(back.select("compound", "conf", F.explode("moa").alias("moa")))


@register("write_neighbors")
def q_s6(spark, d):
    """The neighbour table written, not written again, and read back."""
    t = Tables(spark, d)
    path = _folder(spark, "neighbors")
    nb = cosine_knn(fx.compound_profiles(t), fx.knockdown_profiles(t), 10)
    io.write_neighbors(nb, path)
    io.write_neighbors(nb.limit(0), path)
    return rounded(spark.read.parquet(path).select("query_id", "rank", "ref_id", "distance"))


@register("range_histogram")
def q_a12_range(spark, d):
    c = fx.calibration(Tables(spark, d))
    return rounded(stats.range_histogram(c, "measure", 37))


@register("key_match_signatures")
def q_j7(spark, d):
    p = fx.profiles(Tables(spark, d))
    return cl.key_match_first(p, "cmap_name", "sig_id").select("cmap_name", "sig_id")


@register("read_profiles_subset")
def q_s5(spark, d):
    t = Tables(spark, d)
    keep = fx.signatures(t).select(F.col("sig_id").alias("s"))
    p = fx.profiles(t).filter((F.col("pert_type") == "trt_cp") & (F.col("qc_pass") == "1"))
    return p.join(keep, p.sig_id == keep.s, "left_semi").select("sig_id", "pert_id")


# ------------------------------------------------- pairs, AUROC, external --

from ..operators import pairs as prs  # noqa: E402
from . import recap as rc  # noqa: E402


@register("stratified_sample")
def q_w11(spark, d):
    return rc.sampled_knockdowns(Tables(spark, d)).select("seed", "pert_id", "sig_id")


@register("pairwise_cosine")
def q_v5(spark, d):
    p = rc.space_pairs(Tables(spark, d)).filter(F.col("space") == "embedding")
    return rounded(p.select("seed", "id_a", "id_b", "distance"))


@register("same_label_pairs")
def q_e9(spark, d):
    p = rc.space_pairs(Tables(spark, d)).filter(F.col("space") == "embedding")
    return p.select("seed", "id_a", "id_b", "same")


@register("repeated_auroc")
def q_e12(spark, d):
    return rounded(rc.repeated_auroc(Tables(spark, d)))


@register("percentile_positive")
def q_e8(spark, d):
    return rounded(rc.percentile_positive(Tables(spark, d)))


@register("harmonize_names")
def q_f17(spark, d):
    return rc.harmonized_external(Tables(spark, d)).select("sig_id", "treatment", "ref_name")


@register("cross_cosine")
def q_v6(spark, d):
    return rounded(rc.external_distances(Tables(spark, d)).select("id_a", "id_b", "distance"))


@register("chemical_auroc")
def q_e12_chemical(spark, d):
    return rounded(rc.chemical_auroc(Tables(spark, d)))


@register("target_profile_auroc")
def q_e12_target(spark, d):
    return rounded(rc.target_profile_auroc(Tables(spark, d)))


@register("background_vs_same")
def q_e19(spark, d):
    return rounded(rc.background_vs_same(Tables(spark, d)))


@register("argsort_unique_rank")
def q_w9(spark, d):
    return rounded(rc.unique_rank(Tables(spark, d)))


@register("best_example_per_group")
def q_w10(spark, d):
    return rounded(rc.best_example(rc.unique_rank(Tables(spark, d))))


@register("kde_grid")
def q_a16(spark, d):
    x = rc.external_distances(Tables(spark, d)).withColumn("set", F.when(F.col("same"), "same").otherwise("background"))
    return rounded(rc.kde_grid(x, "distance", "set", 200).select("set", "g", "x", "density"))


@register("ecdf_distances")
def q_a15(spark, d):
    x = rc.external_distances(Tables(spark, d)).withColumn("set", F.when(F.col("same"), "same").otherwise("background"))
    return rounded(stats.ecdf(x, "distance", by=["set"]))


# ------------------------------------------- fingerprints, embedding, LSH --

import numpy as np  # noqa: E402

from ..operators import cells  # noqa: E402
from ..operators import embed as emb  # noqa: E402


def _sampled_docs(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text", F.concat_ws("/", "source", "lang").alias("grp"))
    s = prs.stratified_sample(docs, "grp", "doc_id", 1, list(range(rc.N_SAMPLES)))
    return s.withColumn("bits", prs.fold_fingerprint(F.split(F.col("text"), " ")))


@register("tanimoto_distance")
def q_v7(spark, d):
    p = prs.tanimoto_pairs(_sampled_docs(spark, d), "doc_id", "bits", by=["seed"])
    return rounded(p.select("seed", "id_a", "id_b", "distance"))


@register("tanimoto_nearest")
def q_v7_all(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", prs.fold_fingerprint(F.split(F.col("text"), " ")).alias("bits"))
    nearest = prs.tanimoto_knn(docs.filter(F.col("doc_id") % 50 == 0), docs, 10, "doc_id", "bits")
    return rounded(nearest.select("query_id", "rank", "ref_id", "distance"))


def projection_weights(d_in: int = 64, d_out: int = 16) -> np.ndarray:
    """Deterministic stand-in weights: w[i, j] = ((7i + 3j) mod 11 - 5) / 10."""
    i = np.arange(d_in)[:, None]
    j = np.arange(d_out)[None, :]
    return ((7 * i + 3 * j) % 11 - 5) / 10.0


@register("batch_embed")
def q_v8(spark, d):
    p = fx.profiles(Tables(spark, d))
    weights = emb.ship_parameters(spark, weights=projection_weights())
    e = emb.batch_embed(p, "embedding", emb.linear_projection, 16, shipped=weights)
    return rounded(e.select("sig_id", F.posexplode("embedding").alias("pos", "value")))


@register("approx_knn_recall")
def q_v9(spark, d):
    t = Tables(spark, d)
    q, r = fx.compound_profiles(t), fx.knockdown_profiles(t)
    index = cells.fit_cells(r, 10)
    exact = cosine_knn(q, r, 10).select("query_id", "ref_id")
    approx = cells.approx_knn(q, r, 10, index=index).select("query_id", "ref_id")
    hits = exact.join(approx, ["query_id", "ref_id"], "left_semi").agg(F.count(F.lit(1))).scalar()
    n = exact.agg(F.count(F.lit(1))).scalar()
    return cells.compared_pairs(q, r, index).select(
        F.lit(10).alias("k"), (hits / n).alias("recall"), F.col("share").alias("compared_share"),
        F.lit(len(index.centres)).alias("n_cells"), F.lit(index.n_probe).alias("n_probe"))


# ------------------------------------------------------------- remaining --

from ..functions.vectors import l2_normalize  # noqa: E402
from ..operators.propagation import collapse_neighbors  # noqa: E402


@register("count_overlay")
def q_a10(spark, d):
    b = inference.benchmark_table(spark, d)
    o = stats.count_overlay(b, "top_moa", "top_conf", 0.25, 10)
    return rounded(o.withColumn("top_moa_short", lb.shorten_label("top_moa")))


@register("l2_normalize")
def q_v1(spark, d):
    p = fx.profiles(Tables(spark, d)).select("sig_id", l2_normalize("embedding").alias("v"))
    return rounded(p.select("sig_id", F.posexplode("v").alias("pos", "value")))


def _inf_collapsed(spark, d):
    t = Tables(spark, d)
    labels = inference._labels(t)
    query = fx.unannotated_profiles(t).select("sig_id", "pert_id", "embedding")
    ref = fx.annotated_profiles(t).select("sig_id", "pert_id", "embedding")
    nb = cosine_knn(query, ref, 50, group_col="pert_id")
    return nb, labels


@register("closest_per_group")
def q_w8(spark, d):
    nb, labels = _inf_collapsed(spark, d)
    lab = labels.select(F.col("group").alias("ref_group")).distinct()
    c = (nb.filter(F.col("rank") <= 50).join(lab, "ref_group", "left_semi")
         .groupBy("query_id", "ref_group").agg(F.min("distance").alias("distance")))
    return rounded(c)


@register("neighbor_weights")
def q_p1(spark, d):
    nb, labels = _inf_collapsed(spark, d)
    return rounded(collapse_neighbors(nb, labels, k_raw=50, weighting="softmax", temperature=0.07))


@register("lookup_left")
def q_j1(spark, d):
    t = Tables(spark, d)
    names = inference.true_label_sets(t)
    return fx.profiles(t).select("sig_id", "pert_id").join(names, "pert_id", "left").select("sig_id", "true_moa")


@register("read_matrix_subset")
def q_s3(spark, d):
    t = Tables(spark, d)
    sh = fx.expr_profiles(t).filter(F.col("pert_type") == "trt_sh")
    return rounded(cl.landmark_filter(cl.to_long(sh), fx.gene_vocab(t)))


_SCORE_COLS = ["score_n_sigs", "score_tas", "score_enrichment", "score_robustness", "composite_score"]


def _conf_long(spark, d):
    r = gr.recovery(spark, d).select("compound", "recover", *_SCORE_COLS)
    return r.unpivot(["compound", "recover"], _SCORE_COLS, "metric", "score").filter(F.col("score").isNotNull())


@register("unpivot_conf_scores")
def q_a14c(spark, d):
    return rounded(_conf_long(spark, d))


@register("score_box_summary")
def q_a13c(spark, d):
    return rounded(stats.five_number_summary(_conf_long(spark, d), "score", ["metric", "recover"]))
