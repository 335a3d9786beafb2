"""Oracle SQL per registered key (DuckDB dialect)."""

from __future__ import annotations

from .duck import build, cte, rnd

SQL: dict[str, str] = {}

# ------------------------------------------------------------------ kNN --
cte("unit_vec_cp", """
  SELECT sig_id, pert_id, CASE WHEN nrm = 0 THEN v ELSE list_transform(v, lambda x: x / nrm) END AS v
  FROM (SELECT sig_id, pert_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm
        FROM (SELECT sig_id, pert_id, embedding::DOUBLE[] AS v FROM cp_profiles))""", "cp_profiles")
cte("unit_vec_all", """
  SELECT sig_id, pert_id, pert_type, CASE WHEN nrm = 0 THEN v ELSE list_transform(v, lambda x: x / nrm) END AS v
  FROM (SELECT sig_id, pert_id, pert_type, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm
        FROM (SELECT sig_id, pert_id, pert_type, embedding::DOUBLE[] AS v FROM profiles))""", "profiles")


def knn_sql(q_from: str, r_from: str, k: int, where: str = "") -> str:
    return f"""
  SELECT query_id, ref_id, query_group, ref_group, distance,
         row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank
  FROM (SELECT q.sig_id AS query_id, r.sig_id AS ref_id, q.pert_id AS query_group, r.pert_id AS ref_group,
               1 - list_inner_product(q.v, r.v) AS distance
        FROM ({q_from}) q, ({r_from}) r {where})
  QUALIFY rank <= {k}"""


cte("nb_cp_sh", knn_sql("SELECT * FROM unit_vec_all WHERE pert_type = 'trt_cp'",
                        "SELECT * FROM unit_vec_all WHERE pert_type = 'trt_sh'", 10), "unit_vec_all")
SQL["cosine_knn"] = build(f"""
SELECT query_id, rank, ref_id, {rnd('distance', 'distance')} FROM nb_cp_sh""", "nb_cp_sh")

cte("nb_loo10", knn_sql("SELECT * FROM unit_vec_cp WHERE pert_id IN (SELECT pert_id FROM pert_moa)",
                        "SELECT * FROM unit_vec_cp WHERE pert_id IN (SELECT pert_id FROM pert_moa)", 10,
                        "WHERE q.pert_id <> r.pert_id"), "unit_vec_cp", "pert_moa")
SQL["cosine_knn_excluding_group"] = build(f"""
SELECT query_id, rank, ref_id, ref_group, {rnd('distance', 'distance')} FROM nb_loo10""", "nb_loo10")

cte("nb_graph", knn_sql("SELECT * FROM unit_vec_all", "SELECT * FROM unit_vec_all", 15,
                        "WHERE q.sig_id <> r.sig_id"), "unit_vec_all")
SQL["knn_graph"] = build(f"""
SELECT query_id, rank, ref_id, {rnd('distance', 'distance')} FROM nb_graph""", "nb_graph")


# ---------------------------------------------------------- propagation --
def propagation_ctes(prefix: str, nb: str, samples: str, k_raw: int = 50, weighting: str = "softmax",
                     temperature: float = 0.07, mode: str = "closest", min_unique: int = 3,
                     samples_deps: tuple[str, ...] = ("unann_profiles",)) -> str:
    """Registers CTEs <prefix>_sample_top, <prefix>_compound_top; returns last name."""
    t = max(temperature, 1e-8)

    def weight(d: str, part: str) -> str:
        if weighting == "uniform":
            return "1.0"
        if weighting == "inverse":
            return f"1.0 / (greatest({d}, 0.0) + 1e-8)"
        return f"exp(-{d} / {t!r} - max(-{d} / {t!r}) OVER (PARTITION BY {part}))"

    p = prefix
    cte(f"{p}_nl", f"""
  SELECT * FROM {nb} WHERE rank <= {k_raw} AND ref_group IN (SELECT pert_id FROM pert_moa)""", nb, "pert_moa")
    if mode == "closest":
        cte(f"{p}_cmp0", f"SELECT query_id, ref_group, min(distance) AS d FROM {p}_nl GROUP BY query_id, ref_group",
            f"{p}_nl")
        cte(f"{p}_cmp1", f"SELECT query_id, ref_group, {weight('d', 'query_id')} AS e FROM {p}_cmp0", f"{p}_cmp0")
    else:
        cte(f"{p}_s0", f"SELECT query_id, ref_group, {weight('distance', 'query_id')} AS e0 FROM {p}_nl", f"{p}_nl")
        cte(f"{p}_s1", f"""
  SELECT query_id, ref_group, e0 / (sum(e0) OVER (PARTITION BY query_id) + 1e-12) AS ws FROM {p}_s0""", f"{p}_s0")
        cte(f"{p}_cmp1", f"SELECT query_id, ref_group, sum(ws) AS e FROM {p}_s1 GROUP BY query_id, ref_group",
            f"{p}_s1")
    cte(f"{p}_coll_all", f"""
  SELECT query_id, ref_group, e / (sum(e) OVER (PARTITION BY query_id) + 1e-12) AS w,
         count(*) OVER (PARTITION BY query_id) AS n_unique
  FROM {p}_cmp1""", f"{p}_cmp1")
    cte(f"{p}_coll", f"SELECT * FROM {p}_coll_all WHERE n_unique >= {min_unique}", f"{p}_coll_all")
    cte(f"{p}_raw", f"""
  SELECT c.query_id, m.moa AS label, sum(c.w / n.n) AS raw
  FROM {p}_coll c JOIN (SELECT pert_id, count(*) AS n FROM pert_moa GROUP BY pert_id) n ON n.pert_id = c.ref_group
  JOIN pert_moa m ON m.pert_id = c.ref_group
  GROUP BY c.query_id, m.moa""", f"{p}_coll", "pert_moa")
    cte(f"{p}_sp", f"""
  SELECT query_id, label, raw / (sum(raw) OVER (PARTITION BY query_id) + 1e-12) AS p FROM {p}_raw""", f"{p}_raw")
    cte(f"{p}_stied", f"""
  SELECT query_id, label, mx FROM (SELECT *, max(p) OVER (PARTITION BY query_id) AS mx FROM {p}_sp)
  WHERE abs(p - mx) <= 1e-8 + 1e-5 * abs(mx)""", f"{p}_sp")
    cte(f"{p}_sbest", f"""
  SELECT query_id, string_agg(label, ';' ORDER BY label) AS top_moa, max(mx) AS top_conf
  FROM {p}_stied GROUP BY query_id""", f"{p}_stied")
    cte(f"{p}_support", f"""
  SELECT query_id, count(*) AS cnt, sum(w) AS wsum FROM (
    SELECT DISTINCT c.query_id, c.ref_group, c.w
    FROM {p}_coll c JOIN pert_moa m ON m.pert_id = c.ref_group
    JOIN {p}_stied s ON s.query_id = c.query_id AND s.label = m.moa)
  GROUP BY query_id""", f"{p}_coll", f"{p}_stied", "pert_moa")
    cte(f"{p}_samples", samples, *samples_deps)
    cte(f"{p}_sample_top", f"""
  SELECT s.query_id, s.query_group, b.top_moa, coalesce(b.top_conf, 0.0) AS top_conf,
         coalesce(u.n_unique, 0) AS n_unique_ref_compounds,
         coalesce(su.cnt, 0) AS support_top_moa_count, coalesce(su.wsum, 0.0) AS support_top_moa_weight,
         b.top_moa IS NULL AS abstained
  FROM {p}_samples s
  LEFT JOIN {p}_sbest b ON b.query_id = s.query_id
  LEFT JOIN (SELECT query_id, max(n_unique) AS n_unique FROM {p}_coll_all GROUP BY query_id) u ON u.query_id = s.query_id
  LEFT JOIN {p}_support su ON su.query_id = s.query_id""", f"{p}_samples", f"{p}_sbest", f"{p}_coll_all", f"{p}_support")
    cte(f"{p}_cp", f"""
  SELECT s.query_group, sp.label, sum(sp.p) / max(n.n_samples) AS p
  FROM {p}_sp sp JOIN {p}_samples s ON s.query_id = sp.query_id
  JOIN (SELECT query_group, count(*) AS n_samples FROM {p}_samples GROUP BY query_group) n
    ON n.query_group = s.query_group
  GROUP BY s.query_group, sp.label""", f"{p}_sp", f"{p}_samples")
    cte(f"{p}_ctied", f"""
  SELECT query_group, label, mx FROM (SELECT *, max(p) OVER (PARTITION BY query_group) AS mx FROM {p}_cp)
  WHERE abs(p - mx) <= 1e-8 + 1e-5 * abs(mx)""", f"{p}_cp")
    cte(f"{p}_compound_top", f"""
  SELECT a.query_group, b.top_moa, coalesce(b.top_conf, 0.0) AS top_conf, a.agreement, a.n_samples,
         a.mean_unique_ref_compounds, a.mean_support_top_moa_count, a.mean_support_top_moa_weight, a.n_abstained
  FROM (
    SELECT st.query_group,
           avg(CASE WHEN st.abstained OR ov.query_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS agreement,
           count(*) AS n_samples,
           avg(st.n_unique_ref_compounds) AS mean_unique_ref_compounds,
           avg(st.support_top_moa_count) AS mean_support_top_moa_count,
           avg(st.support_top_moa_weight) AS mean_support_top_moa_weight,
           sum(CASE WHEN st.abstained THEN 1 ELSE 0 END) AS n_abstained
    FROM {p}_sample_top st
    LEFT JOIN (SELECT DISTINCT s.query_id FROM {p}_stied s JOIN {p}_samples sm ON sm.query_id = s.query_id
               JOIN {p}_ctied c ON c.query_group = sm.query_group AND c.label = s.label) ov
      ON ov.query_id = st.query_id
    GROUP BY st.query_group) a
  LEFT JOIN (SELECT query_group, string_agg(label, ';' ORDER BY label) AS top_moa, max(mx) AS top_conf
             FROM {p}_ctied GROUP BY query_group) b ON a.query_group = b.query_group""",
        f"{p}_sample_top", f"{p}_stied", f"{p}_samples", f"{p}_ctied")
    return f"{p}_compound_top"


cte("nb_inf", knn_sql("SELECT * FROM unit_vec_cp WHERE pert_id NOT IN (SELECT pert_id FROM pert_moa)",
                      "SELECT * FROM unit_vec_cp WHERE pert_id IN (SELECT pert_id FROM pert_moa)", 50),
    "unit_vec_cp", "pert_moa")
propagation_ctes("inf", "nb_inf",
                 "SELECT sig_id AS query_id, pert_id AS query_group FROM unann_profiles")
CTES_NEED_INF = ("inf_compound_top", "unann_profiles", "cp_profiles")

COMPOUND_TOP_COLS = (f"top_moa, {rnd('top_conf', 'top_conf')}, {rnd('agreement', 'agreement')}, "
                     f"CAST(n_samples AS BIGINT) AS n_samples, "
                     f"{rnd('mean_unique_ref_compounds', 'mean_unique_ref_compounds')}, "
                     f"{rnd('mean_support_top_moa_count', 'mean_support_top_moa_count')}, "
                     f"{rnd('mean_support_top_moa_weight', 'mean_support_top_moa_weight')}, "
                     f"CAST(n_abstained AS BIGINT) AS n_abstained")

SQL["moa_inference"] = build(f"""
SELECT c.query_group AS pert_id, n.cmap_name, {COMPOUND_TOP_COLS}
FROM inf_compound_top c
LEFT JOIN (SELECT pert_id, min(cmap_name) AS cmap_name FROM cp_profiles GROUP BY pert_id) n
  ON n.pert_id = c.query_group
WHERE c.mean_support_top_moa_count <> 0""", "inf_compound_top", "cp_profiles")

SQL["sample_top"] = build(f"""
SELECT query_id AS sig_id, query_group AS pert_id, top_moa, {rnd('top_conf', 'top_conf')},
       CAST(n_unique_ref_compounds AS BIGINT) AS n_unique_ref_compounds,
       CAST(support_top_moa_count AS BIGINT) AS support_top_moa_count,
       {rnd('support_top_moa_weight', 'support_top_moa_weight')}
FROM inf_sample_top""", "inf_sample_top")

SQL["sample_probs"] = build(f"""
SELECT query_id AS sig_id, label AS moa, {rnd('p', 'p')} FROM inf_sp""", "inf_sp")

SQL["compound_probs"] = build(f"""
SELECT query_group AS pert_id, label AS moa, {rnd('p', 'p')} FROM inf_cp""", "inf_cp")

SQL["high_confidence"] = build(f"""
SELECT c.query_group AS pert_id, {COMPOUND_TOP_COLS}
FROM inf_compound_top c
WHERE c.mean_support_top_moa_count <> 0 AND c.top_conf > 0.25""", "inf_compound_top")

# closest collapse with the other two weightings, and the 'sum' collapse
for _w in ("uniform", "inverse"):
    propagation_ctes(f"inf_{_w}", "nb_inf",
                     "SELECT sig_id AS query_id, pert_id AS query_group FROM unann_profiles", weighting=_w)
    SQL[f"moa_inference_{_w}"] = build(f"""
SELECT query_group AS pert_id, {COMPOUND_TOP_COLS} FROM inf_{_w}_compound_top""", f"inf_{_w}_compound_top")
propagation_ctes("inf_sum", "nb_inf",
                 "SELECT sig_id AS query_id, pert_id AS query_group FROM unann_profiles", mode="sum")
SQL["moa_inference_sum"] = build(f"""
SELECT query_group AS pert_id, {COMPOUND_TOP_COLS} FROM inf_sum_compound_top""", "inf_sum_compound_top")


# ------------------------------------------------------ benchmark, E5.. --
cte("nb_loo50", knn_sql("SELECT * FROM unit_vec_cp WHERE pert_id IN (SELECT pert_id FROM pert_moa)",
                        "SELECT * FROM unit_vec_cp WHERE pert_id IN (SELECT pert_id FROM pert_moa)", 50,
                        "WHERE q.pert_id <> r.pert_id"), "unit_vec_cp", "pert_moa")
propagation_ctes("loo", "nb_loo50", "SELECT sig_id AS query_id, pert_id AS query_group FROM ann_profiles",
                 samples_deps=("ann_profiles",))
cte("prevalent", """
  SELECT DISTINCT pert_id FROM pert_moa
  WHERE moa IN (SELECT moa FROM pert_moa GROUP BY moa HAVING count(*) > 1)""", "pert_moa")
cte("true_sets", "SELECT pert_id, string_agg(moa, ';' ORDER BY moa) AS true_moa FROM pert_moa GROUP BY pert_id",
    "pert_moa")
cte("bench", """
  SELECT c.*, t.true_moa,
         coalesce(len(list_intersect(CASE WHEN c.top_moa IS NULL OR c.top_moa = '' THEN []::VARCHAR[]
                                          ELSE string_split(c.top_moa, ';') END,
                                     CASE WHEN t.true_moa IS NULL OR t.true_moa = '' THEN []::VARCHAR[]
                                          ELSE string_split(t.true_moa, ';') END)) > 0, false) AS is_true
  FROM loo_compound_top c LEFT JOIN true_sets t ON t.pert_id = c.query_group
  WHERE c.query_group IN (SELECT pert_id FROM prevalent)""", "loo_compound_top", "true_sets", "prevalent")

SQL["keep_prevalent_labels"] = build("SELECT pert_id FROM prevalent", "prevalent")
SQL["labels_per_pert"] = build("""
SELECT pert_id, string_agg(moa, ';' ORDER BY moa) AS moas, count(*) AS n_moas
FROM (SELECT DISTINCT pert_id, moa FROM pert_moa) GROUP BY pert_id""", "pert_moa")
SQL["loo_benchmark"] = build(f"""
SELECT query_group AS pert_id, {COMPOUND_TOP_COLS}, true_moa, is_true FROM bench""", "bench")


def thresholds_sql(src: str, measure: str, truth: str) -> str:
    return f"""
SELECT {rnd('r.i * 0.05::DOUBLE', 'threshold')},
       CAST(count(s.m) AS BIGINT) AS n_compounds,
       {rnd('CASE WHEN count(s.m) > 0 THEN sum(CASE WHEN s.t THEN 1 ELSE 0 END) * 100.0 / count(s.m) END', 'pct_true')},
       CAST(coalesce(sum(CASE WHEN s.t THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_compounds_true
FROM range(21) r(i)
LEFT JOIN (SELECT {measure} AS m, {truth} AS t FROM {src} WHERE {measure} IS NOT NULL) s
  ON s.m >= r.i * 0.05::DOUBLE
GROUP BY r.i"""


SQL["accuracy_above_threshold"] = build(thresholds_sql("bench", "top_conf", "is_true"), "bench")
SQL["calibration_accuracy"] = build(thresholds_sql("calibration", "measure", "truth"), "calibration")

cte("ref_props", """
  SELECT moa, count(*) AS n, count(*) / sum(count(*)) OVER () AS proportion FROM pert_moa GROUP BY moa""",
    "pert_moa")
SQL["value_counts"] = build(f"""
SELECT moa, CAST(n AS BIGINT) AS n, {rnd('proportion', 'proportion')} FROM ref_props""", "ref_props")
cte("inf_annot", "SELECT * FROM inf_compound_top WHERE mean_support_top_moa_count <> 0", "inf_compound_top")
cte("pred_props", """
  SELECT moa, sum(w) / (SELECT count(*) FROM (SELECT list_filter(list_transform(string_split(top_moa, ';'),
                                                               lambda x: trim(x)), lambda x: x <> '') AS it
                                              FROM inf_annot WHERE top_moa IS NOT NULL) WHERE len(it) > 0) AS proportion
  FROM (SELECT unnest(it) AS moa, 1.0 / len(it) AS w
        FROM (SELECT list_filter(list_transform(string_split(top_moa, ';'), lambda x: trim(x)), lambda x: x <> '') AS it
              FROM inf_annot WHERE top_moa IS NOT NULL) WHERE len(it) > 0)
  GROUP BY moa""", "inf_annot")
SQL["fractional_proportions"] = build(f"SELECT moa, {rnd('proportion', 'proportion')} FROM pred_props", "pred_props")
cte("aligned", """
  SELECT a.moa, a.proportion AS ref_prop, b.proportion AS pred_prop
  FROM ref_props a JOIN pred_props b ON a.moa = b.moa""", "ref_props", "pred_props")
SQL["align_proportions"] = build(f"""
SELECT moa, {rnd('ref_prop', 'ref_prop')}, {rnd('pred_prop', 'pred_prop')} FROM aligned""", "aligned")
cte("aligned_ranks", """
  SELECT rank() OVER (ORDER BY ref_prop) + (count(*) OVER (PARTITION BY ref_prop) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY pred_prop) + (count(*) OVER (PARTITION BY pred_prop) - 1) / 2.0 AS ry
  FROM aligned""", "aligned")
SQL["spearman"] = build(f"""
SELECT CAST(n AS BIGINT) AS n, {rnd('rho', 'rho')},
       {rnd('CASE WHEN n > 2 AND abs(rho) < 1 THEN rho * sqrt((n - 2) / (1 - rho * rho)) END', 't')}
FROM (SELECT count(*) AS n, corr(rx, ry) AS rho FROM aligned_ranks)""", "aligned_ranks")
SQL["proportion_abs_diff"] = build(f"""
SELECT moa, {rnd('ref_prop', 'ref_prop')}, {rnd('pred_prop', 'pred_prop')}, {rnd('abs(ref_prop - pred_prop)', 'abs_diff')}
FROM aligned ORDER BY abs(ref_prop - pred_prop) DESC, moa LIMIT 15""", "aligned")

SQL["group_summary"] = build(f"""
SELECT lang, count(measure) AS n, {rnd('quantile_cont(measure, 0.5)', 'median')}, {rnd('avg(measure)', 'mean')}
FROM calibration GROUP BY lang""", "calibration")
SQL["histogram"] = build(f"""
SELECT CAST(b.i AS INTEGER) AS bin, {rnd('b.i * 0.05', 'left')}, {rnd('(b.i + 1) * 0.05', 'right')},
       CAST(count(c.bin) AS BIGINT) AS count
FROM range(20) b(i)
LEFT JOIN (SELECT least(19, (SELECT count(*) FROM range(21) e(j) WHERE j * 0.05::DOUBLE <= m.measure) - 1) AS bin
           FROM calibration m WHERE m.measure >= 0 AND m.measure <= 1) c ON c.bin = b.i
GROUP BY b.i""", "calibration")
SQL["five_number_summary"] = build(f"""
SELECT q.lang, q.truth, {rnd('q1', 'q1')}, {rnd('median', 'median')}, {rnd('q3', 'q3')}, CAST(q.n AS BIGINT) AS n,
       {rnd('max(CASE WHEN c.measure <= q3 + 1.5 * (q3 - q1) THEN c.measure END)', 'whisker_high')},
       {rnd('min(CASE WHEN c.measure >= q1 - 1.5 * (q3 - q1) THEN c.measure END)', 'whisker_low')}
FROM (SELECT lang, CAST(truth AS VARCHAR) AS truth, quantile_cont(measure, 0.25) AS q1,
             quantile_cont(measure, 0.5) AS median, quantile_cont(measure, 0.75) AS q3, count(measure) AS n
      FROM calibration GROUP BY ALL) q
JOIN calibration c ON c.lang = q.lang AND CAST(c.truth AS VARCHAR) = q.truth
GROUP BY q.lang, q.truth, q.q1, q.median, q.q3, q.n""", "calibration")
SQL["unpivot_scores"] = build(f"""
SELECT doc_id, metric, {rnd('score', 'score')} FROM (
  SELECT doc_id, 'measure' AS metric, measure AS score FROM calibration
  UNION ALL SELECT doc_id, 'inverse', 1 - measure FROM calibration
  UNION ALL SELECT doc_id, 'measure_if_true', CASE WHEN truth THEN measure END FROM calibration)
WHERE score IS NOT NULL""", "calibration")
cte("cal_sc", """
  SELECT measure AS s, sum(CASE WHEN truth THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN truth THEN 0 ELSE 1 END) AS neg
  FROM calibration WHERE measure IS NOT NULL GROUP BY measure""", "calibration")
SQL["roc_curve"] = build(f"""
SELECT {rnd('s', 'threshold')},
       {rnd('sum(pos) OVER (ORDER BY s DESC) / sum(pos) OVER ()', 'tpr')},
       {rnd('sum(neg) OVER (ORDER BY s DESC) / sum(neg) OVER ()', 'fpr')}
FROM cal_sc""", "cal_sc")
SQL["roc_auc"] = build(f"""
SELECT CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg,
       {rnd('CASE WHEN P > 0 AND N > 0 THEN (rpos - P * (P + 1) / 2.0) / (P * N) END', 'auroc')}
FROM (SELECT sum(pos * (before + (pos + neg + 1) / 2.0)) AS rpos, sum(pos) AS P, sum(neg) AS N
      FROM (SELECT *, coalesce(sum(pos + neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                      AS before FROM cal_sc))""", "cal_sc")
SQL["mann_whitney_greater"] = build(f"""
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       {rnd('CASE WHEN n1 > 0 AND n2 > 0 THEN u END', 'u')},
       {rnd('CASE WHEN n1 > 0 AND n2 > 0 AND sigma > 0 THEN (u - n1 * n2 / 2.0 - 0.5) / sigma END', 'z')}
FROM (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u,
             sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sigma
      FROM (SELECT sum(pos * (before + (pos + neg + 1) / 2.0)) AS r1, sum(pos) AS n1, sum(neg) AS n2,
                   sum(power(pos + neg, 3) - (pos + neg)) AS tie
            FROM (SELECT *, coalesce(sum(pos + neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                            AS before FROM cal_sc)))""", "cal_sc")
SQL["ecdf"] = build(f"""
SELECT {rnd('s', 'measure')}, {rnd('sum(pos + neg) OVER (ORDER BY s) / sum(pos + neg) OVER ()', 'ecdf')}
FROM cal_sc""", "cal_sc")
cte("nb_graph1", knn_sql("SELECT * FROM unit_vec_all", "SELECT * FROM unit_vec_all", 1,
                         "WHERE q.sig_id <> r.sig_id"), "unit_vec_all")
cte("predictions", """
  SELECT n.query_id, a.label AS truth, b.label AS prediction
  FROM nb_graph1 n JOIN profiles a ON a.sig_id = n.query_id JOIN profiles b ON b.sig_id = n.ref_id""",
    "nb_graph1", "profiles")
SQL["classification_metrics"] = build(f"""
WITH_PLACEHOLDER""", "predictions")
SQL["classification_metrics"] = SQL["classification_metrics"].replace("WITH_PLACEHOLDER", f"""
SELECT CAST(sum(n_true) AS BIGINT) AS n, {rnd('sum(tp) / sum(n_true)', 'accuracy')},
       {rnd('1 - sum(tp) / sum(n_true)', 'error_rate')},
       {rnd('avg(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END)', 'macro_precision')},
       {rnd('avg(CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END)', 'macro_recall')},
       {rnd('avg(CASE WHEN tp > 0 THEN 2.0 * (tp / n_pred) * (tp / n_true) / (tp / n_pred + tp / n_true) ELSE 0.0 END)', 'macro_f1')}
FROM (SELECT c.cls, coalesce(t.n, 0) AS n_true, coalesce(p.n, 0) AS n_pred, coalesce(k.n, 0) AS tp
      FROM (SELECT truth AS cls FROM predictions UNION SELECT prediction FROM predictions) c
      LEFT JOIN (SELECT truth AS cls, count(*) AS n FROM predictions GROUP BY 1) t ON t.cls = c.cls
      LEFT JOIN (SELECT prediction AS cls, count(*) AS n FROM predictions GROUP BY 1) p ON p.cls = c.cls
      LEFT JOIN (SELECT truth AS cls, count(*) AS n FROM predictions WHERE truth = prediction GROUP BY 1) k
        ON k.cls = c.cls)""")


# ---------------------------------------------------------- gene ranking --
cte("w1", """
  SELECT cp_sig, compound, gene, pos FROM (
    SELECT cp_sig, compound, gene, row_number() OVER (PARTITION BY cp_sig ORDER BY first_rank) AS pos
    FROM (SELECT cp_sig, compound, gene, min(rank) AS first_rank FROM ranked_hits
          WHERE gene IS NOT NULL GROUP BY cp_sig, compound, gene))
  WHERE pos <= 100""", "ranked_hits")
cte("a3", """
  SELECT compound, count(*) AS n_cp_sigs FROM cp_signatures WHERE compound IS NOT NULL GROUP BY compound""",
    "cp_signatures")
cte("cg", """
  SELECT s.compound, s.gene, s.n_support, a.n_cp_sigs, s.n_support / a.n_cp_sigs AS robustness
  FROM (SELECT compound, gene, count(DISTINCT cp_sig) AS n_support FROM w1 GROUP BY compound, gene) s
  LEFT JOIN a3 a ON a.compound = s.compound""", "w1", "a3")
cte("top_long", """
  SELECT compound, rank, gene, robustness FROM (
    SELECT *, row_number() OVER (PARTITION BY compound ORDER BY robustness DESC, gene) AS rank FROM cg)
  WHERE rank <= 100""", "cg")
cte("mrp", """
  SELECT *, CASE WHEN n_candidates = 1 THEN 100.0
                 ELSE 100.0 * (1.0 - (rank1 - 1) / (n_candidates - 1.0)) END AS percentile
  FROM (SELECT compound, gene, robustness,
               rank() OVER (PARTITION BY compound ORDER BY robustness DESC) AS rank1,
               count(*) OVER (PARTITION BY compound) AS n_candidates,
               row_number() OVER (PARTITION BY compound ORDER BY robustness DESC, gene) - 1 AS plot_position
        FROM cg)""", "cg")

SQL["topk_unique_per_row"] = build("SELECT cp_sig, compound, gene, pos FROM w1", "w1")
SQL["support_counts"] = build("""
SELECT compound, gene, count(DISTINCT cp_sig) AS n_support FROM w1 GROUP BY compound, gene""", "w1")
SQL["signatures_per_compound"] = build("SELECT compound, n_cp_sigs FROM a3", "a3")
SQL["robustness"] = build(f"""
SELECT compound, gene, n_support, n_cp_sigs, {rnd('robustness', 'robustness')} FROM cg""", "cg")
SQL["top_genes_by_robustness"] = build(f"""
SELECT compound, rank, gene, {rnd('robustness', 'robustness')} FROM top_long""", "top_long")
SQL["pivot_ranked"] = build("SELECT compound, " + ", ".join(
    f"max(CASE WHEN rank = {i} THEN gene END) AS gene_{i}" for i in range(1, 101))
    + " FROM top_long GROUP BY compound", "top_long")
SQL["mean_top_k"] = build(f"""
SELECT compound, {rnd('avg(robustness)', 'robustness_100')} FROM (
  SELECT *, row_number() OVER (PARTITION BY compound ORDER BY robustness DESC, gene) AS r FROM cg)
WHERE r <= 100 GROUP BY compound""", "cg")
SQL["min_rank_percentile"] = build(f"""
SELECT compound, gene, {rnd('robustness', 'robustness')}, rank1, n_candidates, plot_position,
       {rnd('percentile', 'percentile')} FROM mrp""", "mrp")
SQL["target_rank_single"] = build(f"""
SELECT n.compound, t.target AS target_gene, m.rank1 IS NOT NULL AS found, m.rank1 - 1 AS rank0, m.rank1,
       {rnd('m.percentile', 'percentile')}, n.n_candidates, {rnd('m.robustness', 'value')}
FROM (SELECT compound, max(n_candidates) AS n_candidates FROM mrp GROUP BY compound) n
JOIN (SELECT compound, target FROM targets WHERE target_order = 1) t ON t.compound = n.compound
LEFT JOIN mrp m ON m.compound = n.compound AND m.gene = t.target""", "mrp", "targets")


def _w6(missing: str) -> str:
    worst = missing == "worst"
    r1 = ("CASE WHEN b.rank1 IS NOT NULL THEN b.rank1 WHEN n.n_candidates IS NOT NULL THEN n.n_candidates + 1 END"
           if worst else "b.rank1")
    pc = ("CASE WHEN b.rank1 IS NOT NULL THEN b.percentile WHEN n.n_candidates IS NOT NULL THEN 0.0 END"
          if worst else "b.percentile")
    return build(f"""
SELECT i.compound, b.gene AS target_gene, b.rank1 IS NOT NULL AS found, ({r1}) - 1 AS rank0, {r1} AS rank1,
       {rnd(pc, 'percentile')}, CAST(coalesce(n.n_candidates, 0) AS BIGINT) AS n_candidates, i.n_targets_input,
       CAST(coalesce(b.n_found, 0) AS BIGINT) AS n_targets_found, {rnd('b.robustness', 'value')}
FROM (SELECT compound, count(*) AS n_targets_input FROM targets WHERE target IS NOT NULL GROUP BY compound) i
LEFT JOIN (SELECT compound, max(n_candidates) AS n_candidates FROM mrp GROUP BY compound) n ON n.compound = i.compound
LEFT JOIN (SELECT * FROM (
             SELECT m.compound, m.gene, m.rank1, m.percentile, m.robustness,
                    count(*) OVER (PARTITION BY m.compound) AS n_found,
                    row_number() OVER (PARTITION BY m.compound ORDER BY m.rank1, m.robustness DESC, m.gene) AS rn
             FROM mrp m JOIN targets t ON t.compound = m.compound AND t.target = m.gene)
           WHERE rn = 1) b ON b.compound = i.compound""", "mrp", "targets")


SQL["target_rank_best"] = _w6("nan")
SQL["target_rank_best_worst"] = _w6("worst")

cte("w7_t", """
  SELECT DISTINCT compound, lower(trim(compound)) AS key, upper(trim(target)) AS tnorm
  FROM targets WHERE target IS NOT NULL""", "targets")
cte("w7_names", "SELECT lower(trim(compound)) AS key, max(compound) AS matched_compound FROM top_long GROUP BY 1",
    "top_long")
cte("w7_tl", """
  SELECT t.compound AS matched_compound, lower(trim(t.compound)) AS key, t.rank, t.gene, upper(trim(t.gene)) AS gnorm
  FROM top_long t JOIN w7_names n ON n.key = lower(trim(t.compound)) AND n.matched_compound = t.compound
  WHERE t.gene IS NOT NULL AND t.rank <= 100""", "top_long", "w7_names")
cte("w7", """
  SELECT k.compound, n.matched_compound, k.n_known_targets, p.n_pred,
         o.n_overlap, o.best_target_rank, o.best_target_gene, o.overlapping_targets
  FROM (SELECT compound, key, count(*) AS n_known_targets FROM w7_t GROUP BY compound, key) k
  LEFT JOIN w7_names n ON n.key = k.key
  LEFT JOIN (SELECT key, count(DISTINCT gnorm) AS n_pred FROM w7_tl GROUP BY key) p ON p.key = k.key
  LEFT JOIN (SELECT l.key, count(DISTINCT l.gnorm) AS n_overlap, min(l.rank) AS best_target_rank,
                    arg_min(l.gene, l.rank) AS best_target_gene,
                    string_agg(DISTINCT l.gnorm, ';' ORDER BY l.gnorm) AS overlapping_targets
             FROM w7_tl l JOIN (SELECT DISTINCT key, tnorm FROM w7_t) t ON t.key = l.key AND t.tnorm = l.gnorm
             GROUP BY l.key) o ON o.key = k.key""", "w7_t", "w7_names", "w7_tl")
SQL["best_target_position"] = build(f"""
SELECT compound, matched_compound, CAST(n_known_targets AS BIGINT) AS n_known_targets,
       CAST(CASE WHEN matched_compound IS NOT NULL THEN coalesce(n_overlap, 0) END AS BIGINT) AS n_overlap,
       {rnd("CASE WHEN matched_compound IS NOT NULL THEN round_even(CASE WHEN n_known_targets > 0 THEN coalesce(n_overlap, 0) / n_known_targets ELSE 0.0 END, 4) END", 'target_recall')},
       {rnd("CASE WHEN matched_compound IS NOT NULL THEN round_even(CASE WHEN n_pred > 0 THEN coalesce(n_overlap, 0) / n_pred ELSE 0.0 END, 4) END", 'target_precision')},
       CAST(best_target_rank AS BIGINT) AS best_target_rank, best_target_gene,
       CASE WHEN matched_compound IS NOT NULL THEN coalesce(overlapping_targets, '') END AS overlapping_targets,
       CASE WHEN matched_compound IS NOT NULL THEN 'ok' ELSE 'compound_not_in_top_genes_df' END AS note
FROM w7""", "w7")
SQL["case_insensitive_match"] = build("""
SELECT compound, matched_compound,
       CASE WHEN matched_compound IS NOT NULL THEN 'ok' ELSE 'compound_not_in_top_genes_df' END AS note
FROM w7""", "w7")

cte("nb_cp_sh_all", knn_sql("SELECT * FROM unit_vec_all WHERE pert_type = 'trt_cp'",
                            "SELECT * FROM unit_vec_all WHERE pert_type = 'trt_sh'", 1000), "unit_vec_all")
cte("knn_cg", """
  SELECT s.compound, s.gene, s.n_support, a.n_cp_sigs, s.n_support / a.n_cp_sigs AS robustness
  FROM (SELECT compound, gene, count(DISTINCT cp_sig) AS n_support FROM (
          SELECT * FROM (
            SELECT cp_sig, compound, gene, row_number() OVER (PARTITION BY cp_sig ORDER BY first_rank) AS pos
            FROM (SELECT n.query_id AS cp_sig, q.cmap_name AS compound, r.cmap_name AS gene, min(n.rank) AS first_rank
                  FROM nb_cp_sh_all n JOIN profiles q ON q.sig_id = n.query_id JOIN profiles r ON r.sig_id = n.ref_id
                  GROUP BY ALL))
          WHERE pos <= 100)
        GROUP BY compound, gene) s
  JOIN (SELECT cmap_name AS compound, count(*) AS n_cp_sigs FROM cp_profiles GROUP BY 1) a ON a.compound = s.compound""",
    "nb_cp_sh_all", "profiles", "cp_profiles")
SQL["knn_gene_ranking"] = build(f"""
SELECT compound, rank, gene, {rnd('robustness', 'robustness')} FROM (
  SELECT *, row_number() OVER (PARTITION BY compound ORDER BY robustness DESC, gene) AS rank FROM knn_cg)
WHERE rank <= 100""", "knn_cg")


# ------------------------------------------------------ enrichment, conf --
cte("gs_prio", """
  SELECT library, term, gene,
         CASE library WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS priority
  FROM gene_sets""", "gene_sets")
cte("gs", """
  SELECT DISTINCT g.library, g.term, g.gene
  FROM gs_prio g JOIN (SELECT term, max(priority) AS priority FROM gs_prio GROUP BY term) b
    ON b.term = g.term AND b.priority = g.priority""", "gs_prio")
cte("universe", "SELECT DISTINCT gene FROM gs", "gs")
cte("tsize", """
  SELECT term, count(*) AS n_genes FROM (SELECT DISTINCT term, gene FROM gs) GROUP BY term
  HAVING count(*) >= 10 AND count(*) <= 500""", "gs")
cte("qg", "SELECT DISTINCT compound, gene FROM query_genes", "query_genes")
cte("nin", """
  SELECT compound, count(*) AS n FROM qg WHERE gene IN (SELECT gene FROM universe) GROUP BY compound""",
    "qg", "universe")
cte("ov", """
  SELECT q.compound, t.term, count(*) AS kk, max(s.n_genes) AS big_k
  FROM qg q JOIN (SELECT DISTINCT term, gene FROM gs) t ON t.gene = q.gene JOIN tsize s ON s.term = t.term
  GROUP BY q.compound, t.term""", "qg", "gs", "tsize")


def _lnc(a: str, b: str) -> str:
    return f"(lgamma(({a}) + 1) - lgamma(({b}) + 1) - lgamma(({a}) - ({b}) + 1))"


cte("pv", f"""
  SELECT kk, big_k, n, big_n,
         least(1.0, list_sum(list_transform(range(greatest(kk, n - (big_n - big_k), 0), least(big_k, n) + 1),
               lambda i: exp({_lnc('big_k', 'i')} + {_lnc('big_n - big_k', 'n - i')} - {_lnc('big_n', 'n')})))) AS p
  FROM (SELECT DISTINCT o.kk, o.big_k, n.n, (SELECT count(*) FROM universe) AS big_n
        FROM ov o JOIN nin n ON n.compound = o.compound)""", "ov", "nin", "universe")
cte("best", """
  SELECT c.compound, coalesce(n.n, 0) AS n,
         CASE WHEN coalesce(n.n, 0) > 0 THEN coalesce(b.best_p, 1.0) ELSE 1.0 END AS best_p,
         coalesce(n.n, 0) > 0 AS has_result
  FROM (SELECT DISTINCT compound FROM query_genes) c
  LEFT JOIN nin n ON n.compound = c.compound
  LEFT JOIN (SELECT o.compound, min(p.p) AS best_p FROM ov o JOIN nin n ON n.compound = o.compound
             JOIN pv p ON p.kk = o.kk AND p.big_k = o.big_k AND p.n = n.n GROUP BY o.compound) b
    ON b.compound = c.compound""", "query_genes", "nin", "ov", "pv")
cte("enr", """
  SELECT b.compound, b.n, b.best_p, CASE WHEN b.has_result THEN a.p_adj ELSE 1.0 END AS p_adj,
         CASE WHEN b.has_result THEN -log10(greatest(a.p_adj, 1e-300)) ELSE 0.0 END AS enrich_score_raw
  FROM best b LEFT JOIN (
    SELECT compound, least(1.0, min(q) OVER (ORDER BY best_p DESC)) AS p_adj FROM (
      SELECT compound, best_p,
             best_p * (count(*) OVER ()) / (count(*) OVER (ORDER BY best_p)) AS q
      FROM best WHERE has_result)) a ON a.compound = b.compound""", "best")

SQL["load_gene_sets"] = build("SELECT library, term, gene FROM gs", "gs")
SQL["term_size_filter"] = build("""
SELECT term, n_genes, (SELECT count(*) FROM universe) AS universe_size FROM tsize""", "tsize", "universe")
SQL["gene_term_overlap"] = build("""
SELECT compound, count(*) AS n_terms, sum(kk) AS sum_overlap, max(kk) AS max_overlap FROM ov GROUP BY compound""",
                                 "ov")
SQL["hypergeom_enrichment"] = build("""
SELECT compound, CAST(n AS BIGINT) AS n, round(-log10(best_p), 6) AS neg_log10_p, has_result FROM best""", "best")
SQL["bh_adjust"] = build("""
SELECT compound, round(-log10(best_p), 6) AS neg_log10_p, round(-log10(p_adj), 6) AS neg_log10_adj FROM enr""",
                         "enr")
SQL["enrich_score"] = build(f"SELECT compound, {rnd('enrich_score_raw', 'enrich_score_raw')} FROM enr", "enr")

cte("conf0", """
  SELECT c.compound, coalesce(s.n_sigs, 1) AS n_sigs, coalesce(t.mean_tas, 0.0) AS mean_tas,
         coalesce(e.enrich_score_raw, 0.0) AS enrich_score_raw, r.robustness_100
  FROM (SELECT DISTINCT compound FROM top_long) c
  LEFT JOIN (SELECT compound, count(DISTINCT cp_sig) AS n_sigs FROM cp_signatures
             WHERE pert_type = 'trt_cp' AND qc_pass = '1' GROUP BY compound) s ON s.compound = c.compound
  LEFT JOIN (SELECT compound, avg(tas) AS mean_tas FROM cp_signatures WHERE pert_type = 'trt_cp'
             GROUP BY compound) t ON t.compound = c.compound
  LEFT JOIN enr e ON e.compound = c.compound
  LEFT JOIN (SELECT compound, avg(robustness) AS robustness_100 FROM (
               SELECT *, row_number() OVER (PARTITION BY compound ORDER BY robustness DESC, gene) AS r FROM cg)
             WHERE r <= 100 GROUP BY compound) r ON r.compound = c.compound""",
    "top_long", "cp_signatures", "enr", "cg")


def _mm(col: str) -> str:
    return (f"CASE WHEN max({col}) OVER () > min({col}) OVER () THEN ({col} - min({col}) OVER ()) "
            f"/ (max({col}) OVER () - min({col}) OVER ()) END")


cte("conf1", f"""
  SELECT compound, n_sigs, {_mm('ln(1 + n_sigs)')} AS score_n_sigs, mean_tas, {_mm('mean_tas')} AS score_tas,
         enrich_score_raw,
         CASE WHEN max(enrich_score_raw) OVER () > 0 THEN enrich_score_raw / max(enrich_score_raw) OVER ()
              ELSE 0.0 END AS score_enrichment,
         robustness_100, {_mm('robustness_100')} AS score_robustness
  FROM conf0""", "conf0")
cte("conf", """
  SELECT *, CASE WHEN (score_n_sigs IS NOT NULL)::INT + (score_tas IS NOT NULL)::INT
                      + (score_enrichment IS NOT NULL)::INT + (score_robustness IS NOT NULL)::INT > 0
                 THEN (coalesce(score_n_sigs, 0) + coalesce(score_tas, 0) + coalesce(score_enrichment, 0)
                       + coalesce(score_robustness, 0))
                      / ((score_n_sigs IS NOT NULL)::INT + (score_tas IS NOT NULL)::INT
                         + (score_enrichment IS NOT NULL)::INT + (score_robustness IS NOT NULL)::INT) END
                 AS composite_score
  FROM conf1""", "conf1")
SQL["term_coverage_report"] = build(f"""
SELECT CAST(sum(CASE WHEN enrich_score_raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_enriched,
       CAST(count(*) AS BIGINT) AS n_compounds,
       {rnd('100.0 * sum(CASE WHEN enrich_score_raw > 0 THEN 1 ELSE 0 END) / count(*)', 'pct_enriched')}
FROM conf""", "conf")
SQL["n_sigs_qc"] = build("SELECT compound, CAST(n_sigs AS BIGINT) AS n_sigs FROM conf", "conf")
SQL["mean_tas"] = build(f"SELECT compound, {rnd('mean_tas', 'mean_tas')} FROM conf", "conf")
SQL["score_minmax"] = build(f"""
SELECT compound, {rnd('score_n_sigs', 'score_n_sigs')}, {rnd('score_tas', 'score_tas')},
       {rnd('score_robustness', 'score_robustness')} FROM conf""", "conf")
SQL["score_max_scaled"] = build(f"SELECT compound, {rnd('score_enrichment', 'score_enrichment')} FROM conf", "conf")
SQL["composite_score"] = build(f"""
SELECT compound, CAST(n_sigs AS BIGINT) AS n_sigs, {rnd('score_n_sigs', 'score_n_sigs')},
       {rnd('mean_tas', 'mean_tas')}, {rnd('score_tas', 'score_tas')},
       {rnd('enrich_score_raw', 'enrich_score_raw')}, {rnd('score_enrichment', 'score_enrichment')},
       {rnd('robustness_100', 'robustness_100')}, {rnd('score_robustness', 'score_robustness')},
       {rnd('composite_score', 'composite_score')}
FROM conf""", "conf")


# ------------------------------------------------------- permutation nulls --
cte("ref_pos", "SELECT p_partkey AS ref_id, p_brand AS gene, row_number() OVER (ORDER BY p_partkey) AS pos FROM part")


def perm_ctes(n_perm: int) -> str:
    p = f"np{n_perm}"
    cte(f"{p}_permuted", f"""
  SELECT pp.perm, pp.ref_id, rp.gene FROM (
    SELECT r.perm, r.ref_id, row_number() OVER (
             PARTITION BY r.perm ORDER BY substr(md5('0:' || CAST(r.perm AS VARCHAR) || ':' || CAST(r.ref_id AS VARCHAR)), 1, 13),
             r.ref_id) AS pos
    FROM (SELECT perm, p_partkey AS ref_id FROM part, range({n_perm}) t(perm)) r) pp
  JOIN ref_pos rp ON rp.pos = pp.pos""", "ref_pos")
    cte(f"{p}_w1", f"""
  SELECT perm, cp_sig, compound, gene FROM (
    SELECT perm, cp_sig, compound, gene, row_number() OVER (PARTITION BY perm, cp_sig ORDER BY first_rank) AS pos
    FROM (SELECT x.perm, h.cp_sig, h.compound, x.gene, min(h.rank) AS first_rank
          FROM ranked_hits h JOIN {p}_permuted x ON x.ref_id = h.ref_id
          WHERE x.gene IS NOT NULL GROUP BY x.perm, h.cp_sig, h.compound, x.gene))
  WHERE pos <= 100""", "ranked_hits", f"{p}_permuted")
    cte(f"{p}_mrp", f"""
  SELECT *, CASE WHEN n_candidates = 1 THEN 100.0
                 ELSE 100.0 * (1.0 - (rank1 - 1) / (n_candidates - 1.0)) END AS percentile
  FROM (SELECT perm, compound, gene, robustness,
               rank() OVER (PARTITION BY perm, compound ORDER BY robustness DESC) AS rank1,
               count(*) OVER (PARTITION BY perm, compound) AS n_candidates
        FROM (SELECT s.perm, s.compound, s.gene, s.n_support / a.n_cp_sigs AS robustness
              FROM (SELECT perm, compound, gene, count(DISTINCT cp_sig) AS n_support FROM {p}_w1
                    GROUP BY perm, compound, gene) s
              LEFT JOIN a3 a ON a.compound = s.compound))""", f"{p}_w1", "a3")
    return p


_p200 = perm_ctes(200)
_p2 = perm_ctes(2)
SQL["permute_labels"] = build("SELECT perm, ref_id, gene FROM np2_permuted", "np2_permuted")

cte("e14_obs", """
  SELECT n.compound, t.target AS target_gene, m.rank1, m.percentile, n.n_candidates, m.robustness AS value
  FROM (SELECT compound, max(n_candidates) AS n_candidates FROM mrp GROUP BY compound) n
  JOIN (SELECT compound, target FROM targets WHERE target_order = 1) t ON t.compound = n.compound
  JOIN mrp m ON m.compound = n.compound AND m.gene = t.target""", "mrp", "targets")
cte("e14_null", """
  SELECT n.perm, n.compound, m.rank1, m.percentile
  FROM (SELECT perm, compound, max(n_candidates) AS n_candidates FROM np200_mrp GROUP BY perm, compound) n
  JOIN (SELECT compound, target FROM targets WHERE target_order = 1
        AND compound IN (SELECT compound FROM e14_obs)) t ON t.compound = n.compound
  LEFT JOIN np200_mrp m ON m.perm = n.perm AND m.compound = n.compound AND m.gene = t.target""",
    "np200_mrp", "targets", "e14_obs")
SQL["shuffled_null_single"] = build(f"""
SELECT o.compound, o.target_gene, true AS found, o.rank1 - 1 AS rank0, o.rank1, {rnd('o.percentile', 'percentile')},
       o.n_candidates, {rnd('o.value', 'value')},
       {rnd('s.r_mean', 'null_rank1_mean')}, {rnd('s.r_std', 'null_rank1_std')},
       {rnd('s.p_mean', 'null_percentile_mean')}, {rnd('s.p_std', 'null_percentile_std')}
FROM e14_obs o LEFT JOIN (
  SELECT compound, avg(rank1) AS r_mean, stddev_samp(rank1) AS r_std, avg(percentile) AS p_mean,
         stddev_samp(percentile) AS p_std
  FROM e14_null GROUP BY compound) s ON s.compound = o.compound""", "e14_obs", "e14_null")
SQL["shuffled_null_single_p"] = build(f"""
SELECT {rnd('o.m', 'observed_mean_percentile')}, CAST(count(*) AS BIGINT) AS n_perm,
       {rnd('(sum(CASE WHEN pp.mp >= o.m THEN 1 ELSE 0 END) + 1) / (count(*) + 1.0)', 'empirical_p')}
FROM (SELECT perm, avg(percentile) AS mp FROM e14_null GROUP BY perm) pp, (SELECT avg(percentile) AS m FROM e14_obs) o
GROUP BY o.m""", "e14_obs", "e14_null")

cte("e15_obs", """
  SELECT * FROM (
    SELECT m.compound, m.gene AS target_gene, m.rank1, m.percentile, m.robustness AS value,
           count(*) OVER (PARTITION BY m.compound) AS n_found,
           row_number() OVER (PARTITION BY m.compound ORDER BY m.rank1, m.robustness DESC, m.gene) AS rn
    FROM mrp m JOIN targets t ON t.compound = m.compound AND t.target = m.gene)
  WHERE rn = 1""", "mrp", "targets")
cte("e15_null", """
  SELECT n.perm, n.compound, b.gene AS target_gene, b.rank1 IS NOT NULL AS found,
         CASE WHEN b.rank1 IS NOT NULL THEN b.rank1 ELSE n.n_candidates + 1 END AS rank1,
         CASE WHEN b.rank1 IS NOT NULL THEN b.percentile ELSE 0.0 END AS percentile,
         b.robustness AS value
  FROM (SELECT perm, compound, max(n_candidates) AS n_candidates FROM np2_mrp
        WHERE compound IN (SELECT compound FROM e15_obs) GROUP BY perm, compound) n
  LEFT JOIN (SELECT * FROM (
               SELECT m.perm, m.compound, m.gene, m.rank1, m.percentile, m.robustness,
                      row_number() OVER (PARTITION BY m.perm, m.compound ORDER BY m.rank1, m.robustness DESC, m.gene) AS rn
               FROM np2_mrp m JOIN targets t ON t.compound = m.compound AND t.target = m.gene)
             WHERE rn = 1) b ON b.perm = n.perm AND b.compound = n.compound""", "np2_mrp", "targets", "e15_obs")
cte("e15_summary", """
  SELECT o.compound, o.target_gene, true AS found, o.rank1 - 1 AS rank0, o.rank1, o.percentile,
         n.n_candidates, i.n_targets_input, o.n_found AS n_targets_found, o.value,
         s.r_mean AS null_rank1_mean, s.r_std AS null_rank1_std, s.p_mean AS null_percentile_mean,
         s.p_std AS null_percentile_std, s.v_mean AS null_robustness_mean, s.v_std AS null_robustness_std,
         s.found_rate AS null_found_rate
  FROM e15_obs o
  JOIN (SELECT compound, max(n_candidates) AS n_candidates FROM mrp GROUP BY compound) n ON n.compound = o.compound
  JOIN (SELECT compound, count(*) AS n_targets_input FROM targets WHERE target IS NOT NULL GROUP BY compound) i
    ON i.compound = o.compound
  LEFT JOIN (SELECT compound, avg(rank1) AS r_mean, stddev_samp(rank1) AS r_std, avg(percentile) AS p_mean,
                    stddev_samp(percentile) AS p_std, avg(value) AS v_mean, stddev_samp(value) AS v_std,
                    avg(CASE WHEN found THEN 1.0 ELSE 0.0 END) AS found_rate
             FROM e15_null GROUP BY compound) s ON s.compound = o.compound""",
    "e15_obs", "e15_null", "mrp", "targets")
SQL["shuffled_null_best"] = build("SELECT compound, target_gene, found, rank0, rank1, " + ", ".join(
    [rnd("percentile", "percentile"), "CAST(n_candidates AS BIGINT) AS n_candidates", "n_targets_input",
     "CAST(n_targets_found AS BIGINT) AS n_targets_found", rnd("value", "value")]
    + [rnd(c, c) for c in ("null_rank1_mean", "null_rank1_std", "null_percentile_mean", "null_percentile_std",
                           "null_robustness_mean", "null_robustness_std", "null_found_rate")])
    + " FROM e15_summary", "e15_summary")


def _ep(col: str, obs: str, op: str) -> str:
    return (f"(SELECT CASE WHEN count({col}) > 0 THEN (sum(CASE WHEN {col} {op} {obs} THEN 1 ELSE 0 END) + 1) "
            f"/ (count({col}) + 1.0) END FROM (SELECT perm, avg(rank1) AS mean_rank1, avg(percentile) AS mean_percentile, "
            f"avg(value) AS mean_robustness FROM e15_null GROUP BY perm) WHERE {col} IS NOT NULL)")


SQL["empirical_p"] = build(f"""
SELECT {rnd('r', 'observed_mean_rank1')}, {rnd('p', 'observed_mean_percentile')}, {rnd('v', 'observed_mean_robustness')},
       {rnd(_ep('mean_rank1', 'o.r', '<='), 'empirical_p_mean_rank1_lower')},
       {rnd(_ep('mean_percentile', 'o.p', '>='), 'empirical_p_mean_percentile_higher')},
       {rnd(_ep('mean_robustness', 'o.v', '>='), 'empirical_p_mean_robustness_higher')}
FROM (SELECT avg(rank1) AS r, avg(percentile) AS p, avg(value) AS v FROM e15_summary) o""", "e15_summary", "e15_null")
SQL["range_histogram"] = build(f"""
SELECT b.bin, {rnd('m.lo + b.bin * (m.hi - m.lo) / 37', 'left')}, {rnd('m.lo + (b.bin + 1) * (m.hi - m.lo) / 37', 'right')},
       count(c.measure) AS count
FROM range(37) b(bin) CROSS JOIN (SELECT min(measure) AS lo, max(measure) AS hi FROM calibration) m
LEFT JOIN calibration c ON least(CAST(floor((c.measure - m.lo) / ((m.hi - m.lo) / 37)) AS BIGINT), 36) = b.bin
GROUP BY b.bin, m.lo, m.hi""", "calibration")
SQL["cumulative_hit_curve"] = build(f"""
SELECT k.k, {rnd('CASE WHEN count(d.compound) > 0 THEN avg(CASE WHEN d.rank1 <= k.k THEN 1.0 ELSE 0.0 END) END', 'observed_frac')},
       {rnd('CASE WHEN count(d.compound) > 0 THEN avg(CASE WHEN d.null_rank1_mean <= k.k THEN 1.0 ELSE 0.0 END) END', 'null_mean_frac')},
       CAST(count(d.compound) AS BIGINT) AS n_compounds
FROM range(1, 101) k(k)
LEFT JOIN (SELECT * FROM e15_summary WHERE rank1 IS NOT NULL AND null_rank1_mean IS NOT NULL) d ON true
GROUP BY k.k""", "e15_summary")

cte("recovery", """
  SELECT c.*, w.best_target_rank AS robustness_rank, w.best_target_rank IS NOT NULL AS recover
  FROM conf c JOIN (SELECT * FROM w7 WHERE matched_compound IS NOT NULL) w
    ON lower(trim(c.compound)) = lower(trim(w.compound))""", "conf", "w7")
SQL["cumulative_hit_curve_recovered"] = build(f"""
SELECT k.k, {rnd('CASE WHEN count(d.compound) > 0 THEN avg(CASE WHEN d.rank1 <= k.k THEN 1.0 ELSE 0.0 END) END', 'observed_frac')},
       {rnd('CASE WHEN count(d.compound) > 0 THEN avg(CASE WHEN d.null_rank1_mean <= k.k THEN 1.0 ELSE 0.0 END) END', 'null_mean_frac')},
       CAST(count(d.compound) AS BIGINT) AS n_compounds
FROM range(1, 101) k(k)
LEFT JOIN (SELECT * FROM e15_summary WHERE rank1 IS NOT NULL AND null_rank1_mean IS NOT NULL
             AND compound IN (SELECT compound FROM recovery WHERE recover)) d ON true
GROUP BY k.k""", "e15_summary", "recovery")
SQL["recover_flag"] = build(f"""
SELECT compound, {rnd('composite_score', 'composite_score')}, CAST(robustness_rank AS BIGINT) AS robustness_rank, recover
FROM recovery""", "recovery")
SQL["recovery_split"] = build(f"""
SELECT recover, count(*) AS n, {rnd('100.0 * count(*) / (SELECT count(*) FROM recovery)', 'pct')}
FROM recovery GROUP BY recover""", "recovery")


cte("recover_scores", "SELECT round(composite_score, 9) AS score, recover FROM recovery", "recovery")
SQL["recover_calibration"] = build(thresholds_sql("recover_scores", "score", "recover"), "recover_scores")
cte("recover_sc", '''
  SELECT score AS s, sum(CASE WHEN recover THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN recover THEN 0 ELSE 1 END) AS neg
  FROM recover_scores WHERE score IS NOT NULL GROUP BY score''', "recover_scores")
SQL["mann_whitney_recover"] = build(f'''
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       {rnd('CASE WHEN n1 > 0 AND n2 > 0 THEN u END', 'u')},
       {rnd('CASE WHEN n1 > 0 AND n2 > 0 AND sigma > 0 THEN (u - n1 * n2 / 2.0 - 0.5) / sigma END', 'z')}
FROM (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u,
             sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sigma
      FROM (SELECT sum(pos * (before + (pos + neg + 1) / 2.0)) AS r1, sum(pos) AS n1, sum(neg) AS n2,
                   sum(power(pos + neg, 3) - (pos + neg)) AS tie
            FROM (SELECT *, coalesce(sum(pos + neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                            AS before FROM recover_sc)))''', "recover_sc")

# ----------------------------------------------------- ingest, QC, prep --
cte("expr_long", """
  SELECT sig_id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value
  FROM (SELECT sig_id, embedding::DOUBLE[] AS v FROM profiles)""", "profiles")
SQL["landmark_filter"] = build(f"SELECT sig_id, pos, {rnd('value', 'value')} FROM expr_long WHERE pos % 9 <> 0",
                               "expr_long")
SQL["clip_negative"] = build(f"SELECT sig_id, pos, {rnd('greatest(value, 0.0)', 'value')} FROM expr_long",
                             "expr_long")
SQL["global_min_gate"] = build(f"""
SELECT {rnd('m', 'global_min')}, m < 0 AS clipped FROM (SELECT min(value) AS m FROM expr_long)""", "expr_long")
SQL["drop_empty_profiles"] = build(f"""
SELECT sig_id, {rnd('total', 'total')} FROM (
  SELECT sig_id, sum(CASE WHEN (SELECT min(value) FROM expr_long) < 0 THEN greatest(value, 0.0) ELSE value END) AS total
  FROM expr_long GROUP BY sig_id) WHERE total > 0""", "expr_long")
cte("hq_sigs", """
  SELECT * FROM signatures WHERE qc_pass = '1' AND is_hiq = '1' AND CAST(cc_q75 AS DOUBLE) > 0.2
    AND CAST(tas AS DOUBLE) >= 0.2 AND CAST(batch_effect_tstat_pct AS DOUBLE) < 95""", "signatures")
cte("instances", """
  SELECT CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR)
           AS instance_id,
         CASE WHEN l_partkey % 6 = 0 THEN '0' ELSE '1' END AS qc_pass
  FROM lineitem""")
SQL["hq_signature_filter"] = build("SELECT sig_id FROM hq_sigs", "hq_sigs")
SQL["explode_instance_ids"] = build("""
SELECT sig_id, unnest(string_split(distil_ids, '|')) AS instance_id FROM signatures""", "signatures")
SQL["hq_instances"] = build("""
SELECT instance_id FROM instances
WHERE qc_pass = '1' AND instance_id IN (SELECT unnest(string_split(distil_ids, '|')) FROM hq_sigs)""",
                            "instances", "hq_sigs")
SQL["map_tas_to_instances"] = build("""
SELECT i.instance_id, coalesce(CAST(h.tas AS VARCHAR), 'nan') AS tas
FROM instances i
LEFT JOIN (SELECT inst, max(sig_id) AS sig_id FROM (
             SELECT sig_id, unnest(string_split(distil_ids, '|')) AS inst FROM hq_sigs) GROUP BY inst) m
  ON m.inst = i.instance_id
LEFT JOIN hq_sigs h ON h.sig_id = m.sig_id""", "instances", "hq_sigs")
cte("label_strings", """
  SELECT c.pert_id,
         CASE WHEN l.m IS NULL THEN NULL
              WHEN c.pert_id % 4 = 0 THEN '[' || array_to_string(list_transform(l.m, lambda x: '''' || x || ''''), ', ') || ']'
              WHEN c.pert_id % 4 = 1 THEN array_to_string(l.m, '|')
              WHEN c.pert_id % 4 = 2 THEN ' ' || array_to_string(l.m, ' ; ') || ' '
              ELSE array_to_string(l.m, ';') || ';nan' END AS raw
  FROM (SELECT DISTINCT pert_id FROM cp_profiles) c
  LEFT JOIN (SELECT pert_id, list_sort(list(moa)) AS m FROM pert_moa GROUP BY pert_id) l ON l.pert_id = c.pert_id""",
    "cp_profiles", "pert_moa")
cte("label_clean", """
  SELECT pert_id, CASE WHEN raw IS NULL THEN []::VARCHAR[] ELSE
    list_sort(list_distinct(list_transform(list_filter(list_transform(
      CASE WHEN starts_with(trim(raw), '[') AND ends_with(trim(raw), ']')
           THEN regexp_extract_all(trim(raw), '''([^'']*)''', 1)
           ELSE regexp_split_to_array(trim(raw), '[;|]') END,
      lambda x: trim(x)), lambda x: x NOT IN ('', 'nan', 'None')), lambda x: lower(x)))) END AS c
  FROM label_strings""", "label_strings")
SQL["clean_label_set"] = build("""
SELECT pert_id, array_to_string(c, ';') AS labels, len(c) AS n_labels FROM label_clean""", "label_clean")
SQL["label_set_split"] = build("""
SELECT pert_id, array_to_string(c, '#') AS items, len(c) AS n_items FROM (
  SELECT pert_id, CASE WHEN raw IS NULL OR raw = '' THEN []::VARCHAR[]
                       ELSE list_sort(list_distinct(string_split(raw, ';'))) END AS c FROM label_strings)""",
                            "label_strings")
SQL["category_codes"] = build("""
SELECT sig_id, dense_rank() OVER (ORDER BY cmap_name) - 1 AS drug_code,
       dense_rank() OVER (ORDER BY pert_type) - 1 AS type_code FROM profiles""", "profiles")
SQL["vocab_filter"] = build(f"SELECT sig_id, pos, {rnd('value', 'value')} FROM expr_long WHERE pos % 9 <> 0",
                            "expr_long")
SQL["vocab_report"] = build("""
SELECT CAST(sum(CASE WHEN pos % 9 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_matched, count(*) AS n_total
FROM (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings))) AS pos)""")
cte("binned", """
  SELECT sig_id, list_transform(e, lambda x: CASE WHEN x = 0 THEN 0
                                             ELSE len(list_filter(edges, lambda ed: ed <= x)) END) AS b
  FROM (SELECT sig_id, e, CASE WHEN len(nz) = 0 THEN []::DOUBLE[] ELSE list_transform(range(0, 50), lambda j:
          CASE WHEN ((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END)
                     - floor((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END))) >= 0.5
               THEN nz[least(CAST(floor((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END)) AS BIGINT) + 2, len(nz))]
                    - (nz[least(CAST(floor((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END)) AS BIGINT) + 2, len(nz))]
                       - nz[CAST(floor((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END)) AS BIGINT) + 1])
                      * (1 - ((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END)
                              - floor((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END))))
               ELSE nz[CAST(floor((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END)) AS BIGINT) + 1]
                    + (nz[least(CAST(floor((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END)) AS BIGINT) + 2, len(nz))]
                       - nz[CAST(floor((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END)) AS BIGINT) + 1])
                      * ((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END)
                         - floor((len(nz) - 1) * (CASE WHEN j = 49 THEN 1.0 ELSE j * (1.0::DOUBLE / 49) END)))
          END) END AS edges
        FROM (SELECT sig_id, e, list_sort(list_filter(e, lambda x: x <> 0)) AS nz FROM (
                SELECT sig_id, list_transform(embedding::DOUBLE[], lambda x: greatest(x, 0.0)) AS e FROM profiles)))""",
    "profiles")
cte("binned_long", "SELECT sig_id, generate_subscripts(b, 1) - 1 AS pos, unnest(b) AS bin FROM binned", "binned")
SQL["value_binning"] = build("SELECT sig_id, pos, bin FROM binned_long", "binned_long")
SQL["random_value_mask"] = build("SELECT sig_id, pos, bin AS value FROM binned_long", "binned_long")
SQL["tokenize_profile"] = build("""
SELECT sig_id, 0 AS position, -1 AS gene_pos, 0 AS value FROM (SELECT DISTINCT sig_id FROM binned_long)
UNION ALL
SELECT sig_id, row_number() OVER (PARTITION BY sig_id ORDER BY pos) AS position, pos AS gene_pos, bin AS value
FROM (SELECT *, row_number() OVER (PARTITION BY sig_id ORDER BY md5(CAST(sig_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR))) AS r
      FROM binned_long WHERE bin <> 0) WHERE r <= 999""", "binned_long")


SQL["random_value_mask_share"] = build("""
SELECT sig_id, pos, CASE WHEN bin <> -2 AND CAST(('0x' || substr(md5('0:' || CAST(sig_id AS VARCHAR) || ':'
         || CAST(pos AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.4 THEN -1 ELSE bin END AS value
FROM binned_long""", "binned_long")
SQL["tokenize_padded"] = build("""
SELECT sig_id, position, coalesce(gene_pos, -2) AS gene_pos, coalesce(value, -2) AS value
FROM (SELECT DISTINCT sig_id, unnest(range(0, 40)) AS position FROM binned_long) LEFT JOIN (
  SELECT sig_id, 0 AS position, -1 AS gene_pos, 0 AS value FROM (SELECT DISTINCT sig_id FROM binned_long)
  UNION ALL
  SELECT sig_id, row_number() OVER (PARTITION BY sig_id ORDER BY pos) AS position, pos AS gene_pos, bin AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY sig_id
                  ORDER BY md5(CAST(sig_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR))) AS r
        FROM binned_long WHERE bin <> 0) WHERE r <= 39) USING (sig_id, position)""", "binned_long")


def _bucket(key: str, seed: int = 0) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) % 10)"


SQL["train_valid_split"] = build(f"""
SELECT sig_id, CASE WHEN {_bucket('sig_id')} < 1 THEN 'valid' ELSE 'train' END AS split FROM profiles""", "profiles")
SQL["group_holdout_split"] = build(f"""
SELECT sig_id, pert_id, CASE WHEN {_bucket('pert_id')} < 1 THEN 'test' ELSE 'train' END AS split FROM profiles""",
                                   "profiles")
SQL["normalize_key"] = build("""
SELECT compound, lower(trim(compound)) AS compound_key, target, upper(trim(target)) AS gene_key FROM targets""",
                             "targets")
_short = "p_type"
for _old, _new in [("inhibitor", "inh."), ("agonist", "ago."), ("antagonist", "antag."), ("receptor", "rec."),
                   ("modulator", "mod."), ("sensitizer", "sens."), ("Tyrosine kinase", "TK"),
                   ("Protein synthesis", "Prot. synth."), ("Estrogen", "ER"), ("Dopamine", "DA"),
                   ("Glucocorticoid", "GC"), ("Insulin", "Ins.")]:
    _short = f"replace({_short}, '{_old}', '{_new}')"
SQL["label_shortening"] = f"""
SELECT p_type, trim(regexp_replace({_short}, '\\s+', ' ', 'g')) AS short FROM (SELECT DISTINCT p_type FROM part)"""
SQL["concat_matrices"] = build("SELECT sig_id, pert_type FROM profiles", "profiles")
SQL["key_match_signatures"] = build("SELECT cmap_name, min(sig_id) AS sig_id FROM profiles GROUP BY cmap_name",
                                    "profiles")
SQL["concat_matrix_values"] = build(f"""
SELECT p.sig_id, 'g' || CAST(g.i AS VARCHAR) AS gene,
       {rnd("CASE WHEN p.pert_type = 'trt_cp' AND g.i % 9 <> 0 OR p.pert_type = 'trt_sh' AND g.i >= 5 THEN p.embedding[g.i + 1]::DOUBLE END", 'value')}
FROM profiles p, (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM embeddings))) AS i) g
WHERE g.i >= 5 OR g.i % 9 <> 0""", "profiles")
SQL["knn_graph_euclidean"] = build(f"""
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS BIGINT) AS rank, ref_id,
       {rnd('distance', 'distance')}
FROM (SELECT a.sig_id AS query_id, b.sig_id AS ref_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
      FROM profiles a JOIN profiles b ON a.sig_id <> b.sig_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) <= 15""", "profiles")
SQL["read_metadata_tsv"] = build("""
SELECT CAST(sig_id AS VARCHAR) AS sig_id, CASE WHEN pert_id % 7 <> 0 THEN cmap_name END AS cmap_name, qc_pass FROM profiles""",
                                 "profiles")
SQL["read_compound_info"] = """
SELECT pert_id, 'K' || CAST(pert_id // 2 AS VARCHAR) AS inchi_key
FROM (SELECT DISTINCT vec_id // 10 AS pert_id FROM embeddings)
WHERE pert_id % 4 <> 0 AND pert_id % 17 <> 0 AND pert_id % 19 <> 0"""
SQL["read_gene_set_text"] = """
WITH g AS (SELECT DISTINCT l_returnflag AS library, 'S' || CAST(l_suppkey AS VARCHAR) AS term,
                  'P' || CAST(l_partkey AS VARCHAR) AS gene FROM lineitem WHERE l_suppkey % 3 < 2 OR l_returnflag <> 'R')
SELECT g.* FROM g JOIN (SELECT term, max(library) AS library FROM g GROUP BY term) USING (term, library)"""
SQL["read_prior_results"] = build(f"""
SELECT pert_id AS compound, {rnd('pert_id % 10 / 10', 'conf')}, lower(moa) AS moa FROM pert_moa""", "pert_moa")
SQL["write_neighbors"] = SQL["cosine_knn"]
SQL["read_profiles_subset"] = build("""
SELECT sig_id, pert_id FROM profiles
WHERE pert_type = 'trt_cp' AND qc_pass = '1' AND sig_id IN (SELECT sig_id FROM signatures)""",
                                    "profiles", "signatures")


# ------------------------------------------------- pairs, AUROC, external --
cte("sampled", """
  SELECT seed, sig_id, pert_id, cmap_name, embedding FROM (
    SELECT CAST(s.seed AS INTEGER) AS seed, p.sig_id, p.pert_id, p.cmap_name, p.embedding,
           row_number() OVER (PARTITION BY s.seed, p.pert_id
                              ORDER BY md5(CAST(s.seed AS VARCHAR) || ':' || CAST(p.sig_id AS VARCHAR)), p.sig_id) AS r
    FROM sh_profiles p, range(10) s(seed))
  WHERE r = 1""", "sh_profiles")
cte("sp_unit", """
  SELECT seed, sig_id, cmap_name, space, CASE WHEN nrm > 0 THEN list_transform(v, lambda x: x / nrm) END AS u FROM (
    SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM (
      SELECT seed, sig_id, cmap_name, 'embedding' AS space, embedding::DOUBLE[] AS v FROM sampled
      UNION ALL
      SELECT seed, sig_id, cmap_name, 'raw' AS space, list_transform(embedding::DOUBLE[], lambda x: greatest(x, 0.0))
      FROM sampled))""", "sampled")
cte("sp_pairs", """
  SELECT a.seed, a.space, a.sig_id AS id_a, b.sig_id AS id_b, list_inner_product(a.u, b.u) AS similarity,
         1 - list_inner_product(a.u, b.u) AS distance, a.cmap_name = b.cmap_name AS same
  FROM sp_unit a JOIN sp_unit b ON a.seed = b.seed AND a.space = b.space AND a.sig_id < b.sig_id""", "sp_unit")
SQL["stratified_sample"] = build("SELECT seed, pert_id, sig_id FROM sampled", "sampled")
SQL["pairwise_cosine"] = build(f"""
SELECT seed, id_a, id_b, {rnd('distance', 'distance')} FROM sp_pairs WHERE space = 'embedding'""", "sp_pairs")
SQL["same_label_pairs"] = build("SELECT seed, id_a, id_b, same FROM sp_pairs WHERE space = 'embedding'", "sp_pairs")


def auc_sql(src: str, keys: str, score: str, label: str) -> str:
    return f"""
SELECT {keys}, CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg,
       {rnd('CASE WHEN P > 0 AND N > 0 THEN (rpos - P * (P + 1) / 2.0) / (P * N) END', 'auroc')}
FROM (SELECT {keys}, sum(pos * (before + (pos + neg + 1) / 2.0)) AS rpos, sum(pos) AS P, sum(neg) AS N
      FROM (SELECT *, coalesce(sum(pos + neg) OVER (PARTITION BY {keys} ORDER BY s
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM (SELECT {keys}, {score} AS s, sum(CASE WHEN {label} THEN 1 ELSE 0 END) AS pos,
                         sum(CASE WHEN {label} THEN 0 ELSE 1 END) AS neg
                  FROM {src} WHERE {score} IS NOT NULL GROUP BY {keys}, {score}))
      GROUP BY {keys})"""


SQL["repeated_auroc"] = build(auc_sql("sp_pairs", "seed, space", "similarity", "same"), "sp_pairs")
cte("e8_thr", """
  SELECT seed, quantile_cont(distance, 0.001) AS threshold FROM sp_pairs WHERE space = 'raw' GROUP BY seed""", "sp_pairs")
cte("e8_lab", """
  SELECT e.seed, e.similarity, r.distance < t.threshold AS positive
  FROM sp_pairs e JOIN sp_pairs r ON r.seed = e.seed AND r.id_a = e.id_a AND r.id_b = e.id_b AND r.space = 'raw'
  JOIN e8_thr t ON t.seed = e.seed
  WHERE e.space = 'embedding'""", "sp_pairs", "e8_thr")
SQL["percentile_positive"] = build(f"""
SELECT t.seed, {rnd('t.threshold', 'threshold')}, a.n_pos, a.n_neg, a.auroc
FROM e8_thr t JOIN ({auc_sql('e8_lab', 'seed', 'similarity', 'positive')}) a ON a.seed = t.seed""",
                                   "e8_thr", "e8_lab")

cte("cmp_info", """
  SELECT c.pert_id, CASE WHEN c.pert_id % 13 = 0 THEN 'restricted' ELSE d.text END AS canonical_smiles,
         CASE WHEN c.pert_id % 17 = 0 THEN NULL WHEN c.pert_id % 19 = 0 THEN 'restricted'
              ELSE 'K' || CAST(c.pert_id // 2 AS VARCHAR) END AS inchi_key
  FROM (SELECT DISTINCT pert_id FROM cp_profiles) c LEFT JOIN documents d ON d.doc_id = c.pert_id""", "cp_profiles")


def two_spaces(name: str, sampled: str) -> None:
    """Unit vectors and pairs of a sampled table in the embedding and the clipped space."""
    cte(f"{name}_unit", f"""
  SELECT seed, sig_id, space, CASE WHEN nrm > 0 THEN list_transform(v, lambda x: x / nrm) END AS u FROM (
    SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM (
      SELECT seed, sig_id, 'embedding' AS space, embedding::DOUBLE[] AS v FROM {sampled}
      UNION ALL
      SELECT seed, sig_id, 'raw' AS space, list_transform(embedding::DOUBLE[], lambda x: greatest(x, 0.0))
      FROM {sampled}))""", sampled)
    cte(f"{name}_pairs", f"""
  SELECT a.seed, a.space, a.sig_id AS id_a, b.sig_id AS id_b, list_inner_product(a.u, b.u) AS similarity
  FROM {name}_unit a JOIN {name}_unit b ON a.seed = b.seed AND a.space = b.space AND a.sig_id < b.sig_id""",
        f"{name}_unit")


cte("chem", """
  SELECT seed, sig_id, pert_id, embedding, bits FROM (
    SELECT CAST(s.seed AS INTEGER) AS seed, p.sig_id, p.pert_id, p.embedding, i.bits,
           row_number() OVER (PARTITION BY s.seed, p.pert_id
                              ORDER BY md5(CAST(s.seed AS VARCHAR) || ':' || CAST(p.sig_id AS VARCHAR)), p.sig_id) AS r
    FROM cp_profiles p JOIN (
      SELECT pert_id, list_distinct(list_transform(list_filter(string_split(canonical_smiles, ' '), lambda x: x <> ''),
               lambda x: CAST(CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % 2048 AS INTEGER))) AS bits
      FROM cmp_info WHERE canonical_smiles IS NOT NULL AND canonical_smiles <> 'restricted') i
      ON i.pert_id = p.pert_id, range(10) s(seed)
    WHERE len(i.bits) > 0) WHERE r = 1""", "cp_profiles", "cmp_info")
two_spaces("chem", "chem")
cte("chem_ref", """
  SELECT a.seed, a.sig_id AS id_a, b.sig_id AS id_b,
         1 - len(list_intersect(a.bits, b.bits)) / len(list_distinct(list_concat(a.bits, b.bits))) AS distance
  FROM chem a JOIN chem b ON a.seed = b.seed AND a.sig_id < b.sig_id""", "chem")
cte("chem_thr", "SELECT seed, quantile_cont(distance, 0.001) AS threshold FROM chem_ref GROUP BY seed", "chem_ref")
cte("chem_lab", """
  SELECT p.seed, p.space, p.similarity, r.distance < t.threshold AS positive
  FROM chem_pairs p JOIN chem_ref r USING (seed, id_a, id_b) JOIN chem_thr t USING (seed)""",
    "chem_pairs", "chem_ref", "chem_thr")
SQL["chemical_auroc"] = build(f"""
SELECT CAST(a.seed AS BIGINT) AS seed, a.space, a.n_pos, a.n_neg, a.auroc, {rnd('t.threshold', 'threshold')}
FROM ({auc_sql('chem_lab', 'seed, space', 'similarity', 'positive')}) a JOIN chem_thr t USING (seed)""",
                              "chem_lab", "chem_thr")

cte("tprof", """
  SELECT seed, sig_id, embedding, target FROM (
    SELECT CAST(s.seed AS INTEGER) AS seed, p.sig_id, p.embedding, k.target,
           row_number() OVER (PARTITION BY s.seed, i.inchi_key
                              ORDER BY md5(CAST(s.seed AS VARCHAR) || ':' || CAST(p.sig_id AS VARCHAR)), p.sig_id) AS r
    FROM cp_profiles p
    JOIN (SELECT inchi_key, min(pert_id) AS pert_id FROM cmp_info
          WHERE inchi_key IS NOT NULL AND inchi_key <> 'restricted' GROUP BY inchi_key) i ON i.pert_id = p.pert_id
    JOIN (SELECT 'K' || CAST(pert_id // 2 AS VARCHAR) AS key, arg_min(embedding[1:16], sig_id) AS target FROM cp_profiles
          WHERE sig_id % 10 >= 3 AND (pert_id // 2) % 7 <> 0 GROUP BY 1) k ON k.key = i.inchi_key,
    range(10) s(seed)) WHERE r = 1""", "cp_profiles", "cmp_info")
two_spaces("tprof", "tprof")
cte("tprof_ref", """
  SELECT a.seed, a.sig_id AS id_a, b.sig_id AS id_b, 1 - list_inner_product(a.u, b.u) AS distance
  FROM (SELECT seed, sig_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u
        FROM (SELECT seed, sig_id, target::DOUBLE[] AS v FROM tprof)) a
  JOIN (SELECT seed, sig_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u
        FROM (SELECT seed, sig_id, target::DOUBLE[] AS v FROM tprof)) b ON a.seed = b.seed AND a.sig_id < b.sig_id""",
    "tprof")
cte("tprof_thr", "SELECT seed, quantile_cont(distance, 0.001) AS threshold FROM tprof_ref GROUP BY seed", "tprof_ref")
cte("tprof_lab", """
  SELECT p.seed, p.space, p.similarity, r.distance < t.threshold AS positive
  FROM tprof_pairs p JOIN tprof_ref r USING (seed, id_a, id_b) JOIN tprof_thr t USING (seed)""",
    "tprof_pairs", "tprof_ref", "tprof_thr")
SQL["target_profile_auroc"] = build(f"""
SELECT CAST(a.seed AS BIGINT) AS seed, a.space, a.n_pos, a.n_neg, a.auroc, {rnd('t.threshold', 'threshold')}
FROM ({auc_sql('tprof_lab', 'seed, space', 'similarity', 'positive')}) a JOIN tprof_thr t USING (seed)""",
                                    "tprof_lab", "tprof_thr")

cte("hext", """
  SELECT e.sig_id, e.treatment, a.ref_name, e.embedding FROM (
    SELECT sig_id, 'X' || CAST(pert_id AS VARCHAR) AS treatment, embedding FROM cp_profiles WHERE sig_id % 10 = 9) e
  JOIN (SELECT DISTINCT 'X' || CAST(pert_id AS VARCHAR) AS treatment, cmap_name AS ref_name FROM cp_profiles
        WHERE pert_id % 11 <> 0) a ON a.treatment = e.treatment""", "cp_profiles")
cte("xd", """
  SELECT h.sig_id AS id_a, r.sig_id AS id_b, h.treatment, h.ref_name, r.cmap_name,
         1 - list_inner_product(h.u, r.u) AS distance, r.cmap_name = h.ref_name AS same
  FROM (SELECT sig_id, treatment, ref_name, list_transform(v, lambda x: x / nrm) AS u FROM (
          SELECT *, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm
          FROM hext)) h,
       (SELECT sig_id, cmap_name, list_transform(v, lambda x: x / nrm) AS u FROM (
          SELECT sig_id, cmap_name, embedding::DOUBLE[] AS v,
                 sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm
          FROM cp_profiles WHERE sig_id % 10 <> 9)) r""", "hext", "cp_profiles")
cte("w9", """
  SELECT id_a AS sig_id, treatment, ref_name, rank0, n_compounds, d AS true_distance, rank0 / n_compounds AS rel_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY d, cmap_name) - 1 AS rank0,
               count(*) OVER (PARTITION BY id_a) AS n_compounds
        FROM (SELECT id_a, treatment, ref_name, cmap_name, min(distance) AS d FROM xd GROUP BY ALL))
  WHERE cmap_name = ref_name""", "xd")
SQL["harmonize_names"] = build("SELECT sig_id, treatment, ref_name FROM hext", "hext")
SQL["cross_cosine"] = build(f"SELECT id_a, id_b, {rnd('distance', 'distance')} FROM xd", "xd")
SQL["background_vs_same"] = build(f"""
SELECT id_a, same, count(*) AS n, {rnd('avg(distance)', 'mean_distance')}, {rnd('min(distance)', 'min_distance')}
FROM xd GROUP BY id_a, same""", "xd")
SQL["argsort_unique_rank"] = build(f"""
SELECT sig_id, treatment, ref_name, rank0, n_compounds, {rnd('true_distance', 'true_distance')},
       {rnd('rel_rank', 'rel_rank')} FROM w9""", "w9")
SQL["best_example_per_group"] = build(f"""
SELECT treatment, arg_min(sig_id, (rank0, sig_id)) AS sig_id, min(rank0) AS rank0,
       {rnd('arg_min(true_distance, (rank0, sig_id))', 'true_distance')}, count(*) AS n_queries
FROM w9 GROUP BY treatment""", "w9")
SQL["kde_grid"] = build(f"""
SELECT s.set, CAST(g.g AS INTEGER) AS g, {rnd('m.lo + g.g * (m.hi - m.lo) / 199', 'x')},
       {rnd('sum(exp(-0.5 * power((m.lo + g.g * (m.hi - m.lo) / 199 - s.distance) / b.bw, 2))) / (max(b.n) * max(b.bw) * sqrt(2 * pi()))', 'density')}
FROM (SELECT CASE WHEN same THEN 'same' ELSE 'background' END AS set, distance FROM xd) s
JOIN (SELECT CASE WHEN same THEN 'same' ELSE 'background' END AS set, count(distance) AS n,
             stddev_samp(distance) * power(count(distance), -0.2) AS bw FROM xd GROUP BY 1) b ON b.set = s.set
CROSS JOIN (SELECT min(distance) AS lo, max(distance) AS hi FROM xd) m
CROSS JOIN range(200) g(g)
GROUP BY s.set, g.g, m.lo, m.hi""", "xd")
SQL["ecdf_distances"] = build(f"""
SELECT set, {rnd('distance', 'distance')}, {rnd('c', 'ecdf')} FROM (
  SELECT set, distance, sum(n) OVER (PARTITION BY set ORDER BY distance) / sum(n) OVER (PARTITION BY set) AS c
  FROM (SELECT CASE WHEN same THEN 'same' ELSE 'background' END AS set, distance, count(*) AS n
        FROM xd GROUP BY 1, 2))""", "xd")


# ------------------------------------------- fingerprints, embedding, LSH --
cte("fp", """
  SELECT seed, doc_id, list_distinct(list_transform(string_split(text, ' '),
           lambda x: CAST(CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % 2048 AS INTEGER))) AS bits
  FROM (SELECT * FROM (
          SELECT CAST(s.seed AS INTEGER) AS seed, d.doc_id, d.text,
                 row_number() OVER (PARTITION BY s.seed, d.source || '/' || d.lang
                                    ORDER BY md5(CAST(s.seed AS VARCHAR) || ':' || CAST(d.doc_id AS VARCHAR)), d.doc_id) AS r
          FROM documents d, range(10) s(seed))
        WHERE r = 1)""")
SQL["tanimoto_distance"] = build(f"""
SELECT a.seed, a.doc_id AS id_a, b.doc_id AS id_b,
       {rnd("1 - CASE WHEN len(list_distinct(list_concat(a.bits, b.bits))) = 0 THEN 0.0 ELSE len(list_intersect(a.bits, b.bits)) / len(list_distinct(list_concat(a.bits, b.bits))) END", 'distance')}
FROM fp a JOIN fp b ON a.seed = b.seed AND a.doc_id < b.doc_id""", "fp")
SQL["batch_embed"] = build(f"""
SELECT e.sig_id, CAST(w.j AS INTEGER) AS pos,
       {rnd("CAST(sum(CAST(e.x AS DOUBLE) * (((7 * e.i + 3 * w.j) % 11) - 5) / 10.0) AS FLOAT)", 'value')}
FROM (SELECT sig_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM profiles) e,
     range(16) w(j)
GROUP BY e.sig_id, w.j""", "profiles")


# ------------------------------------------------------------- remaining --
SQL["count_overlay"] = build(f"""
SELECT top_moa, count_all, count_filt, {rnd('perc_all', 'perc_all')}, {rnd('perc_filt', 'perc_filt')},
       {_short.replace('p_type', 'top_moa').join(['trim(regexp_replace(', ", '\\\\s+', ' ', 'g')) AS top_moa_short"])}
FROM (SELECT top_moa, count(*) AS count_all, sum(CASE WHEN top_conf > 0.25 THEN 1 ELSE 0 END) AS count_filt,
             count(*) / (SELECT count(*) FROM bench WHERE top_moa IS NOT NULL) * 100 AS perc_all,
             sum(CASE WHEN top_conf > 0.25 THEN 1 ELSE 0 END) / (SELECT count(*) FROM bench WHERE top_moa IS NOT NULL) * 100
               AS perc_filt
      FROM bench WHERE top_moa IS NOT NULL GROUP BY top_moa)
WHERE count_filt > 0
ORDER BY count_filt DESC, top_moa LIMIT 10""", "bench")
SQL["l2_normalize"] = build(f"""
SELECT sig_id, generate_subscripts(u, 1) - 1 AS pos, {rnd('unnest(u)', 'value')} FROM (
  SELECT sig_id, CASE WHEN nrm = 0 THEN v ELSE list_transform(v, lambda x: x / nrm) END AS u FROM (
    SELECT sig_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm
    FROM profiles))""", "profiles")
SQL["closest_per_group"] = build(f"""
SELECT query_id, ref_group, {rnd('d', 'distance')} FROM inf_cmp0""", "inf_cmp0")
SQL["neighbor_weights"] = build(f"""
SELECT query_id, ref_group, {rnd('w', 'w')}, n_unique FROM inf_coll_all""", "inf_coll_all")
SQL["lookup_left"] = build("""
SELECT p.sig_id, t.true_moa FROM profiles p LEFT JOIN true_sets t ON t.pert_id = p.pert_id""", "profiles", "true_sets")
SQL["read_matrix_subset"] = build(f"""
SELECT l.sig_id, l.pos, {rnd('l.value', 'value')} FROM expr_long l JOIN profiles p ON p.sig_id = l.sig_id
WHERE p.pert_type = 'trt_sh' AND l.pos % 9 <> 0""", "expr_long", "profiles")
SQL["count_overlay"] = SQL["count_overlay"].replace("'\\\\s+'", "'\\s+'")

cte("conf_long", " UNION ALL ".join(
    f"SELECT compound, recover, '{c}' AS metric, {c} AS score FROM recovery WHERE {c} IS NOT NULL"
    for c in ("score_n_sigs", "score_tas", "score_enrichment", "score_robustness", "composite_score")), "recovery")
SQL["unpivot_conf_scores"] = build(f"SELECT compound, recover, metric, {rnd('score', 'score')} FROM conf_long",
                                   "conf_long")
SQL["score_box_summary"] = build(f"""
SELECT q.metric, q.recover, {rnd('q1', 'q1')}, {rnd('median', 'median')}, {rnd('q3', 'q3')}, CAST(q.n AS BIGINT) AS n,
       {rnd('max(CASE WHEN c.score <= q3 + 1.5 * (q3 - q1) THEN c.score END)', 'whisker_high')},
       {rnd('min(CASE WHEN c.score >= q1 - 1.5 * (q3 - q1) THEN c.score END)', 'whisker_low')}
FROM (SELECT metric, recover, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
             quantile_cont(score, 0.75) AS q3, count(score) AS n
      FROM conf_long GROUP BY metric, recover) q
JOIN conf_long c ON c.metric = q.metric AND c.recover = q.recover
GROUP BY q.metric, q.recover, q.q1, q.median, q.q3, q.n""", "conf_long")

# Calibration of every score, and whether it rises with the threshold.
cte("score_calibration", """
  SELECT g.metric, r.i * 0.05::DOUBLE AS threshold, count(s.m) AS n_compounds,
         CASE WHEN count(s.m) > 0 THEN sum(CASE WHEN s.t THEN 1 ELSE 0 END) * 100.0 / count(s.m) END AS pct_true,
         coalesce(sum(CASE WHEN s.t THEN 1 ELSE 0 END), 0) AS n_compounds_true
  FROM (SELECT DISTINCT metric FROM conf_long) g CROSS JOIN range(21) r(i)
  LEFT JOIN (SELECT metric, round(score, 9) AS m, recover AS t FROM conf_long) s
    ON s.metric = g.metric AND s.m >= r.i * 0.05::DOUBLE
  GROUP BY g.metric, r.i""", "conf_long")
SQL["score_calibration"] = build(f"""
SELECT metric, {rnd('threshold', 'threshold')}, CAST(n_compounds AS BIGINT) AS n_compounds, {rnd('pct_true', 'pct_true')},
       CAST(n_compounds_true AS BIGINT) AS n_compounds_true
FROM score_calibration""", "score_calibration")
SQL["threshold_correlation"] = build(f"""
SELECT metric, CAST(n AS BIGINT) AS n, {rnd('CASE WHEN low < high THEN rho END', 'rho')}
FROM (SELECT metric, count(*) AS n, min(pct_true) AS low, max(pct_true) AS high, corr(x, y) AS rho
      FROM (SELECT metric, pct_true,
                   rank() OVER (PARTITION BY metric ORDER BY pct_true)
                     + (count(*) OVER (PARTITION BY metric, pct_true) - 1) / 2.0 AS x,
                   rank() OVER (PARTITION BY metric ORDER BY threshold)::DOUBLE AS y
            FROM score_calibration WHERE pct_true IS NOT NULL)
      GROUP BY metric)""", "score_calibration")

cte("split_predictions", f"""
  SELECT truth, prediction, CASE WHEN {_bucket('query_id')} < 1 THEN 'valid' ELSE 'train' END AS split
  FROM predictions""", "predictions")
SQL["classification_metrics_by_split"] = build(f"""
SELECT split, CAST(sum(n_true) AS BIGINT) AS n, {rnd('sum(tp) / sum(n_true)', 'accuracy')},
       {rnd('1 - sum(tp) / sum(n_true)', 'error_rate')},
       {rnd('avg(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END)', 'macro_precision')},
       {rnd('avg(CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END)', 'macro_recall')},
       {rnd('avg(CASE WHEN tp > 0 THEN 2.0 * tp / (n_true + n_pred) ELSE 0.0 END)', 'macro_f1')}
FROM (SELECT c.split, c.cls,
             (SELECT count(*) FROM split_predictions p WHERE p.split = c.split AND p.truth = c.cls) AS n_true,
             (SELECT count(*) FROM split_predictions p WHERE p.split = c.split AND p.prediction = c.cls) AS n_pred,
             (SELECT count(*) FROM split_predictions p
              WHERE p.split = c.split AND p.truth = c.cls AND p.prediction = c.cls) AS tp
      FROM (SELECT split, truth AS cls FROM split_predictions
            UNION SELECT split, prediction FROM split_predictions) c)
GROUP BY split""", "split_predictions")
