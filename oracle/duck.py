"""Independent DuckDB SQL for every registered query.

base tables; shares no code with the Spark implementation.  Each derived
domain table is a CTE; ``build(body, *needs)`` prepends the CTEs a query needs
(with their dependencies, in order).
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (deps, sql)


def build(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    parts = [f"{n} AS (\n{CTES[n][1]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ------------------------------------------------------------- fixtures --
cte("profiles", """
  SELECT vec_id AS sig_id, vec_id // 10 AS pert_id,
         CASE WHEN (vec_id // 10) % 4 = 0 THEN 'trt_sh' ELSE 'trt_cp' END AS pert_type,
         CASE WHEN (vec_id // 10) % 4 = 0 THEN 'G' || CAST(vec_id % 37 AS VARCHAR)
              ELSE 'C' || lpad(CAST(vec_id // 10 AS VARCHAR), 4, '0') END AS cmap_name,
         CASE WHEN vec_id % 6 = 0 THEN '0' ELSE '1' END AS qc_pass,
         CAST(vec_id * 37 % 100 AS DOUBLE) / 100.0::DOUBLE AS tas,
         embedding, label
  FROM embeddings""")
cte("cp_profiles", "SELECT * FROM profiles WHERE pert_type = 'trt_cp'", "profiles")
cte("sh_profiles", "SELECT * FROM profiles WHERE pert_type = 'trt_sh'", "profiles")
cte("pert_moa", """
  SELECT pert_id, CASE WHEN pert_id = 7 THEN 'M99' ELSE 'M' || CAST(pert_id % 7 AS VARCHAR) END AS moa
  FROM (SELECT DISTINCT pert_id FROM cp_profiles WHERE pert_id % 5 <> 0)
  UNION
  SELECT pert_id, 'M' || CAST(7 + pert_id % 5 AS VARCHAR)
  FROM (SELECT DISTINCT pert_id FROM cp_profiles WHERE pert_id % 5 <> 0)
  WHERE pert_id % 3 = 0 AND pert_id <> 7""", "cp_profiles")
cte("ann_profiles", "SELECT * FROM cp_profiles WHERE pert_id IN (SELECT pert_id FROM pert_moa)",
    "cp_profiles", "pert_moa")
cte("unann_profiles", "SELECT * FROM cp_profiles WHERE pert_id NOT IN (SELECT pert_id FROM pert_moa)",
    "cp_profiles", "pert_moa")
cte("hits", """
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice, l.l_returnflag,
         o.o_custkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
cte("gene_sets", """
  SELECT DISTINCT l_returnflag AS library, 'S' || CAST(l_suppkey AS VARCHAR) || l_returnflag AS term,
         'P' || CAST(l_partkey AS VARCHAR) AS gene FROM lineitem
  UNION
  SELECT DISTINCT 'X' AS library, 'X' || CAST(p_size AS VARCHAR) AS term, 'P' || CAST(p_partkey AS VARCHAR) AS gene
  FROM part WHERE p_partkey % 10 = 0""")
cte("query_genes", """
  SELECT DISTINCT 'C' || CAST(o_custkey AS VARCHAR) AS compound, 'P' || CAST(l_partkey AS VARCHAR) AS gene
  FROM hits""", "hits")
cte("ranked_hits", """
  SELECT h.l_orderkey AS cp_sig, 'C' || CAST(h.o_custkey AS VARCHAR) AS compound,
         row_number() OVER (PARTITION BY h.l_orderkey
                            ORDER BY h.l_extendedprice DESC, h.l_linenumber, h.l_partkey, h.l_suppkey) AS rank,
         h.l_partkey AS ref_id, p.p_brand AS gene
  FROM hits h JOIN part p ON h.l_partkey = p.p_partkey""", "hits")
cte("signatures", """
  SELECT o.o_orderkey AS sig_id, a.distil_ids,
         CASE WHEN o.o_orderkey % 6 = 0 THEN '0' ELSE '1' END AS qc_pass,
         CASE WHEN o.o_orderstatus = 'F' THEN '1' ELSE '0' END AS is_hiq,
         CAST(a.cc_q75 AS VARCHAR) AS cc_q75, CAST(a.tas AS VARCHAR) AS tas,
         CAST(o.o_totalprice % 100 AS VARCHAR) AS batch_effect_tstat_pct,
         a.tas AS tas_d
  FROM (SELECT l_orderkey,
               array_to_string(list_sort(list(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)
                                              || ':' || CAST(l_partkey AS VARCHAR))), '|') AS distil_ids,
               avg(l_discount) * 10 AS tas, avg(l_tax) * 10 AS cc_q75
        FROM lineitem GROUP BY l_orderkey) a
  JOIN orders o ON a.l_orderkey = o.o_orderkey""")
cte("cp_signatures", """
  SELECT o.o_orderkey AS cp_sig, 'C' || CAST(o.o_custkey AS VARCHAR) AS compound, 'trt_cp' AS pert_type,
         CASE WHEN o.o_orderkey % 6 = 0 THEN '0' ELSE '1' END AS qc_pass, s.tas_d AS tas
  FROM orders o LEFT JOIN signatures s ON o.o_orderkey = s.sig_id""", "signatures")
cte("targets", """
  SELECT CASE WHEN o_custkey % 3 = 0 THEN 'c' ELSE 'C' END || CAST(o_custkey AS VARCHAR) AS compound,
         t.target_order,
         CASE WHEN o_custkey % 2 = 1 THEN upper('Brand#' || CAST(1 + o_custkey % t.m AS VARCHAR))
              ELSE 'Brand#' || CAST(1 + o_custkey % t.m AS VARCHAR) END AS target
  FROM (SELECT DISTINCT o_custkey FROM orders) c,
       (VALUES (1, 25), (2, 7)) t(target_order, m)""")
cte("calibration", """
  SELECT doc_id, lang,
         (ln(1 + n_chars::DOUBLE) - min(ln(1 + n_chars::DOUBLE)) OVER ())
         / (max(ln(1 + n_chars::DOUBLE)) OVER () - min(ln(1 + n_chars::DOUBLE)) OVER ()) AS measure,
         quality = 1 AS truth
  FROM documents JOIN labels USING (doc_id)""")


def rnd(expr: str, alias: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {alias}"
