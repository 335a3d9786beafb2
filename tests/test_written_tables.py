"""What lies on the disk while ranked lists and overlaps are made."""

import glob

from pertscope.operators import enrichment as en
from pertscope.operators import ranking as rk
from pertscope.plans import confidence as cf
from pertscope.plans import gene_ranking as gr
from pertscope.session import ensure_checkpoint_dir, materialize


def _tables(spark, name):
    return set(glob.glob(f"{ensure_checkpoint_dir(spark)}/tables/{name}-*"))


def _write(spark, folder):
    tables = {"lineitem": ([(o, (o * 7 + n) % 30 + 1, o % 3, n, float(n * o % 9), 0.1, 0.2, "A") for o in range(60) for n in range(5)],
                           "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                           "l_discount double, l_tax double, l_returnflag string"),
              "orders": ([(o, o % 7, "F", float(o)) for o in range(60)],
                         "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"),
              "part": ([(p, f"Brand#{p % 11}", p % 4) for p in range(1, 31)], "p_partkey long, p_brand string, p_size int")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(folder / f"{name}.parquet"))


def test_written_tables_are_packed(spark):
    before = _tables(spark, "packed")
    materialize(spark.range(10), "packed")
    new, = _tables(spark, "packed") - before
    assert glob.glob(f"{new}/*.zstd.parquet")


def test_hits_are_ranked_before_they_are_counted(spark, tmp_path):
    _write(spark, tmp_path)
    cg = gr.robustness_tables(spark, str(tmp_path))[1]
    assert "l_extendedprice" not in cg._jdf.queryExecution().executedPlan().toString()
    assert cg.count() > 0


def test_confidence_reads_a_written_ranking(spark, tmp_path):
    _write(spark, tmp_path)
    before = _tables(spark, "robustness")
    rows = cf.confidence_table(spark, str(tmp_path)).collect()
    assert len(_tables(spark, "robustness") - before) == 1 and len(rows) == 7


def test_repeated_terms_and_genes_count_once(spark):
    gs = spark.createDataFrame([("L", "T", f"G{i % 12}") for i in range(40)] + [("L", None, "G1"), ("L", "T", None)],
                               "library string, term string, gene string")
    q = spark.createDataFrame([("C", f"G{i}") for i in range(5)] + [("C", None)], "compound string, gene string")
    assert [tuple(r) for r in en.term_overlap(q, gs, 1, 50).collect()] == [("C", "T", 6, 13)]
    before = _tables(spark, "term-lists")
    en.term_overlap(q, gs, 1, 50).count()
    assert len(_tables(spark, "term-lists") - before) == 1


def test_support_counts_signatures_with_an_id(spark):
    pairs = spark.createDataFrame([(1, "C", "g"), (None, "C", "g"), (2, "C", "g"), (None, "D", None)],
                                  "cp_sig long, compound string, gene string")
    for parts in (None, 3):
        assert sorted(map(tuple, rk.support_counts(pairs, parts=parts).collect()), key=str) == [("C", "g", 2), ("D", None, 0)]
