"""Shuffles that go when a table is written, and tiles in rounds."""

import glob
import os
import random
import time

import pytest

from pertscope import session
from pertscope.operators import enrichment as en
from pertscope.operators import ranking as rk
from pertscope.plans import confidence as cf
from pertscope.plans import gene_ranking as gr
from pertscope.session import _CLEANUP, drop_tables, ensure_checkpoint_dir, materialize, materialize_rounds
from pertscope.sources import fixtures as fx
from pertscope.sources.tables import Tables


def _shuffles(spark):
    top = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS", "/tmp")
    return set(glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data") + glob.glob(f"{top}/spark-*/blockmgr-*/*/shuffle_*.data"))


def test_a_written_table_leaves_no_shuffle_behind(spark):
    before = _shuffles(spark)
    rows = materialize(spark.range(1000).selectExpr("id % 13 AS k").groupBy("k").count(), "counted")
    for _ in range(50):
        if not _shuffles(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffles(spark) - before and rows.count() == 13
    assert spark.conf.get(_CLEANUP, "false") == "false"       # the session is left as it was


@pytest.mark.parametrize("rounds", [1, 3])
def test_rounds_give_the_rows_of_one_run(spark, rounds):
    rng = random.Random(5)
    genes = [f"G{i}" for i in range(40)]
    q = spark.createDataFrame([(f"C{i}" if i else None, g) for i in range(25) for g in rng.sample(genes, 12)],
                              "compound string, gene string")
    t = spark.createDataFrame([("L", f"T{i}", g) for i in range(30) for g in rng.sample(genes, 5 + i % 9)],
                              "library string, term string, gene string")
    whole = sorted(map(str, en.term_overlap(q, t, 1, 20, 30).collect()))
    turns = en.term_overlap(q, t, 1, 20, 30, each=lambda x: x, rounds=rounds)
    assert sorted(map(str, turns.collect())) == whole
    best = [sorted(map(str, en.compound_best_p(q, t, 1, 20, rounds=n).collect())) for n in (1, rounds)]
    assert best[0] == best[1]


def _tables(spark, name="*"):
    return set(glob.glob(f"{ensure_checkpoint_dir(spark)}/tables/{name}-*"))


def _write(spark, folder):
    rng = random.Random(8)
    flags = ["A", "N", "R", None]
    tables = {"lineitem": ([(o, rng.randint(1, 40), o % 3, n, float(rng.randint(1, 9)), 0.1, 0.2, flags[o % 4]) for o in range(80) for n in range(5)]
                           + [(None, 1, 1, 1, 1.0, 0.1, 0.2, "A"), (3, None, 1, 9, 1.0, None, 0.2, "R")],
                           "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                           "l_discount double, l_tax double, l_returnflag string"),
              "orders": ([(o, o % 9 if o % 13 else None, "F", float(o)) for o in range(85)],
                         "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"),
              "part": ([(p, f"Brand#{p % 11}" if p % 7 else None, p % 4) for p in range(1, 41)], "p_partkey long, p_brand string, p_size int")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(folder / f"{name}.parquet"))


def test_rounds_of_tables_give_the_rows_of_one_write(spark, tmp_path, monkeypatch):
    _write(spark, tmp_path)
    d = str(tmp_path)
    t = Tables(spark, d)
    rows = lambda df: sorted(str(r) for r in df.collect())
    makers = [lambda: gr.robustness_tables(spark, d)[0], lambda: gr.written_signatures(spark, t), lambda: cf.gene_sets(t),
              lambda: cf.overlap_report(t), lambda: gr.recovery(spark, d).drop("enrich_score_raw", "composite_score")]
    whole = [rows(m()) for m in makers]
    assert whole[0] == rows(rk.topk_unique_per_row(fx.ranked_hits(t))) and whole[1] == rows(fx.cp_signatures(t))
    monkeypatch.setattr(session, "ROUND_ROWS", 100)
    assert session.rounds_of(400) == session.ROUNDS
    for make, want in zip(makers, whole):
        assert rows(make()) == want and want


def test_a_round_is_gone_before_the_next_is_made(spark):
    before, seen = _shuffles(spark), []

    def make(i):
        for _ in range(50):
            if not _shuffles(spark) - before:
                break
            time.sleep(0.2)
        seen.append(len(_shuffles(spark) - before))
        return spark.range(1000).where(session.in_round("id", i, 3)).selectExpr("id % 13 AS k", "id").repartition(5, "k")

    assert materialize_rounds(spark, make, 3, "turned").count() == 1000 and seen == [0, 0, 0]


def test_tables_that_nothing_reads_are_dropped(spark, tmp_path):
    before = _tables(spark)
    one, two = (materialize(spark.range(3), "kept-or-not") for _ in range(2))
    drop_tables(one)
    assert len(_tables(spark) - before) == 1 and two.count() == 3
    _write(spark, tmp_path)
    before = _tables(spark)
    out = cf.best_p(Tables(spark, str(tmp_path)))
    left = {os.path.basename(x).rsplit("-", 1)[0] for x in _tables(spark) - before}
    assert left == {"enrichment_best_p"} and out.count() > 0
