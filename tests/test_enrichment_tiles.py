"""Overlaps in tiles against sets, with a gene that stands in every list."""

import random
from collections import defaultdict

import numpy as np
import pytest

from pertscope.operators import enrichment as en


@pytest.mark.parametrize("block_genes", [60, 1 << 20])
def test_overlaps(spark, monkeypatch, block_genes):
    monkeypatch.setattr(en, "PAIRS", 50)
    rng = random.Random(2)
    genes = [f"G{i}" for i in range(60)]
    compounds = {f"C{i}": {"G0", *rng.sample(genes, rng.randint(0, 20))} for i in range(30)}
    compounds["none"] = {"absent"}
    terms = {f"T{i}": {"G0", *rng.sample(genes, rng.randint(0, 25))} for i in range(40)}
    terms["small"], terms["T0"] = {"G0", "G1"}, set(genes[:30])
    q = spark.createDataFrame([(c, g) for c, s in compounds.items() for g in s] + [("C1", "G0")], "compound string, gene string")
    t = spark.createDataFrame([("L", n, g) for n, s in terms.items() for g in s], "library string, term string, gene string")
    got = {(r["compound"], r["term"]): (r["k"], r["n_genes"]) for r in en.term_overlap(q, t, 10, 26, block_genes).collect()}
    want = {(c, n): (len(s & x), len(x)) for c, s in compounds.items() for n, x in terms.items()
            if 10 <= len(x) <= 26 and s & x}
    assert got == want and "small" not in {n for _, n in got}
    most = defaultdict(int)
    for (c, _), (k, size) in want.items():
        most[c, size] = max(most[c, size], k)
    rows = en.largest_overlaps(q.distinct(), t, 10, 26, block_genes).collect()
    assert {(r["compound"], r["n_genes"]): r["k"] for r in rows} == dict(most) and len(rows) == len(most)


def test_a_gene_in_every_list_is_dealt_out(spark):
    # 300 lists share one gene: every tile of 16 gets its part of it
    q = spark.createDataFrame([(f"C{i}", g) for i in range(300) for g in ("hot", f"own{i}")], "compound string, gene string")
    t = spark.createDataFrame([("L", f"T{i}", g) for i in range(300) for g in ("hot", f"own{i}")],
                              "library string, term string, gene string")
    sizes = []

    def seen(left, right):
        import pandas as pd
        return pd.DataFrame({"n": [len(left) * len(right)]})

    tiles = en._tiles(q, en._sized_genes(t, 1, 10), seen, "n long", 150)
    sizes = [r["n"] for r in tiles.collect()]
    assert len(sizes) == 16 and max(sizes) < 5 * np.median(sizes)
    rows = en.largest_overlaps(q, t, 1, 10, 150).collect()
    assert sorted(r["k"] for r in rows) == [2] * 300


def test_a_block_gets_only_the_terms_of_its_genes(spark):
    # lists that share no gene: every entry goes to one tile, not to every block of the other side
    q = spark.createDataFrame([(f"C{i}", f"own{i}") for i in range(400)], "compound string, gene string")
    t = spark.createDataFrame([("L", f"T{i}", f"own{i}") for i in range(400)], "library string, term string, gene string")

    def seen(left, right):
        import pandas as pd
        return pd.DataFrame({"n": [len(left) + len(right)]})

    rows = en._tiles(q, en._sized_genes(t, 1, 10), seen, "n long", 50).collect()
    assert sum(r["n"] for r in rows) < 2 * 800


@pytest.mark.parametrize("term_genes", [7, 1 << 20])
def test_blocks_cut_by_terms(spark, monkeypatch, term_genes):
    monkeypatch.setattr(en, "PAIRS", 9)
    compounds = {f"C{i}": {"hot", f"G{i % 5}"} for i in range(20)} | {None: {"hot"}}
    terms = {f"T{i}": {"hot", f"G{i % 3}", *(f"x{i}_{j}" for j in range(i % 4))} for i in range(15)}
    q = spark.createDataFrame([(c, g) for c, s in compounds.items() for g in s], "compound string, gene string")
    t = spark.createDataFrame([("L", n, g) for n, s in terms.items() for g in s], "library string, term string, gene string")
    rows = en.term_overlap(q, t, 1, 9, 12, term_genes).collect()
    want = {(c, n): (len(s & x), len(x)) for c, s in compounds.items() for n, x in terms.items()}
    assert {(r["compound"], r["term"]): (r["k"], r["n_genes"]) for r in rows} == want and len(rows) == len(want)
    most = {}
    for (c, _), (k, size) in want.items():
        most[c, size] = max(most.get((c, size), 0), k)
    rows = en.largest_overlaps(q, t, 1, 9, 12, term_genes).collect()
    assert {(r["compound"], r["n_genes"]): r["k"] for r in rows} == most and len(rows) == len(most)
