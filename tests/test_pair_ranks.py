"""Pair statistics without pair rows against all pairs in numpy."""

import numpy as np
import pytest

from pertscope.operators.cross_reduce import cross_distances, cross_summary, label_rank
from pertscope.operators.pair_ranks import pair_auroc, pair_percentile
from pertscope.operators.set_similarity import similar_pairs, tanimoto_extreme
from pertscope.plans.recap import kde_grid

ROWS = "g string, id long, v array<double>, w array<double>, label string"


def _rows(seed=1, n=70):
    rng = np.random.default_rng(seed)
    out = []
    for g, m in (("a", n), ("b", 25), ("one", 1)):
        for i in range(m):
            v, w = rng.normal(size=6), rng.normal(size=4)
            out.append((g, 1000 + i, v.tolist(), w.tolist(), None if i % 11 == 0 else f"L{i % 5}"))
    # a zero vector, a null one, and rows alike
    out += [("a", 1, [0.0] * 6, [1.0, 0.0, 0.0, 0.0], "L0"), ("a", 2, None, [0.0, 1.0, 0.0, 0.0], "L1")]
    out += [("a", 10 + i, out[0][2], out[0][3], "L0") for i in range(4)]
    return out


def _unit(v):
    n = np.linalg.norm(v) if v is not None else 0
    return None if n == 0 else np.asarray(v) / n


def _pairs(rows, g, col):
    """(row, row, similarity) of the group's pairs with a cosine."""
    mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
    for i, a in enumerate(mine):
        for b in mine[i + 1:]:
            x, y = _unit(a[col]), _unit(b[col])
            if x is not None and y is not None:
                yield a, b, float(x @ y)


def _auroc(pos, neg):
    if not pos or not neg:
        return None
    return sum(0.5 if abs(p - n) < 1e-12 else float(p > n) for p in pos for n in neg) / len(pos) / len(neg)


@pytest.mark.parametrize("block_rows, chunk", [(7, 3), (4096, 1 << 20)])
def test_auroc_of_equal_labels(spark, block_rows, chunk):
    rows = _rows()
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {(r["g"], r["space"]): r for r in pair_auroc(
        df, "id", {"first": "v", "second": "w"}, ["g"], label_col="label", block_rows=block_rows, chunk=chunk).collect()}
    for g in ("a", "b"):
        for space, col in (("first", 2), ("second", 3)):
            pos, neg = [], []
            for a, b, s in _pairs(rows, g, col):
                if a[4] is not None and b[4] is not None:
                    (pos if a[4] == b[4] else neg).append(s)
            r = got[g, space]
            assert (r["n_pos"], r["n_neg"]) == (len(pos), len(neg))
            assert r["auroc"] == pytest.approx(_auroc(pos, neg), abs=1e-9)
    assert all(k[0] != "one" or r["auroc"] is None for k, r in got.items())


@pytest.mark.parametrize("block_rows, q", [(9, 0.013), (9, 1.0), (4096, 0.0), (4096, 0.013), (4096, 0.5)])
def test_percentile_and_reference_positives(spark, block_rows, q):
    rows = _rows(2)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    told = pair_percentile(df, "id", "w", q, ["g"], block_rows)
    found = {r["g"]: r for r in told.collect()}
    for g in ("a", "b"):
        d = [1 - s for _, _, s in _pairs(rows, g, 3)]
        assert found[g]["n"] == len(d) and found[g]["threshold"] == pytest.approx(np.quantile(d, q), abs=1e-12)
    if q == 0.013:
        auc = {r["g"]: r for r in pair_auroc(df, "id", {"first": "v"}, ["g"], reference=("w", told),
                                             block_rows=block_rows).collect()}
        for g in ("a", "b"):
            ref = {(a[1], b[1]): 1 - s for a, b, s in _pairs(rows, g, 3)}
            pos, neg = [], []
            for a, b, s in _pairs(rows, g, 2):
                (pos if ref[a[1], b[1]] < found[g]["threshold"] - 1e-12 else neg).append(s)
            assert (auc[g]["n_pos"], auc[g]["n_neg"]) == (len(pos), len(neg)) and pos
            assert auc[g]["auroc"] == pytest.approx(_auroc(pos, neg), abs=1e-9)


@pytest.mark.parametrize("block_rows", [6, 4096])
def test_listed_positives_in_any_order_without_groups(spark, block_rows):
    rows = [r for r in _rows(3) if r[0] == "a"]
    df = spark.createDataFrame(rows, ROWS)
    ids = sorted(r[1] for r in rows)
    listed = [(ids[k], ids[-1 - k]) for k in range(9)] + [(ids[-3], ids[2]), (ids[5], 999999)]
    got = pair_auroc(df, "id", {"first": "v"}, listed=spark.createDataFrame(listed, "id_a long, id_b long"),
                     block_rows=block_rows).collect()
    want = {frozenset(p) for p in listed}
    pos, neg = [], []
    for a, b, s in _pairs(rows, "a", 2):
        (pos if frozenset((a[1], b[1])) in want else neg).append(s)
    assert len(got) == 1 and got[0].asDict() == {
        "space": "first", "n_pos": len(pos), "n_neg": len(neg), "auroc": pytest.approx(_auroc(pos, neg), abs=1e-9)}


# ------------------------------------------------------------ similarity join --

def _sets(seed, n, width=60):
    rng = np.random.default_rng(seed)
    return [sorted(set(rng.integers(0, width, rng.integers(1, 25)).tolist())) for _ in range(n)]


def _tanimoto(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0


@pytest.mark.parametrize("least", [0.05, 1 / 3, 0.8, 1.0])
def test_similar_pairs(spark, least):
    sets = {tuple(s) for s in _sets(4, 120)}
    sets = dict(enumerate(sorted(sets)))
    df = spark.createDataFrame([(k, list(s)) for k, s in sets.items()], "set_id long, bits array<int>")
    got = {(r["a"], r["b"]): r["similarity"] for r in similar_pairs(df, least).collect()}
    want = {(i, j): _tanimoto(sets[i], sets[j]) for i in sets for j in sets if i < j}
    want = {k: s for k, s in want.items() if s >= least}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("q", [0.0, 0.03, 1.0])
def test_tanimoto_extreme(spark, q):
    sets = _sets(5, 60)
    sets += [sets[0], sets[0], sets[3], [], [], None]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, bits array<int>").withColumnRenamed("id", "key")
    told, below = tanimoto_extreme(df, "key", "bits", q)
    d = {(i, j): 1 - _tanimoto(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets)
         if i < j and a is not None and b is not None}
    threshold = np.quantile(list(d.values()), q)
    r = told.first()
    assert r["pairs"] == len(d) and r["threshold"] == pytest.approx(threshold, abs=1e-12)
    got = {(x["id_a"], x["id_b"]): x["distance"] for x in below.collect()}
    assert got == pytest.approx({k: x for k, x in d.items() if x < r["threshold"]})


def test_tanimoto_of_nothing(spark):
    told, below = tanimoto_extreme(spark.createDataFrame([], "key long, bits array<int>"), "key", "bits", 0.001)
    assert [tuple(r) for r in told.collect()] == [(0, None)] and below.collect() == []


# ------------------------------------------------------------- reducing tiles --

@pytest.mark.parametrize("block_rows", [5, 4096])     # with 5 the label of 30 rows is hot
def test_cross_reductions(spark, block_rows):
    rng = np.random.default_rng(7)
    refs = [(100 + i, "hot" if i < 30 else f"N{i % 9}", rng.normal(size=5).tolist()) for i in range(80)]
    refs += [(200, "zero", [0.0] * 5), (201, None, rng.normal(size=5).tolist()), (202, "N3", refs[40][2])]
    queries = [(i, ["hot", "N1", "N3", "zero", "absent", None][i % 6], rng.normal(size=5).tolist()) for i in range(24)]
    q = spark.createDataFrame(queries, "id long, name string, v array<double>")
    r = spark.createDataFrame(refs, "id long, cmp string, v array<double>")
    args = ("id", "v", "name", "cmp", block_rows)
    d = {}
    for i, a, v in queries:
        for j, b, w in refs:
            x, y = _unit(v), _unit(w)
            d[i, j] = (None if x is None or y is None else 1 - float(x @ y), a is not None and a == b)
    got = {(x["id_a"], x["id_b"]): (x["distance"], x["same"]) for x in cross_distances(q, r, *args).collect()}
    assert got.keys() == d.keys()
    assert all(got[k][1] == d[k][1] and got[k][0] == (None if d[k][0] is None else pytest.approx(d[k][0], abs=1e-12))
               for k in d)
    summary = {(x["id_a"], x["same"]): x for x in cross_summary(q, r, *args).collect()}
    for i, _, _ in queries:
        for same in (False, True):
            mine = [x for (k, _), (x, s) in d.items() if k == i and s == same]
            there = [x for x in mine if x is not None]
            assert ((i, same) in summary) == bool(mine)
            if mine:
                x = summary[i, same]
                assert x["n"] == len(mine)
                assert x["mean_distance"] == (pytest.approx(np.mean(there)) if there else None)
                assert x["min_distance"] == (pytest.approx(min(there), abs=1e-12) if there else None)
    ranks = {x["id"]: x for x in label_rank(q, r, *args).collect()}
    names = sorted({b for _, b, _ in refs if b is not None})
    for i, a, _ in queries:
        if a not in names:
            assert i not in ranks
            continue
        least = {}
        for j, b, _ in refs:
            if b is not None:
                x = d[i, j][0]
                least[b] = min(least.get(b, np.inf), np.inf if x is None else x)
        order = sorted(names, key=lambda b: (-np.inf if least[b] == np.inf else round(least[b], 12), b))
        assert (ranks[i]["rank0"], ranks[i]["n_compounds"]) == (order.index(a), len(names))
        assert ranks[i]["true_distance"] == (None if least[a] == np.inf else pytest.approx(least[a], abs=1e-12))


def test_kde_grid(spark):
    rng = np.random.default_rng(8)
    samples = [("x", float(v)) for v in rng.normal(size=300)] + [("y", float(v)) for v in rng.normal(3, 2, 50)]
    samples += [("alone", 0.5), ("x", None)]
    got = {(r["set"], r["g"]): r for r in kde_grid(
        spark.createDataFrame(samples, "set string, d double").repartition(4), "d", "set", 40).collect()}
    values = [v for _, v in samples if v is not None]
    at = np.linspace(min(values), max(values), 40)
    for name in ("x", "y"):
        v = np.array([x for n, x in samples if n == name and x is not None])
        bw = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-0.5 * ((at[:, None] - v[None]) / bw) ** 2).sum(axis=1) / (len(v) * bw * np.sqrt(2 * np.pi))
        assert [got[name, g]["density"] for g in range(40)] == pytest.approx(want.tolist())
        assert [got[name, g]["x"] for g in range(40)] == pytest.approx(at.tolist())
    assert all(got["alone", g]["density"] is None for g in range(40))


def test_samples_are_read_once_or_twice(spark):
    from pertscope.operators.stats import ecdf
    from pertscope.plans import recap

    seen = spark.sparkContext.accumulator(0)

    def told(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.createDataFrame([("a" if i % 3 else "b", (i * 7 % 40) / 40.0) for i in range(60)], "set string, v double")
    rows = rows.mapInPandas(told, "set string, v double")
    assert len(kde_grid(rows, "v", "set", 20).collect()) == 40 and seen.value == 120
    assert ecdf(rows, "v", by=["set"]).count() and seen.value == 180
    rng = np.random.default_rng(3)
    values, at = rng.normal(size=3000), np.linspace(-4, 4, 50)
    for bw in (0.01, 0.5):
        plain = np.exp(-0.5 * ((at[None, :] - values[:, None]) / bw) ** 2).sum(axis=0)
        assert np.allclose(recap._kernels(values, at, bw), plain, rtol=1e-12, atol=0)
