"""Bucketed orderings compare keys in their own type."""
import pytest

from pertscope.operators.nulls import exact_positions, permute_labels
from pertscope.operators.ranks import prefix_agg

BIG = 2 ** 53


@pytest.mark.parametrize("kind, keys", [
    ("string", [f"brd-{i * 7919 % 1000:03d}" for i in range(300)]),
    ("long", [BIG + i for i in range(60)] + [-BIG - i for i in range(60)]),
    ("double", [0.1 * i for i in range(100)]),
])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sum_in_key_order(spark, kind, keys, descending):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {kind}, n long")
    got = {r.k: r.n_before for r in prefix_agg(df, "k", ["n"], descending=descending, n_buckets=16).collect()}
    want, total = {}, 0
    for k, n in sorted(((k, n) for n, k in enumerate(keys)), reverse=descending):
        want[k], total = total, total + n
    assert got == want


def test_null_keys_come_first_both_ways(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 4)], "k string, n long")
    for descending, want in ((False, {None: 0, "a": 4, "b": 5}), (True, {None: 0, "b": 4, "a": 6})):
        got = {r.k: r.n_before for r in prefix_agg(df, "k", ["n"], descending=descending).collect()}
        assert got == want


def test_empty_string_table(spark):
    df = spark.createDataFrame([], "k string, n long")
    assert prefix_agg(df, "k", ["n"]).count() == 0


def test_positions_of_large_neighbouring_ids(spark):
    df = spark.createDataFrame([(BIG + i, BIG + i) for i in range(50)], "k long, t long")
    assert {r.k - BIG: r.pos for r in exact_positions(df, "k", "t").collect()} == {i: i + 1 for i in range(50)}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_permutation_of_any_id_type(spark, kind):
    ids = [f"sig{i}" if kind == "string" else BIG + i for i in range(40)]
    refs = spark.createDataFrame([(r, f"G{i}") for i, r in enumerate(ids)], f"ref_id {kind}, gene string")
    rows = permute_labels(refs, 3, seed=5).collect()
    for p in range(3):
        one = [r for r in rows if r.perm == p]
        assert sorted(r.ref_id for r in one) == sorted(ids)
        assert sorted(r.gene for r in one) == sorted(f"G{i}" for i in range(40))
