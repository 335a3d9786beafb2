"""The stages on the smallest input: what each keeps, and its columns."""

import pytest

pytest.importorskip("pertscope.llm.queries")

import corpus_pipeline  # noqa: E402
from pertscope.llm import simhash_dedup  # noqa: E402
from pertscope.llm.common import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], SF), "test-stage"))
        assert kept[-1].columns == columns
    ids = [sorted(r[0] for r in k.select("doc_id").collect()) for k in kept]
    assert set(ids[1]) < set(ids[0]) and ids[2] == ids[1] and set(ids[3]) <= set(ids[2])
    classes = {r["component_id"] for r in simhash_dedup.clusters(kept[2]).collect()}
    assert ids[3] == sorted(classes)
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in set(ids[4])) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect()
    lengths = {}
    for p in pieces:
        lengths[p["sequence_id"]] = lengths.get(p["sequence_id"], 0) + p["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in lengths.values())
    total = {}
    for p in pieces:
        total.setdefault(p["doc_id"], [0, p["doc_tokens"]])[0] += p["length"]
    assert all(got == n * ids[4].count(i) for i, (got, n) in total.items())


def test_clean_documents_stay(spark):
    good = ("The first sentence of this text says something, and the second goes on with other words. "
            "Nothing here is repeated, shouted or left without an end, so nothing should be removed at all.")
    df = spark.createDataFrame([(1, good, "en", "s", len(good))],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = materialize(stage(spark, df, SF), "test-clean")
    assert [tuple(r) for r in df.collect()] == [(1, good, "en", "s", len(good))]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        assert df.count() == 0
