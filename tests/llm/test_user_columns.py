"""Columns of the user keep their values through every operator that returns
documents, whatever their names; and the chat parser rejects what it must."""

import pytest

pytest.importorskip("pertscope.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from pertscope.llm import chat_format, line_dedup, mixing, packing, quality_rules, simhash_dedup  # noqa: E402
from pertscope.llm.common import materialize  # noqa: E402
from pertscope.llm.queries import tokenizer_path  # noqa: E402

NAMES = ("_text", "_th", "_id", "_row", "row", "n_words", "kept", "cleaned", "key", "fp", "runs", "cut", "_w", "_lines",
         "_keep", "id", "th", "rid", "rth", "deleted", "n_deleted", "component_id", "size", "_copies", "_s", "_key", "_")


def _sentences(k, n=4):
    return "\n".join(" ".join(f"w{k}x{j}x{i}" for i in range(15)) + "." for j in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    passage = "\n".join("Passage line " + " ".join(f"p{j}x{i}" for i in range(15)) + "." for j in range(6))
    rows = [(k, _sentences(k) + ("\n" + passage if k % 3 == 0 else "") + ("\nhome | menu | links" if k % 2 else ""),
             "en", f"s{k % 2}", 7) for k in range(12)]
    rows += [(40, rows[1][1], "en", "s1", 7), (None, _sentences("without id"), "en", None, 7), (50, None, "en", "s1", None),
             (51, "", "en", "s1", 0), rows[2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in NAMES:
        df = df.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return materialize(df, "test-user-columns")


def _untouched(before, after):
    """Every value of a column that is not the operator's own belongs to its document."""
    assert after.columns == before.columns
    rows = after.collect()
    for r in rows:
        of = "none" if r["doc_id"] is None else str(r["doc_id"])
        assert {n: r[n] for n in NAMES} == {n: f"{n} of {of}" for n in NAMES}
        assert r["lang"] == "en"
        assert r["n_chars"] in (7, None, len(r["text"] or ""))
    return rows


def test_quality_rules(docs):
    rows = _untouched(docs, quality_rules.clean(docs))
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted([*range(12), 2, 40])
    assert not any("menu" in r["text"] for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_line_dedup(docs):
    rows = _untouched(docs, line_dedup.dedup_lines(docs))
    assert len(rows) == docs.count()
    assert sum("p0x0" in (r["text"] or "") for r in rows) == 1
    report = line_dedup.dedup_report(docs)
    assert report.columns == ["row", "text", "n_lines", "n_deleted", "deleted"]
    assert {r["row"]["deleted"] for r in report.collect()} >= {"deleted of 1", "deleted of none"}


def test_simhash(docs):
    rows = _untouched(docs, simhash_dedup.keep_one(docs))
    # copies of one text, a repeated row, and the two texts without words leave one each
    ids = [r["doc_id"] for r in rows]
    assert 40 not in ids and ids.count(2) == 1 and ids.count(None) == 1 and sum(i in (50, 51) for i in ids) == 1


def test_mix(docs):
    _untouched(docs, mixing.mix(docs))


def test_four_stages_and_packing(spark, docs):
    df = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = materialize(stage(spark, df, ""), "test-stage")
        _untouched(docs, df)
    pieces = corpus_pipeline.STAGES[-1][1](spark, df, "")
    assert pieces.columns[0] == "doc_id" and pieces.count() >= df.count()


def test_packing_of_text_ids_with_a_null(spark):
    df = spark.createDataFrame([("a", "one two"), (None, "three"), ("b", None)], "doc_id string, text string").coalesce(1)
    got = packing.pack_documents(df, tokenizer_path()).collect()
    assert {r["doc_id"] for r in got} == {"a", None, "b"}


S, E = chat_format.START, chat_format.STOP


@pytest.mark.parametrize("text, turns", [
    ("", []),
    (f"{S}user\nhi\n{E}\n", [("user", "hi")]),
    (f"{S}user\n\n{E}\n{S}a;url\nb%0A\n{E}\n", [("user", ""), ("a", "b\n")]),
    (f"{S}user\nhi \\{E} there \\{S}\n{E}\n", [("user", f"hi {E} there {S}")]),
    (f"{S}user\nhi\n", None),                                 # no end mark
    (f"{S}user\nhi\n{E}", None),                              # no line feed behind it
    (f"{S}user\nhi{E}\n", None),                              # none before it
    (f"{S}user\nhi\n{E}\nmore\n{E}\n", None),                 # a bare end mark inside
    (f"{S}user\nhi\n{E}\n{E}\n", None),                       # doubled
    (f"{S}user\n{E}\n", None),                                # no body
    (f"{S}user {E}\n", None),
    (f"x{S}user\nhi\n{E}\n", None),                           # text outside the marks
    (f"{S}user\nhi\n{E}\nx", None),
    (f"{S}user\n{S}user\nhi\n{E}\n", None),                   # a start inside
    (f"{S}us er\nhi\n{E}\n", None),                           # a head that no rendering has
    ("plain", None),
    (None, None)])
def test_chat_grammar(spark, text, turns):
    df = spark.createDataFrame([(text,)], "x string")
    got = df.select(chat_format.parse(F.col("x")).alias("t")).first()["t"]
    assert (got if got is None else [tuple(t) for t in got]) == turns
