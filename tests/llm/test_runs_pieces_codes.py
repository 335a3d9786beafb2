"""Periodic runs, SentencePiece and vector codes against plain versions on small
tables with the odd cases: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("pertscope.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from pertscope.llm import periodic_runs, pieces, queries, vector_codes  # noqa: E402

SCHEMA = "doc_id long, text string, runs string, n_words string, row string, ids string, _row int"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "  x  y x y\nx y\tx y ", "ab " * 3000,
           "é漢 😀 " * 40, "x y z " * 400 + "x", " leading", "trailing  ", "▁ ▁▁ a"]
    for _ in range(40):
        t = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.choice("abcdef") for _ in range(rng.randint(1, 30))]
            t += unit * rng.randint(1, 9) + unit[:rng.randint(0, len(unit))]
        out.append(" ".join(t))
    out += ["".join(chr(rng.choice([32, 10, rng.randint(33, 126), 0xe9, 0x4e00 + rng.randint(0, 99)]))
                    for _ in range(500)) for _ in range(20)]
    return out + [out[15], out[16], out[16]]


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    rows = [(k * 7, t, "mine", "ours", "r", "i", 5) for k, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, "t t t t t t t", "mine", "ours", "r", "i", 5)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


# 11 ------------------------------------------------------------------------

def plain_runs(w):
    """All stretches for all periods; the smallest period of each stays."""
    best = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(6, 4 * p):
                best.setdefault((s, i - s + p), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (doc_id, len(runs), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_query(spark, rows, folder):
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, folder).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted((plain_row(r[0], r[1]) for r in rows), key=key)
    assert sum(r[1] for r in got) > 40 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)


def test_periodic_tails_are_edited_as_the_contract_says(spark):
    ids = [k for k in range(20000) if zlib.crc32(str(k).encode()) % 10 == 0][:300]
    rng = random.Random(8)
    rows = [(k, " ".join(str(rng.randint(0, 99)) for _ in range(rng.randint(0, 60)))) for k in ids]
    edited = {r["doc_id"]: r["text"] for r in queries._with_periodic_tails(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        w, g = text.split(), zlib.crc32(str(k).encode()) // 10
        if w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        assert edited[k].split() == w


def test_every_pair_of_residues_reaches_the_cover():
    assert periodic_runs.SHIFT.min() >= 0 and periodic_runs.SHIFT.max() < periodic_runs.MODULUS
    inside = set(periodic_runs.COVER.tolist())
    for i in range(31):
        for j in range(31):
            d = int(periodic_runs.SHIFT[i, j])
            assert (i + d) % 31 in inside and (j + d) % 31 in inside


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_extensions(letters):
    rng = np.random.default_rng(letters)
    seq = np.concatenate([rng.integers(0, letters, 400), [letters]])
    ext = periodic_runs.Extensions(seq)
    i, j = rng.integers(0, 400, 3000), rng.integers(0, 400, 3000)
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i, j, ext.lce(i, j)):
        m = 0
        while max(a, b) + m < 401 and seq[a + m] == seq[b + m]:
            m += 1
        assert n == m


def test_runs_meet_no_other_document_of_their_slice(spark):
    # the last words of each document go on in the next one
    rows = [(k, "p q " * (k + 1) + "p") for k in range(12)] + [(50 + k, "p q p") for k in range(30)]
    got = periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert [tuple(x) for x in r["runs"]] == plain_runs(text.split())
        assert r["n_words"] == len(text.split())
        assert r["collapsed"] == ("p q" if r["runs"] else " ".join(text.split()))


# 12 ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))


def test_pieces_query(spark, rows, folder, library):
    got = [tuple(r) for r in queries.op12_sentencepiece(spark, folder).collect()]
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_eos=True)
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_pieces_keep_other_columns_and_decode_null(spark, rows, library):
    docs = spark.createDataFrame(rows, SCHEMA)
    path = queries.tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(docs, path, out_col="tokens")
    assert sorted(tuple(r["row"]) for r in encoded.collect() if r["row"]["doc_id"] is not None) == sorted(
        r for r in rows if r[0] is not None)
    back = pieces.decode(encoded, path, ids_col="tokens", out_col="again")
    assert all(r["again"] == library.decode(r["tokens"]) for r in back.collect())
    lists = spark.createDataFrame([(1, None), (2, []), (3, [2])], "_row int, ids array<int>")
    assert {tuple(r) for r in pieces.decode(lists, path).select("_row", "decoded").collect()} == {
        (1, None), (2, ""), (3, "")}


def test_pieces_of_random_texts(library):
    encoder = pieces.Encoder(queries.tokenizer_path("piece_bpe_32k.model"), memo=500)
    rng = random.Random(4)
    vocabulary = [library.id_to_piece(k).replace("▁", " ") for k in range(259, 32000)]
    texts = ["".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(rng.choice("ab \n\t_-=.é漢\x00<s>▁") for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    # one very long word of many merges, and runs whose pairs overlap
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30000)), "a" * 4001, " " * 777, "=" * 999]
    for at in range(0, len(texts), 300):
        some = texts[at:at + 300]
        got = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(some)]
        assert got == library.encode(some)
        assert all(len(w) <= pieces.LONG for w in encoder.known)


def test_decode_any_ids(library):
    table = pieces.Pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(9)
    lists = [[rng.choice([rng.randint(0, 31999), rng.randint(3, 258), 0, 1, 2]) for _ in range(rng.randint(0, 12))]
             for _ in range(4000)]
    got = table.decode_flat(np.array([x for own in lists for x in own]), np.cumsum([0, *map(len, lists)]))
    assert got == library.decode(lists)
    with pytest.raises(ValueError):
        table.decode_flat(np.array([32000]), np.array([0, 1]))


# 13 ------------------------------------------------------------------------

def plain_codes(vectors, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in vectors
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[1]))[:entries]
    w = len(seeds[0][1]) // parts
    cut = lambda v, k: v[k * w:(k + 1) * w]
    books = [[cut(s[1], k) for s in seeds] for k in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for k in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(near(cut(v, k), books[k])[0], []).append(cut(v, k))
            for e, group in held.items():
                books[k][e] = [sum(c) // len(group) for c in zip(*group)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [near(cut(v, k), books[k]) for k in range(parts)]
        error = sum(d for _, d in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return [(i, c, e, by_label[label], digest) for i, c, e, label in out]


def _vectors(n, width=8, seed=1):
    rng = np.random.default_rng(seed)
    out = [(int(k), [float(x) for x in rng.normal(0, 0.02, width).round(3)], int(k) % 3 if k % 7 else None)
           for k in range(n)]
    out += [(9000 + k, out[5][1], 1) for k in range(200)]                  # a third of all rows alike
    out += [(n + 1, None, 1), (n + 2, [None] + [0.0] * (width - 1), 1), (n + 3, [math.nan] * width, 1),
            (n + 4, [math.inf] + [0.0] * (width - 1), None), (None, out[3][1], 2), out[8], out[8],
            (-5, [0.0] * width, None), (-6, [-0.0] * width, 0)]
    return out


def _ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


@pytest.mark.parametrize("n", [40, 400])
def test_vector_codes_query(spark, tmp_path, n):
    vectors = _vectors(n)
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    got = queries.op13_vector_codes(spark, str(tmp_path)).collect()
    assert _ordered(got) == _ordered(plain_codes(vectors))


def test_vector_codes_of_large_and_uneven_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = [(k, [float(x) for x in rng.normal(0, 1, 4) * 10.0 ** rng.integers(0, 6)], 0) for k in range(60)]
    df = spark.createDataFrame([*vectors, (900, [1.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    codes, books = vector_codes.compress(df.withColumn("code", F.lit("x")).withColumn("id", F.lit(3)))
    want = plain_codes(vectors)
    assert _ordered(codes.select("id", "code", "error", "label_error").collect()) == _ordered(r[:4] for r in want)
    assert vector_codes.books_digest(books) == want[0][4]


@pytest.mark.parametrize("leaves", [1, 3, 5000])
def test_trie_depth_changes_nothing(monkeypatch, leaves):
    rng = np.random.default_rng(leaves)
    parts, book = rng.integers(-3, 3, (900, 5)), rng.integers(-3, 3, (40, 5))
    monkeypatch.setattr(vector_codes, "LEAVES", leaves)
    index, least = vector_codes.nearest(parts, book)
    all_pairs = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (index == all_pairs.argmin(axis=1)).all() and (least == all_pairs.min(axis=1)).all()


def test_empty_tables(spark, nothing):
    for query in (queries.op11_periodic_runs, queries.op12_sentencepiece, queries.op13_vector_codes):
        assert query(spark, nothing).collect() == []
