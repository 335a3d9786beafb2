"""Each operator against a plain version on small tables that hold the odd
cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra
columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("pertscope.llm.queries")

from pertscope.llm import (chat_format, fingerprints, line_dedup, lm_scoring, mixing, packing, pii,  # noqa: E402
                           quality_rules, secret_scan, simhash_dedup)
from pertscope.llm.common import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def _lines(rng, n, vocabulary=("the", "ab", "Ünder", "z#z", "of", "it", "q", "x1")):
    return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))) + rng.choice(["", ".", " "])
                     for _ in range(n))


def _table():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a b c", "a b c", "A  B\tC"]
    texts += [_lines(rng, rng.randint(1, 12)) for _ in range(25)]
    passage = "\n".join(" ".join(f"w{k}x{j}" for j in range(30)) + "." for k in range(4))
    texts += [passage, "head line\n" + passage + "\ntail", passage + "\n" + passage, texts[10], texts[10]]
    texts += ["same " * 3000, " ".join(f"n{k}" for k in range(4000))]
    return [(k, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return _table()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """A null id, a repeated row, and columns named like the operators' own."""
    more = rows + [(None, "null id text here", "x", "s1", 3), rows[7], rows[7]]
    df = spark.createDataFrame(more, SCHEMA)
    for name in ("size", "copies", "fp", "component_id", "pos", "runs", "guest", "kept", "n_words", "grp", "key"):
        df = df.withColumn(name, df["lang"])
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# 1 -------------------------------------------------------------------------

def brute_lm(rows, held, mu):
    toks = [["</s>"] + [lower(w) for w in words(t)] + ["</s>"] for t in (r[1] for r in rows)]
    uni, bi, tri = Counter(), Counter(), Counter()
    for t, h in zip(toks, held):
        if not h:
            uni.update(t[1:])
            bi.update(zip(t, t[1:]))
            tri.update(zip(t, t[1:], t[2:]))
    n, v = sum(uni.values()), len(uni)

    def p1(w):
        return (uni[w] + 0.5) / (n + 0.5 * (v + 1))

    def p2(h, w):
        return (bi[h, w] + mu * p1(w)) / (uni[h] + mu)

    def p3(g, h, w):
        return (tri[g, h, w] + mu * p2(h, w)) / (bi[g, h] + mu)

    out = []
    for t in toks:
        base = [p1(w) for w in t[1:]]
        s = [p2(t[0], t[1])] + [p3(*t[i - 2:i + 1]) for i in range(2, len(t))]
        out.append((len(t) - 1, sum(uni[w] > 0 for w in t[1:]), n, sum(map(math.log10, base)),
                    sum(map(math.log10, s))))
    return out


@pytest.mark.parametrize("group_bytes, owner_bytes", [(500, 4000), (1, 1 << 20), (1 << 20, 800)])
def test_lm_scores(docs, rows, group_bytes, owner_bytes):
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, lm_scoring.hold_out(docs), group_bytes=group_bytes,
                                                    owner_bytes=owner_bytes).collect()}
    assert len(got) == len(rows)
    for r, h, want in zip(rows, held, brute_lm(rows, held, lm_scoring.MU)):
        g = got[r[0]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (h, *want[:3])
        assert g["base_score"] == pytest.approx(want[3]) and g["score"] == pytest.approx(want[4])


def _lm_steps(training, texts, mu=lm_scoring.MU):
    """Log probabilities of the library's automaton, one list per text."""
    grams = lm_scoring.Grams(lm_scoring.Tokens.of(training + texts))
    learnt = np.arange(len(training) + len(texts)) < len(training)
    total = {n: grams.counts(n, learnt) for n in lm_scoring.ORDERS}
    log_all = math.log10(total[1].sum() + 0.5 * ((total[1] > 0).sum() + 1))
    steps = lm_scoring.Automaton(grams, total, log_all, mu).walk()
    return [steps[a:b].tolist() for a, b in zip(grams.starts, grams.ends)][len(training):]


@pytest.mark.parametrize("context", ["", "a", "b", "a b", "c a", "b b", "never", "a never", "never a", "c a b"])
def test_lm_arcs_of_a_state_sum_to_one(context):
    training = ["a b a c a b", "b a b c", "", "c a b a"]
    n = len(context.split())
    known = ["a", "b", "c", ""]        # the empty one reads the end token
    steps = _lm_steps(training, [f"{context} {w}".strip() for w in [*known, "unknown"]])
    assert sum(10 ** s[n] for s in steps) == pytest.approx(1)


def test_lm_falls_back_two_levels():
    """From the state of a pair, past that of a word, to the root."""
    training = ["a b c", "a b d", "x y"]
    (steps,) = _lm_steps(training, ["a b x"], mu=2.0)
    # N = 11 tokens, V = 7 types; c(a b) = 2, c(b) = 2, c(x) = 1, and x never follows b
    assert steps[2] == pytest.approx(math.log10(2 / 4) + math.log10(2 / 4) + math.log10(1.5 / (11 + 0.5 * 8)))


def test_lm_walk_in_blocks(monkeypatch):
    texts = ["a b a c a b", "b a never c a", ""] * 5
    whole = _lm_steps(texts, texts)
    monkeypatch.setattr(lm_scoring, "BLOCK", 4)
    assert _lm_steps(texts, texts) == whole


def test_lm_without_training(docs, rows):
    from pyspark.sql import functions as F

    got = lm_scoring.score(docs, F.lit(True)).collect()
    assert len(got) == len(rows)
    assert all(r["train_tokens"] == r["n_known"] == 0 and r["score"] == pytest.approx(r["base_score"]) for r in got)


def test_lm_odd_tables(odd, nothing):
    assert lm_scoring.score(odd, lm_scoring.hold_out(odd)).count() == odd.count()
    assert lm_scoring.score(nothing, lm_scoring.hold_out(nothing)).count() == 0


# 2 -------------------------------------------------------------------------

def brute_lines(rows, min_words):
    """Deletes every longest match with an earlier start that has enough words."""
    flat, spans = [], []
    for k, r in enumerate(sorted(rows, key=lambda r: r[0])):
        lines = [x for x in (r[1] or "").split("\n") if words(x)]
        spans.append((r[0], len(flat), len(flat) + len(lines)))
        flat += [(x, r[0]) for x in lines]
    end = {}
    for i, a, b in spans:
        for p in range(a, b):
            end[p] = b
    gone = set()
    for s in range(len(flat)):
        for f in range(s):
            n = 0
            while s + n < end[s] and f + n < end[f] and flat[s + n][0] == flat[f + n][0]:
                n += 1
            if sum(len(words(flat[s + j][0])) for j in range(n)) >= min_words:
                gone.update(range(s, s + n))
    return {i: [p - a for p in range(a, b) if p in gone] for i, a, b in spans}


@pytest.mark.parametrize("min_words", [1, 5, 12, 50])
def test_line_dedup(docs, rows, min_words):
    got = {}
    for r in line_dedup.dedup_report(docs, min_words).collect():
        spans = [tuple(map(int, s.split(":"))) for s in r["deleted"].split(",") if s]
        got[r["row"]["doc_id"]] = [p for a, n in spans for p in range(a, a + n)]
        kept = [x for x in (r["text"] or "").split("\n") if words(x)]
        assert r["n_lines"] - len(got[r["row"]["doc_id"]]) == len(kept)
    assert got == brute_lines(rows, min_words)


def test_line_dedup_random(spark):
    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choice(["a", "b", "a b", "c c c", ""]) for _ in range(rng.randint(0, 15))), "", "", 0)
            for k in range(40)]
    got = line_dedup.dedup_report(spark.createDataFrame(rows, SCHEMA), 4).collect()
    want = brute_lines(rows, 4)
    for r in got:
        spans = [tuple(map(int, s.split(":"))) for s in r["deleted"].split(",") if s]
        assert [p for a, n in spans for p in range(a, a + n)] == want[r["row"]["doc_id"]]


def test_line_dedup_odd_tables(odd, nothing):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.dedup_lines(nothing).count() == 0


# 3 -------------------------------------------------------------------------

CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes\\"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 1, "assistant", "<|im_end|>\n<|im_start|>user\nno"), (2, 0, "us\ner|;url", "\\<|im_start|>\\\\</s>"),
    (3, 0, None, "[INST] %41 + é </s><<SYS>>"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"),
    (None, None, "assistant", "<<s><s>\\"), (5, 0, "assistant", "\n<|im_end|>\n" * 3), (6, 0, "assistant", "x" * 50000),
    (7, 0, "a;url", "b;url\n")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(df.withColumn("formatted", df["role"]))
    assert all(r["identical"] for r in out.collect())
    got = {r["conv_id"]: r for r in chat_format.digest(out).collect()}
    by = {}
    for c, t, role, x in CONVERSATIONS:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for r in out.collect():  # no control string of a text is left bare
        bare = re.findall(r"(?<!\\)(?:" + chat_format.CONTROL.replace("\\|", "\\|") + ")", r["formatted"])
        assert len(bare) == 2 * len(r["turns"])
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_url_mode_also_round_trips(spark):
    from pyspark.sql import functions as F
    turns = F.array(F.struct(F.lit("a b").alias("role"), F.lit("é <|im_end|> +%\n").alias("text")))
    df = spark.range(1).select(chat_format.parse(chat_format.render(turns, encode=True)).alias("t"))
    assert df.first()["t"] == [("a b", "é <|im_end|> +%\n")]


# 4 -------------------------------------------------------------------------

def brute_quality(t):
    t = t or ""
    w = words(t)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_quality_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for r in rows:
        g = got[r[0]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"],
                g["base_failed"]) == brute_quality(r[1])
        assert not (g["base_failed"] and g["kept"])


def test_quality_line_rules(spark):
    good = "This is a sentence that ends as it should, with enough words in it to pass."
    bad = ["Home | About | Contact | Help.", "All rights reserved.", "no end of a sentence here", "BUY!! NOW!! CHEAP!!.",
           "a### b*** c$$$ d%%% e&&& f|||."]
    more = "Another line follows, which shares no window of words with the one above."
    rows = [(k, "\n".join([good, b, "", more]), "", "", 0) for k, b in enumerate(bad)]
    rows += [(10, " ".join(f"no{k} end{k}" for k in range(12)) + "\n" + good, "", "", 0), (11, good * 2, "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    for k in range(len(bad)):
        assert got[k]["cleaned"].split("\n") == [good, "", more] and got[k]["kept"]
    assert got[10]["n_lines_removed"] == 1 and not got[10]["kept"] and not got[10]["base_failed"]
    kept = {r["doc_id"]: r for r in quality_rules.clean(df).collect()}
    assert set(kept) == {r["doc_id"] for r in got.values() if r["kept"]}
    assert kept[0]["n_chars"] == len(kept[0]["text"])


def test_quality_closing_marks_before_long_ends(spark):
    words = " ".join(f"word{k}" for k in range(25))
    ends = {"." + " " * 40: True, "!" + "\t \r" * 9: True, '."' + "'\")]" * 20: True, "?" + "”" * 9 + " " * 9: True,
            " " * 40: False, '"' * 20: False, ". x" + " " * 20: False, ". " + '"' * 9: False, "." + "," * 9: False}
    df = spark.createDataFrame([(k, words + e, "", "", 0) for k, e in enumerate(ends)], SCHEMA)
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert [got[k]["kept"] for k in range(len(ends))] == list(ends.values())
    kept = {r["doc_id"]: r["text"] for r in quality_rules.clean(df).collect()}
    assert kept == {k: words + e for k, (e, ok) in enumerate(ends.items()) if ok}


def test_quality_odd_tables(odd, nothing):
    out = quality_rules.clean(odd)
    assert out.columns == odd.columns
    assert quality_rules.judge(odd).count() == odd.count()
    assert quality_rules.judge(nothing).count() == 0


# 5 -------------------------------------------------------------------------

def brute_simhash(t, n):
    import xxhash
    w = [lower(x) for x in words(t)]
    grams = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, max_bits):
    ids = list(fps)
    low = {i: i for i in ids}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= max_bits:
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_clusters(docs, rows):
    got = {r["doc_id"]: r for r in simhash_dedup.clusters(docs, 3, 3).collect()}
    fps = {r[0]: brute_simhash(r[1], 3) for r in rows}
    assert {i: g["fp"] % 2 ** 64 for i, g in got.items()} == fps
    assert {i: g["component_id"] for i, g in got.items()} == brute_components(fps, 3)


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 4])
def test_simhash_links_are_complete(spark, max_bits):
    rng = random.Random(max_bits)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for _ in range(3):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps += [fps[0] ^ (1 << b) for b in range(64)] + [fps[0] ^ (1 << b) ^ (1 << c) for b in range(20) for c in range(b)]
    fps = dict(enumerate(dict.fromkeys(fps)))
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in fps.items()}
    df = spark.createDataFrame([(f,) for f in signed.values()], "fp long")
    near = components(simhash_dedup.links(df, max_bits))
    got = {r["node"]: r["component"] for r in near.collect()}
    want = brute_components(fps, max_bits)
    mine = {i: got.get(f, f) for i, f in signed.items()}
    assert len(set(zip(mine.values(), want.values()))) == len(set(want.values())) == len(set(mine.values()))


def test_golay_code_covers():
    table = simhash_dedup.error_patterns(0)
    assert all(len(p) == 1 for p in table[0])


def test_simhash_keeps_one(odd, rows, nothing):
    out = simhash_dedup.keep_one(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.collect()]
    fps = {r[0]: brute_simhash(r[1], 3) for r in rows}
    assert sorted(i for i in ids if i is not None) == sorted(set(brute_components(fps, 3).values()))
    assert ids.count(None) == 1
    assert simhash_dedup.keep_one(nothing).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)]
    edges += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    low = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in low.items() if n not in alone}


# 6 -------------------------------------------------------------------------

def test_secret_scan(spark, nothing):
    rng = random.Random(2)
    rows = []
    for k in range(120):
        pad = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40))
        key = "".join(rng.choice("abcdef0123456789") for _ in range(18))
        vendor = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        what = [f"password={key}", vendor, "order 1234567890123", "alphabetagammadelta2", ""][k % 5]
        rows.append((k, f"{pad} {what} {pad}", "", "", 0))
    rows.append((500, None, "", "", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    got = secret_scan.scan(df).collect()
    assert {r["doc_id"] for r in got if r["is_secret"]} == {k for k in range(120) if k % 5 < 2}
    assert {r["doc_id"] for r in got} == {k for k in range(120) if k % 5 < 4}
    # held out: findings without labels are judged like their labelled kind
    from pyspark.sql import functions as F
    found = secret_scan.candidates(df, secret_scan.dictionary(df))
    part = found.withColumn("label", F.when(F.col("doc_id") < 60, F.col("label")))
    for r in secret_scan.scan(df, part).where("doc_id >= 60").collect():
        assert r["is_secret"] == (r["doc_id"] % 5 < 2)
    assert secret_scan.scan(nothing).count() == 0


def test_secret_values_of_any_shape(spark):
    def found(t):
        return {t[a:b] for a, b, _ in secret_scan.spans(t)}
    for t, value in (("password=hunter2", "hunter2"), ("secret = CorrectHorseBatteryStaple", "CorrectHorseBatteryStaple"),
                     ("PWD: P@ssw0rd!2024, then", "P@ssw0rd!2024"), ('"api_key": "a b\\"c"}', 'a b\\"c'),
                     ("token='x'", "x"), ("auth: token=hunter2.", "hunter2"), ("key XkcdQwertZuiopAsdf here", "XkcdQwertZuiopAsdf"),
                     ("pwd='open", "open"), ("password=...", "...")):
        assert value in found(t), t
    assert found("password=") == found('pwd: ""') == set()
    import time
    began = time.time()
    for t in ("password=" * 40_000, "pwd='" * 60_000, 'pwd="\\' * 60_000, "token: " * 40_000, "secret" * 50_000):
        secret_scan.values(t)
    assert time.time() - began < 20
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["order", "alpha", "betagammadelta"]) for _ in range(9)) + " "
             + ("password=hunter%d" % k if k % 3 == 0 else "order 12345678%05d" % k), "", "", 0) for k in range(60)]
    got = secret_scan.scan(spark.createDataFrame(rows, SCHEMA)).where("is_secret").collect()
    assert {(r["doc_id"], r["end"] - r["start"]) for r in got} == {
        (k, len("hunter%d" % k)) for k in range(60) if k % 3 == 0}


def test_secret_verdicts_with_rare_labels(spark):
    from pyspark.sql import functions as F
    rows = [(k, "order %015d" % (k * 7919), "", "", 0) for k in range(400)]
    rows += [(900 + k, "see AKIA" + "QWERTZUIOP23456" + "AB"[k], "", "", 0) for k in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = secret_scan.candidates(df, set())
    got = secret_scan.scan(df, found).where("is_secret").collect()
    assert {r["doc_id"] for r in got} == {900, 901}
    sample = secret_scan.train(found, 20)                 # 2 of 402 findings: both are drawn
    assert sample is not None
    # without both labels nothing is learnt, and what has no label is no secret
    alone = found.withColumn("label", F.when(F.col("doc_id") == 900, 1))
    assert {r["doc_id"] for r in secret_scan.scan(df, alone).where("is_secret").collect()} == {900}


# 7 -------------------------------------------------------------------------

def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            out.update(share)
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("bucket_rows", [2, 4096])
def test_mixing(docs, rows, bucket_rows):
    got = {r["doc_id"]: r for r in mixing.plan_mix(docs, bucket_rows=bucket_rows).collect()}
    sizes = Counter()
    for r in rows:
        assert got[r[0]]["size"] == len(words(r[1]))
        sizes[r[3]] += len(words(r[1]))
    goal = brute_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in rows:
        g = got[r[0]]
        assert g["source_size"] == sizes[r[3]] and g["target"] == pytest.approx(goal[r[3]])
        epochs = math.floor(goal[r[3]] / sizes[r[3]] + 1e-9)
        assert g["copies"] in ((epochs, epochs + 1) if g["size"] else (0,)) and g["taken"] <= 2 * g["size"]
        taken[r[3]] += g["taken"]
        largest[r[3]] = max(largest[r[3]], g["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1
    again = {r["doc_id"]: r["taken"] for r in mixing.plan_mix(docs.repartition(7), bucket_rows=bucket_rows).collect()}
    assert again == {i: g["taken"] for i, g in got.items()}


def test_mixing_picks_smallest_keys(spark):
    from pyspark.sql import functions as F
    rows = [(k, "w " * (k % 7 + 1), "", f"s{k % 2}", 0) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    slim = mixing._slim(df, 7, F.lit(1.0) + df["doc_id"] % 3, [df["doc_id"]])
    cut = {r["_s"]: r for r in mixing.goals(slim.drop("doc_id"), bucket_rows=16).collect()}
    by = {}
    for r in slim.collect():
        by.setdefault(r["_src"], []).append((r["_key"], r["size"]))
    for s, keys in by.items():
        keys.sort()
        rest = cut[s]["target"] - cut[s]["_epochs"] * cut[s]["source_size"]
        upto, best = 0, None
        for key, size in keys:
            upto += size
            if upto - size / 2 <= rest:
                best = key
        assert cut[s]["_cut"] == best


def test_mix_repeats_documents(odd, nothing):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    plan = mixing.plan_mix(odd)
    assert out.count() == plan.groupBy().sum("copies").first()[0]
    assert mixing.mix(nothing).count() == 0 and mixing.plan_mix(nothing).count() == 0


# 8 -------------------------------------------------------------------------

def test_fingerprints_of_edited_texts(docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(docs).collect()}
    texts = [r[1] or "" for r in rows]
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        h = len(t) // 2
        edited = t[:len(t) - h] + after[:h]
        g = got[k]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (Counter(w.lower() for w in words(x)) for x in (t, edited))
        true = sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0
        assert abs(g["near_edited"] - true) < 0.4
    same = [g["fingerprint"] for k, g in got.items() if texts[k] == texts[10]]
    assert len(same) == 3 and len(set(same)) == 1


def test_fingerprint_collisions_estimate_weighted_jaccard(spark):
    rng = random.Random(9)
    rows, true = [], []
    for k in range(150):
        a = [f"t{k}x{rng.randint(0, 40)}" for _ in range(60)]
        b = a[:rng.randint(20, 60)] + [f"u{k}x{rng.randint(0, 40)}" for _ in range(20)]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x, y = Counter(a), Counter(b)
        true.append(sum((x & y).values()) / sum((x | y).values()))
    fp = dict(fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    est = [np.mean([fp[2 * k][i:i + 8] == fp[2 * k + 1][i:i + 8] for i in range(0, 256, 8)]) for k in range(150)]
    assert abs(np.mean(np.array(est) - true)) < 0.02
    assert np.sqrt(np.mean((np.array(est) - true) ** 2)) < 0.12


def test_fingerprints_of_sparse_ids(spark):
    ids = [-5000, -3, 0, 1, 1023, 1024, 10 ** 6, 10 ** 12, 10 ** 12 + 1, 2 ** 62]
    rows = [(i, f"text number {k} here") for k, i in enumerate(ids)]
    got = {r["doc_id"]: r["edited_sha256"] for r in
           fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(rows):
        h = len(t) // 2
        assert got[i] == hashlib.sha256((t[:len(t) - h] + rows[(k + 1) % len(rows)][1][:h]).encode()).hexdigest()


def test_fingerprints_odd_tables(odd, nothing, spark):
    assert fingerprints.compare_edited(odd).count() == odd.count()
    assert fingerprints.compare_edited(nothing).count() == 0
    one = spark.createDataFrame([(4, "just one text")], "doc_id long, text string")
    assert fingerprints.compare_edited(one).first()["near_next"] == 1.0


def test_sample_keys_share_their_work_and_skip_weight_zero(spark):
    from pyspark.sql import functions as F
    both = [F.col("a"), F.col("b")]
    keys = fingerprints.sample_keys(F.col("t"), both, 3)
    # what stands behind a condition is computed once for each use
    assert "CASE WHEN" not in " ".join(str(k) for k in keys)
    big = 2 ** 62
    rows = spark.createDataFrame([(t, a, b) for t in range(200) for a, b in ((0, 1), (5, 0), (7, 7), (big, 0))], "t long, a long, b long")
    for t, a, b, x, y in rows.select("t", "a", "b", *[k.alias(f"k{i}") for i, k in enumerate(keys)]).collect():
        assert (x is None) == (a == 0) and (y is None) == (b == 0) and (a != b or x == y)
        assert all(k is None or abs(k) < 113 * 2 ** 56 for k in (x, y))


# 9 -------------------------------------------------------------------------

def check_pieces(pieces, ids_of, capacity=2048, max_segments=packing.MAX_SEGMENTS):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            part = ids_of[d][p["start"]:p["start"] + p["length"]]
            assert p["start"] == at and p["length"] == len(part) > 0 and p["doc_tokens"] == len(ids_of[d])
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids_of[d])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity and at & (at - 1) == 0 and len(ps) <= max_segments
    return by_doc


def test_packing_documents(docs, rows):
    from tokenizers import Tokenizer
    from pertscope.llm.queries import tokenizer_path
    tok = Tokenizer.from_file(tokenizer_path())
    ids = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    pieces = packing.pack_documents(docs, tokenizer_path()).collect()
    assert set(check_pieces(pieces, ids)) == set(ids)


def test_word_memo_equals_whole_text_ids():
    from tokenizers import Tokenizer
    from pertscope.llm.queries import tokenizer_path
    tok, memo = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path(), memo=50)
    rng = random.Random(4)
    alphabet = "aB'sé́ \n\t  İΣς1234!?#…日本<|endoftext|> 'll 're\x0b\x1c​"
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(80)) + rng.choice(["", "<|endoftext|>", " <|startoftext|>x"])
        assert memo.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing_limits(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        n = int(rng.integers(0, 200))
        rows.append((k, rng.integers(2, 900, n).tolist(), (rng.random(n) < 0.6).tolist()))
    rows.append((300, None, None))
    rows.append((301, list(range(500)), None))
    df = spark.createDataFrame(rows, "id long, ids array<int>, loss array<boolean>").coalesce(2)
    out = [r.asDict() | {"doc_id": r["id"]} for r in packing.pack_examples(df, 256, 6, 100).collect()]
    ids = {r[0]: r[1] for r in rows if r[1]}
    check_pieces(out, ids, 256, 6)
    loss = Counter()
    for p in out:
        mask = rows[p["doc_id"]][2] or [True] * 500
        assert p["n_loss"] == sum(mask[p["start"]:p["start"] + p["length"]])
        loss[p["sequence_id"]] += p["n_loss"]
    assert max(loss.values()) <= 100


def test_packing_odd_tables(odd, nothing):
    from pertscope.llm.queries import tokenizer_path
    assert packing.pack_documents(odd, tokenizer_path()).where("doc_id is null").count() >= 1
    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0


# 10 ------------------------------------------------------------------------

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, t):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_base_equals_the_patterns():
    rng = random.Random(11)
    anchors = pii.automaton()
    bits = ["a@b.co", "@", ".", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111",
            "+49 (30) 123-4567", "+1", "x", " ", "-", "12", "é", "+", "(", "\n", "a.b@c-d.e.f", "%_+-@x.y", "0", "..",
            "255.255.255.255", "000000000000000000000000255.1.1.1", "account 12345678", "mailto:q@r.st"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        got = [s for s in pii.find_spans(t, anchors) if s[1] < 4]
        assert got == brute_pii(t), t


def test_pii_added_spans():
    anchors = pii.automaton()
    found = lambda t: {(pii.KINDS[k], t[a:b]) for a, k, b in pii.find_spans(t, anchors)}
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in found("IBAN: GB82 WEST 1234 5698 7654 32.")
    assert ("ssn", "123-45-6789") in found("his number 123-45-6789 is")
    assert ("account", "AB1234567") in found("Account number: AB1234567 ok")
    assert ("url", "bob:pw1@host.example") in found("see https://bob:pw1@host.example/x")
    assert not found("accounting 12 and 000-12-3456")


def test_pii_accounts_to_their_own_end():
    anchors = pii.automaton()
    found = lambda t: {(pii.KINDS[k], t[a:b]) for a, k, b in pii.find_spans(t, anchors)}
    de, gb, no = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    every = {("iban", x) for x in (de, gb, no)}
    assert ("iban", de) in found(f"IBAN {de} BIC COBADEFF")                 # words in capitals behind it
    assert ("iban", gb) in found(f"IBAN {gb} BIC NWBKGB2L")
    assert every <= found(f"IBANs: {de}, {gb}, {no}.")                      # a list
    assert every <= found(f"iban {'is given below ' * 20}{de} or {gb}\n{no}")   # far from the cue
    assert every <= found(f"pay to {de} or {gb}; {no}")                     # no cue
    assert ("iban", de) in found(f"iBAN{de}")
    assert ("iban", "XX57 1234 5678 9012 345") in found("IBAN XX57 1234 5678 9012 345 BIC")   # country not listed
    assert not found("pay DE89370400440532013001 or A" + de + " or " + de + "x")
    for cue in ("Customer ID", "Member ID", "CUSTOMER Id", "Account Number", "mEMBER iD"):
        assert ("account", "AB1234567") in found(f"{cue}: AB1234567 ok")
    assert ("url", "bob:pw1@host.example") in found("see HTTPS://bob:pw1@host.example/x")
    assert ("account", "AB1234567") in found("İİ ẞ Customer ID: AB1234567")  # positions stay


def test_pii_long_texts_take_linear_time():
    import time
    anchors, began = pii.automaton(), time.time()
    for t in ("9" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "+1" * 150_000, "a@" * 150_000, "1-" * 150_000):
        pii.find_spans(t, anchors)
    assert time.time() - began < 20


def test_pii_odd_tables(odd, rows, nothing):
    out = pii.find_pii(odd)
    assert out.count() == odd.count()
    for r in out.where("doc_id is not null").collect():
        spans = brute_pii(rows[r["doc_id"]][1] or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert pii.find_pii(nothing).count() == 0


def test_word_tokenizer_equals_the_whole_text_path():
    import random

    from tokenizers import Tokenizer

    from pertscope.llm.packing import WordTokenizer
    from pertscope.llm.queries import tokenizer_path

    whole, own = Tokenizer.from_file(tokenizer_path()), WordTokenizer(tokenizer_path(), memo=500)
    assert own.parts is not None
    rng = random.Random(5)
    pool = [*"ab'sStTlLrRe09.,!?<|>éÉİıΣσßﬁ ́\u0085 　漢か각\U00010400ǅ\x00\x1c\x7f\xad_-", " ", "\n",
            "<|endoftext|>", "don't", "'ll", "word", "Word", "x" * 300]
    for _ in range(5000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        want = whole.encode(text, add_special_tokens=False).ids
        assert own.ids(text).tolist() == want and own.ids(text.encode("utf-8")).tolist() == want, ascii(text)
