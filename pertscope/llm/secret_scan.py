"""Secret scans: candidates are unbroken runs of key-like characters and whole
values, of any length and character, behind a secret's name with = or :; a
random forest on their length, character transitions, dictionary coverage, path
and neighbouring words, trained from labelled findings, removes the false
positives.  A quoted value ends at its quote, another at white space, without
closing punctuation; a name inside a value begins a value of its own instead.

The dictionary is every lower-cased letter-only word that makes up at least
``MIN_SHARE`` of the corpus, so at most 1 / MIN_SHARE words: that bound is why
it may be broadcast.  The forest is trained on at most ``MAX_TRAIN`` labelled
findings, the first by hash of each label up to half of them, and both labels
weigh the same; everything else covers all rows.

Labelled findings come as a column ``label`` (1, 0 or null).  ``rule_labels``
makes them where nobody labelled: vendor formats and assignments to a secret's
name are 1, but for plain words, texts with blanks and values of low entropy;
numbers, dates, addresses and mostly-dictionary runs without such a name are 0;
the rest stays null and is decided by the forest.  A vendor format labelled 1 is
a secret whatever the forest says.

Defined results: null and empty texts have no candidates; whole texts are read;
repeated rows give repeated findings; without labels of both kinds nothing can be
learnt, and a finding's probability is its label (0.5 without one, and no
secret); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of, words

MIN_SHARE = 1e-5
MAX_TRAIN = 20_000
TREES, DEPTH, SEED = 20, 6, 17

# Names that secrets are assigned to, words beside harmless
# identifiers, and vendor formats.
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key",
        "credential", "auth", "bearer")
HARMLESS = ("sha1", "sha256", "md5", "checksum", "commit", "revision", "uuid", "isbn", "version", "build", "order",
            "phone", "tel", "card", "fax")
VENDOR = re.compile(r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,}"
                    r"|sk-[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9a-zA-Z]{16,})$")
CANDIDATE = re.compile(r"[A-Za-z0-9_+/-]{10,}={0,2}")
ASSIGNED = re.compile(r"(?i)(?:" + "|".join(map(re.escape, CUES)) + r")[\"']?\s*(?:=>|:=|[=:])\s*")
QUOTED = re.compile(r"""\"((?:[^\"\\\n]|\\.)+)\"|'((?:[^'\\\n]|\\.)+)'""")
BLANK = re.compile(r"\s|$")
BATCH_ROWS = 20_000              # findings that a task holds at a time
KNOWN_RUNS = 100_000             # runs whose features a task remembers
FEATURES = ("length", "transitions", "classes", "entropy", "coverage", "digit_share", "upper_share", "hexadecimal",
            "in_path", "in_address", "cue_before", "harmless_before")
_KIND = {**{chr(c): 0 for c in range(97, 123)}, **{chr(c): 1 for c in range(65, 91)},
         **{chr(c): 2 for c in range(48, 58)}}


def coverage(run: str, dictionary) -> float:
    """Share of the letters that fall into dictionary words, longest first."""
    covered = letters = 0
    for part in re.findall(r"[A-Za-z]+", run):
        low, at = part.lower(), 0
        letters += len(low)
        while at < len(low):
            for end in range(min(len(low), at + 20), at + 2, -1):
                if low[at:end] in dictionary:
                    covered += end - at
                    at = end
                    break
            else:
                at += 1
    return covered / letters if letters else 0.0


def shape(run: str, dictionary) -> list[float]:
    """The features that lie in the run itself, length to hexadecimal."""
    kinds = [_KIND.get(c, 3) for c in run]
    n = len(run)
    counts = Counter(run)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return [float(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, float(len(set(kinds))), entropy,
            coverage(run, dictionary), kinds.count(2) / n, kinds.count(1) / n,
            float(not re.search(r"[^0-9a-fA-F]", run))]


def features(text: str, start: int, end: int, dictionary, known: dict | None = None) -> list[float]:
    run = text[start:end]
    own = known.get(run) if known is not None else None
    if own is None:
        own = shape(run, dictionary)
        if known is not None and len(run) < 100:
            if len(known) >= KNOWN_RUNS:
                known.clear()
            known[run] = own
    before = text[max(0, start - 60):start].lower()
    near = " ".join(re.split(r"[\s,;]+", before)[-4:])
    return [*own, float("/" in run or before.endswith(("/", "\\", "."))),
            float(text[end:end + 1] == "@" or before.endswith("@")),
            float(any(c in near for c in CUES)), float(any(c in near for c in HARMLESS))]


def values(text: str) -> set[tuple[int, int]]:
    """Whole values behind a secret's name; linear in the text."""
    spans, end = set(), 0
    names = list(ASSIGNED.finditer(text))
    for m, after in zip(names, [*names[1:], None]):
        at = m.end()
        quoted = QUOTED.match(text, at)
        if quoted:
            spans.add(quoted.span(quoted.lastindex))
            continue
        if at >= end:
            end = BLANK.search(text, at).start()
        if not after or after.end() >= end:
            value = text[at:end].lstrip("\"'`")
            at = end - len(value)
            value = value.rstrip(".,;:)]}>\"'`") or value
            if value:
                spans.add((at, at + len(value)))
    return spans


def spans(text: str) -> Iterator[tuple[int, int, bool]]:
    """Every candidate and whether it begins a value behind a secret's name."""
    named = values(text)
    begins = {a for a, _ in named}
    for a, b in sorted(named | {m.span() for m in CANDIDATE.finditer(text)}):
        yield a, b, a in begins


def rule_label(run: str, x: list[float], assigned: bool) -> int | None:
    named = dict(zip(FEATURES, x))
    if VENDOR.match(run):
        return 1
    if assigned:
        plain = re.fullmatch("[A-Za-z]?[a-z]*", run) and named["coverage"] >= 0.8
        return 1 if named["entropy"] >= 2.5 and not plain and not re.search(r"\s", run) else None
    if not re.search(r"[A-Za-z]", run) or named["in_address"] or named["coverage"] >= 0.8 or named["entropy"] < 2:
        return 0
    return None


def dictionary(docs: DataFrame) -> set[str]:
    """Frequent words, at most 1 / MIN_SHARE of them."""
    terms = docs.select(F.explode(words(F.lower(text_of(docs)))).alias("w")).where(
        F.col("w").rlike("^[a-z]{3,20}$"))
    counts = materialize(terms.groupBy("w").agg(F.count("*").alias("n")), "secret-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(2, math.ceil(MIN_SHARE * total))
    return {r["w"] for r in counts.where(F.col("n") >= least).select("w").collect()}


def candidates(docs: DataFrame, frequent: set[str]) -> DataFrame:
    """``(doc_id, start, end, features..., label, vendor)`` of every candidate."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known, runs_known = shared.value, {}
        kinds = [pa.int64()] * 2 + [pa.float64()] * len(FEATURES) + [pa.int32(), pa.bool_()]

        def table(ids, rows, out):
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), *[pa.array(c, type=t) for c, t in zip(zip(*out), kinds)]],
                names=["doc_id", "start", "end", *FEATURES, "label", "vendor"])

        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                for start, end, assigned in spans(text):
                    x = features(text, start, end, words_known, runs_known)
                    run = text[start:end]
                    rows.append(k)
                    out.append((start, end, *x, rule_label(run, x, assigned), bool(VENDOR.match(run))))
                    if len(out) == BATCH_ROWS:
                        yield table(batch.column(0), rows, out)
                        rows, out = [], []
            if out:
                yield table(batch.column(0), rows, out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], text_of(docs).alias("x")).mapInArrow(
        run, f"doc_id {kind}, start long, end long, " + ", ".join(f"{f} double" for f in FEATURES) + ", label int, vendor boolean")


def train(found: DataFrame, max_train: int = MAX_TRAIN):
    """A forest from labelled findings, or None without both labels."""
    order = F.xxhash64(F.struct(*FEATURES), F.col("doc_id"), F.col("start"))
    one, other = (found.where(F.col("label") == k).orderBy(order, "doc_id", "start").limit(max_train // 2)
                  for k in (0, 1))
    # bounded: one partition in one order, so that training gives the same forest again
    sample = materialize(one.unionByName(other)
                         .select(*FEATURES, F.col("label").cast("double").alias("label"), order.alias("o"))
                         .coalesce(1).sortWithinPartitions("o", *FEATURES), "secret-train")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    sample = sample.withColumn("weight", F.when(F.col("label") == 1, sum(n.values()) / (2 * n[1.0]))
                               .otherwise(sum(n.values()) / (2 * n[0.0])))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=TREES,
                                    maxDepth=DEPTH, seed=SEED)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(sample))


def scan(docs: DataFrame, found: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate with its probability and whether it is kept as a
    secret.  ``found`` gives candidates with labels of one's own."""
    if found is None:
        found = materialize(candidates(docs, dictionary(docs)), "secret-candidates")
    model = train(found)
    labelled = F.coalesce(F.col("label") == 1, F.lit(False))
    if model is None:
        scored = found.withColumn("probability", F.coalesce(F.col("label").cast("double"), F.lit(0.5)))
        secret = labelled
    else:
        seen = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(found)
        scored = model.transform(seen).withColumn("probability", vector_to_array("probability")[1])
        secret = F.col("probability") >= threshold
        if "vendor" in found.columns:
            secret = secret | (F.col("vendor") & labelled)
    return scored.select("doc_id", "start", "end", "label", *FEATURES, "probability", secret.alias("is_secret"))
