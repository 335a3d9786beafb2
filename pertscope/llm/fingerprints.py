"""Document fingerprints by consistent weighted sampling.  DataFrame functions
only.

A document is a bag of lower-cased words weighted by their counts.  For sample
k and a word with weight w, hashes of (word, k) give r and c, Gamma(2, 1) each,
and b, uniform; t = floor(ln w / r + b), and ln a = ln c - r (t - b + 1).  The
sample is the (word, t) with the smallest a, so two documents agree on a sample
with a probability equal to their generalised Jaccard similarity.  ln a is kept
as a fixed-point number above the 32 bits that name (word, t), so that one
minimum of longs, combined map-side, yields both.

``compare_edited`` puts documents in id order without a global sort: ids fall
into buckets of ``BUCKET_IDS`` consecutive values, and each bucket gets the
first document of the next one as a guest.

Defined results: null and empty texts, and texts without words, have the
fingerprint of the empty bag: they agree with each other fully, with others not
at all; rows with one id are ordered by text; null ids come first; whole texts
are read; the next document of the last is the first, of a single document
itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, text_of, words

SAMPLES = 32
BUCKET_IDS = 1024
EMPTY = -1                 # key of the empty bag; real keys of a = 0 can't occur
_STEP = 2.0 ** 24


def _uniforms(h: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1) from the halves of a hash."""
    return ((h.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) / F.lit(2.0 ** 32),
            (F.shiftrightunsigned(h, 32) + F.lit(0.5)) / F.lit(2.0 ** 32))


def sample_keys(term: Column, weights: list[Column], k: int) -> list[Column]:
    """Sample k's key of a term for each weight; null where the weight is 0.

    The logarithm of a weight of 0 is null and makes its key null.  No part is
    behind a condition, so the variants share hashes and logarithms.  ln a lies
    between -112 and 4 for any weight, so the key always fits a long."""
    h1, h2, h3 = (F.xxhash64(term, F.lit(k), F.lit(j)) for j in range(3))
    u1, u2 = _uniforms(h1)
    u3, u4 = _uniforms(h2)
    beta = _uniforms(h3)[0]
    r = -F.log(u1 * u2)
    log_c = F.log(-F.log(u3 * u4))
    out = []
    for w in weights:
        t = F.floor(F.log(w.cast("double")) / r + beta)
        log_a = log_c - r * (t - beta + 1)
        name = F.xxhash64(term, t).bitwiseAND(F.lit(0xFFFFFFFF))
        out.append(F.floor(log_a * F.lit(_STEP)) * F.lit(1 << 32) + name)
    return out


def _bags(rows: DataFrame, key: list[str], variants: dict[str, str]) -> DataFrame:
    """``key`` and, per variant, the array of sample keys of its text."""
    both = F.array(*[F.struct(F.lit(i).alias("v"), words(F.lower(F.col(c))).alias("w"))
                     for i, c in enumerate(variants.values())])
    terms = rows.select(*key, F.explode(both).alias("_b")).select(
        *key, F.col("_b.v").alias("_v"), F.explode("_b.w").alias("_w")).select(
        *key, "_v", F.xxhash64("_w").alias("_t"))
    counts = [F.sum((F.col("_v") == i).cast("long")).alias(f"_n{i}") for i in range(len(variants))]
    bags = terms.groupBy(*key, "_t").agg(*counts)
    mins = []
    for k in range(SAMPLES):
        for i, c in enumerate(sample_keys(F.col("_t"), [F.col(f"_n{i}") for i in range(len(variants))], k)):
            mins.append(F.min(c).alias(f"_m{i}_{k}"))
    low = bags.groupBy(*key).agg(*mins)
    return low.select(*key, *[F.array(*[F.coalesce(F.col(f"_m{i}_{k}").bitwiseAND(F.lit(0xFFFFFFFF)),
                                                   F.lit(EMPTY).cast("long")) for k in range(SAMPLES)]).alias(v)
                              for i, v in enumerate(variants)])


def as_text(samples: Column) -> Column:
    """Eight hexadecimal digits per sample; empty for the empty bag."""
    return F.array_join(F.transform(F.filter(samples, lambda s: s >= 0),
                                    lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return same.cast("double") / F.lit(float(SAMPLES))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, fingerprint)`` of every row; rows of one id must be one text."""
    rows = docs.select(F.col(id_col), text_of(docs).alias("_x"))
    empty = F.array_repeat(F.lit(EMPTY).cast("long"), SAMPLES)
    bags = _bags(rows, [id_col], {"s": "_x"}).withColumnRenamed(id_col, "_id")
    return rows.join(bags, F.col(id_col).eqNullSafe(F.col("_id")), "left").select(
        id_col, as_text(F.coalesce("s", empty)).alias("fingerprint"))


def _with_guests(docs: DataFrame) -> DataFrame:
    """Rows ``(b, id, x, guest)``: each id bucket, and the first document of the
    next one (of the first bucket after the last) as a guest."""
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), text_of(docs).alias("x"))
    rows = rows.withColumn("b", F.floor(F.col("id") / BUCKET_IDS))
    heads = materialize(rows.select("b").distinct(), "cws-buckets")
    span = heads.agg(F.min("b"), F.max("b")).first()
    lo, hi = span[0] or 0, span[1] or 0
    # counted from 1; rows without an id come first, in bucket 0
    rows, heads = (df.withColumn("b", F.coalesce(F.col("b") - (lo - 1), F.lit(0))) for df in (rows, heads))
    before = _previous(heads, hi - lo + 1)
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("b").orderBy("id", "x")))
    guests = rows.where("n = 1").join(before, "b").select(F.col("before").alias("b"), "id", "x",
                                                        F.lit(True).alias("guest"))
    return rows.select("b", "id", "x", F.lit(False).alias("guest")).unionByName(guests)


def _previous(heads: DataFrame, hi: int) -> DataFrame:
    """``(b, before)``: the bucket before each, around the end.  Buckets are
    ordered inside groups of ``BUCKET_IDS`` bucket numbers, groups likewise."""

    def step(level: DataFrame, hi: int) -> DataFrame:
        """Adds ``p``, the number before ``b``; null for the very first."""
        grouped = level.withColumn("g", F.floor(F.col("b") / BUCKET_IDS))
        inner = grouped.withColumn("q", F.lag("b").over(W.partitionBy("g").orderBy("b")))
        if hi < BUCKET_IDS:
            return inner.select("b", F.col("q").alias("p"))
        tops = materialize(grouped.groupBy("g").agg(F.max("b").alias("top")), "cws-level")
        upper = step(tops.select(F.col("g").alias("b")), hi // BUCKET_IDS)
        edge = materialize(upper.join(tops.select(F.col("g").alias("p"), "top"), "p")
                           .select(F.col("b").alias("g"), "top"), "cws-level")
        return inner.join(edge, "g", "left").select("b", F.coalesce("q", "top").alias("p"))

    last = heads.agg(F.max("b")).first()[0]
    return step(heads, hi).select("b", F.coalesce("p", F.lit(last)).alias("before"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the last half
    replaced by the start of the next document) and both likenesses."""
    order = W.partitionBy("b").orderBy("guest", "id", "x")
    rows = _with_guests(docs)
    rows = rows.withColumns({"n": F.row_number().over(order), "next": F.lead("x").over(order)})
    half = F.floor(F.char_length("x") / 2).cast("int")
    rows = rows.withColumn("y", F.concat(F.substring("x", F.lit(1), F.char_length("x") - half),
                                         F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
    facts = rows.select("b", "n", "id", "guest", F.char_length("x").cast("long").alias("n_chars"),
                        F.sha2(F.col("y").cast("binary"), 256).alias("edited_sha256"))
    bags = _bags(rows.select("b", "n", "x", "y"), ["b", "n"], {"s": "x", "e": "y"})
    empty = F.array_repeat(F.lit(EMPTY).cast("long"), SAMPLES)
    out = facts.join(bags, ["b", "n"], "left").withColumns(
        {"s": F.coalesce("s", empty), "e": F.coalesce("e", empty)})
    out = out.withColumn("t", F.lead("s").over(W.partitionBy("b").orderBy("n"))).where("not guest")
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("s")).alias("fingerprint"),
                      as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"),
                      likeness(F.col("s"), F.col("t")).alias("near_next"))
