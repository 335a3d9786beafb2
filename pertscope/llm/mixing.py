"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight; within
a source the smallest keys come first and sizes are summed in that order up to
the token budget.  A target above the source's size takes whole epochs first
and only the rest is selected by key.

The order is never built for a whole source: keys fall into buckets of about
``bucket_rows`` documents, bucket totals are summed, and only the one bucket
of a source that the budget ends in is sorted.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source of its own, the last one; rows with the same id and text
draw the same key, so they are taken alike; an empty table gives an empty
table; other columns are ignored by ``plan_mix`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialize, n_words, text_of

WEIGHTS = (3, 1, 2)


def quality_weight(text: Column) -> Column:
    """Weight in (0, 1]: a tenth, plus nine tenths of the share of a text's
    non-space characters that are not digits or ASCII symbols."""
    solid = F.translate(text, SPACE_CHARS, "")
    good = F.translate(solid, "0123456789#*$%&|<>{}[]()=+/\\^~_@", "")
    return F.lit(0.1) + F.lit(0.9) * F.char_length(good) / F.greatest(F.char_length(solid), F.lit(1))


def targets(per_source: DataFrame, share: float = 1.5, epochs: float = 2.0,
            weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to one row per source ``(source, source_size)``.

    ``share`` of all sizes is dealt by weight; a target stops at ``epochs``
    times its source and the excess is dealt again.  Each pass fixes the level
    (size per weight) from two sums; the sources stay in the table.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    deal = F.array(*[F.lit(float(w)) for w in weights])
    src = materialize(
        per_source.withColumn("_pos", F.row_number().over(order) - 1)
        .select("source", "source_size", F.get(deal, F.col("_pos") % len(weights)).alias("_w"),
                (F.col("source_size") * epochs).alias("_cap")), "mix-sources")
    total = src.agg(F.sum("source_size")).first()[0]
    if not total:
        return src.select("source", "source_size", F.lit(0.0).alias("target"))
    level = -1.0
    while True:
        capped = F.col("_w") * level >= F.col("_cap")
        fixed, open_w = src.agg(F.sum(F.when(capped, F.col("_cap"))), F.sum(F.when(~capped, F.col("_w")))).first()
        if not open_w:
            break
        new = (share * total - (fixed or 0.0)) / open_w
        if new <= level * (1 + 1e-12):
            break
        level = new
    return src.select("source", "source_size", F.least("_cap", F.col("_w") * level).alias("target"))


def _key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(2.0 ** 53)
    return -F.log(u) / weight


def goals(slim: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS,
          bucket_rows: int = 4096) -> DataFrame:
    """Per source: size, target, whole epochs and the largest key selected,
    from ``slim(_src, size, _key, _q)``."""
    per = slim.groupBy("_src").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"),
                                   F.avg("_q").alias("_mean_q"))
    per = materialize(per, "mix-per-source")
    goal = targets(per.select(F.col("_src").alias("source"), "source_size"), share, epochs, weights)
    goal = per.drop("source_size").join(goal, F.col("_src").eqNullSafe(F.col("source"))).select(
        F.col("_src").alias("_s"), "source_size", "target",
        F.ceil(F.col("_n") / bucket_rows).alias("_buckets"), "_mean_q",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(F.lit(0)).cast("long").alias("_epochs"))
    goal = materialize(goal.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")),
                       "mix-goals")
    rows = slim.join(_sent(goal), F.col("_src").eqNullSafe(F.col("_s"))).where("size > 0")
    # the exponential's own distribution spreads keys evenly over the buckets, in key order
    cdf = 1 - F.exp(-F.col("_key") * F.col("_mean_q"))
    rows = rows.withColumn("_b", F.least(F.floor(cdf * F.col("_buckets")), F.col("_buckets") - 1))
    sums = rows.groupBy("_s", "_b").agg(F.sum("size").alias("_in"), F.first("_rest").alias("_rest"))
    run = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ends = (sums.withColumn("_before", F.coalesce(F.sum("_in").over(run), F.lit(0)))
            .where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_in")))
            .select(F.col("_s").alias("_es"), F.col("_b").alias("_eb"), "_before"))
    ends = materialize(ends, "mix-ends")
    edge = rows.join(_sent(ends), F.col("_s").eqNullSafe(F.col("_es")) & (F.col("_b") == F.col("_eb")))
    upto = F.sum("size").over(W.partitionBy("_s").orderBy("_key"))
    # the document that the budget ends in is selected if at least half of it fits
    cuts = (edge.select("_s", "_key", "size", "_before", "_rest", upto.alias("_upto"))
            .where(F.col("_before") + F.col("_upto") - F.col("size") / 2 <= F.col("_rest"))
            .groupBy(F.col("_s").alias("_cs")).agg(F.max("_key").alias("_cut")))
    # no document of the end bucket selected: every key of the buckets before it is smaller than its first
    first = edge.groupBy(F.col("_s").alias("_fs")).agg(F.min("_key").alias("_first"))
    out = (goal.join(cuts, F.col("_s").eqNullSafe(F.col("_cs")), "left")
           .join(first, F.col("_s").eqNullSafe(F.col("_fs")), "left"))
    return materialize(out.select("_s", "source_size", "target", "_epochs", "_cut", "_first"), "mix-cuts")


def _copies() -> Column:
    picked = F.coalesce(F.col("_key") <= F.col("_cut"), F.col("_key") < F.col("_first"), F.lit(False))
    return F.when(F.col("size") > 0, F.col("_epochs") + picked.cast("long")).otherwise(F.lit(0)).cast("long")


def _slim(docs: DataFrame, seed: int, weight: Column | None, carry: list[Column]) -> DataFrame:
    text = text_of(docs)
    weight = quality_weight(text) if weight is None else weight
    return docs.select(*carry, docs["source"].alias("_src"), n_words(text).alias("size"), weight.alias("_q"),
                       _key(docs["doc_id"], text, weight, seed).alias("_key"))


def plan_mix(docs: DataFrame, seed: int = 7, weight: Column | None = None, **options) -> DataFrame:
    """One row per document: ``size`` (words), ``source_size``, ``target`` of
    its source, ``copies`` (how often the mix takes it) and ``taken`` words."""
    # written once: the text is read a single time
    slim = materialize(_slim(docs, seed, weight, [docs["doc_id"]]), "mix-rows")
    cut = goals(slim.drop("doc_id"), **options)
    rows = slim.join(_sent(cut), F.col("_src").eqNullSafe(F.col("_s")))
    return rows.select("doc_id", F.col("_src").alias("source"), "size", "source_size", "target",
                       _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 7, weight: Column | None = None, **options) -> DataFrame:
    """The mix itself: every document repeated as often as it is taken; the
    columns are those of ``docs``.  Selection is a key bound per source, so
    texts are not shuffled."""
    cut = goals(materialize(_slim(docs, seed, weight, []), "mix-rows"), **options)
    row = F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("_row")
    rows = _slim(docs, seed, weight, [row]).join(_sent(cut), F.col("_src").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_copies", _copies()).where("_copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def _sent(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A written table of short rows, broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
