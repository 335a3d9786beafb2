"""Ingest, QC and training-data preparation operators.

Profiles are rows with an array column; per-gene work uses the long form
``(sig_id, pos, value)`` produced by ``posexplode``.  Dimension tables (genes,
vocabulary, category codes) are small and bounded by the gene/category count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import clip_negative, vector_sum
from .ranks import prefix_agg


def to_long(df: DataFrame, vec: str = "expr", id_col: str = "sig_id") -> DataFrame:
    return df.select(id_col, F.posexplode(vec).alias("pos", "value"))


def landmark_filter(long: DataFrame, genes: DataFrame) -> DataFrame:
    """keep genes whose feature_space is 'landmark' (semi join on the gene dimension)."""
    lm = genes.filter(F.col("feature_space") == "landmark").select("pos")
    return long.join(F.broadcast(lm), "pos", "left_semi")


def global_min_gate(df: DataFrame, vec: str = "expr") -> DataFrame:
    """A17 + F2: clip negatives only when the global minimum is negative."""
    gmin = df.agg(F.min(F.array_min(vec))).scalar()
    return df.withColumn(vec, F.when(gmin < 0, clip_negative(vec)).otherwise(F.col(vec).cast("array<double>")))


def drop_empty_profiles(df: DataFrame, vec: str = "expr") -> DataFrame:
    """keep rows whose (clipped) values sum to more than zero."""
    return df.filter(vector_sum(vec) > 0)


def hq_signature_filter(sig: DataFrame) -> DataFrame:
    """qc_pass='1', is_hiq='1', cc_q75 > 0.2, tas >= 0.2, batch pct < 95 (string columns cast at use)."""
    return sig.filter((F.col("qc_pass") == "1") & (F.col("is_hiq") == "1")
                      & (F.col("cc_q75").cast("double") > 0.2) & (F.col("tas").cast("double") >= 0.2)
                      & (F.col("batch_effect_tstat_pct").cast("double") < 95))


def explode_instance_ids(sig: DataFrame) -> DataFrame:
    """one row per instance id packed in ``distil_ids`` ('|'-separated)."""
    return sig.select("sig_id", F.explode(F.split("distil_ids", "\\|")).alias("instance_id"))


def hq_instances(sig: DataFrame, instances: DataFrame) -> DataFrame:
    """instances listed by passing signatures that pass their own QC."""
    listed = explode_instance_ids(hq_signature_filter(sig)).select("instance_id")
    return instances.join(listed, "instance_id", "left_semi").filter(F.col("qc_pass") == "1")


def map_tas_to_instances(sig: DataFrame, instances: DataFrame, sentinel: str = "nan") -> DataFrame:
    """instance -> (passing) signature -> TAS string; the last signature in
    id order wins for an instance listed twice; unmatched -> sentinel."""
    hq = hq_signature_filter(sig)
    inst = explode_instance_ids(hq).groupBy("instance_id").agg(F.max("sig_id").alias("sig_id"))
    tas = inst.join(hq.select("sig_id", "tas"), "sig_id")
    return (instances.select("instance_id").join(tas, "instance_id", "left")
            .select("instance_id", F.coalesce(F.col("tas").cast("string"), F.lit(sentinel)).alias("tas")))


def category_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """0-based code by sorted distinct value, joined back; rows without a
    value are left out.  The distinct values are numbered bucket by bucket."""
    d = df.filter(F.col(col).isNotNull()).select(col).distinct().withColumn("__one", F.lit(1))
    codes = prefix_agg(d, col, ["__one"], suffix="_before").select(
        col, F.col("__one_before").cast("int").alias(out))
    return df.join(codes, col)


def vocab_filter(long: DataFrame, vocab: DataFrame) -> DataFrame:
    """flag 1 / -1 by vocabulary membership; keep matched rows."""
    v = vocab.select("pos").withColumn("in_vocab", F.lit(1))
    j = long.join(F.broadcast(v), "pos", "left").withColumn("flag", F.coalesce("in_vocab", F.lit(-1))).drop("in_vocab")
    return j


def _bin_udf(n_bins: int):
    grid = np.linspace(0, 1, n_bins - 1)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(col: pd.Series) -> pd.Series:
        out = []
        for v in col:
            x = np.asarray(v, dtype=np.float64)
            b = np.zeros(len(x), dtype=np.int32)
            nzm = x != 0
            if nzm.any():
                edges = np.quantile(x[nzm], grid)
                b[nzm] = np.digitize(x[nzm], edges)      # left edge: count of edges <= x
            out.append(b)
        return pd.Series(out)

    return run


def bin_values(df: DataFrame, vec: str, out: str, n_bins: int = 51) -> DataFrame:
    """per-profile value binning.  Zeros stay 0; edges are the linear
    quantiles at linspace(0, 1, n_bins-1) of the profile's non-zero values;
    a non-zero value gets the number of edges <= value (1..n_bins-1).

    Row-local numeric work on one array, so it runs as an Arrow-batched pandas
    UDF (numpy per profile); no shuffle is involved."""
    return df.withColumn(out, _bin_udf(n_bins)(F.col(vec)))


def tokenize(long_binned: DataFrame, max_len: int = 1000, cls_id: int = -1) -> DataFrame:
    """per profile keep non-zero genes, prepend <cls>, truncate to
    ``max_len``.  Over-long profiles keep the genes with the smallest
    ``md5(sig_id:pos)`` (deterministic subsample).  Returns the tokens
    ``(sig_id, position, gene_pos, value)``; ``pad_tokens`` fills them up."""
    nz = long_binned.filter(F.col("value") != 0)
    w = Window.partitionBy("sig_id").orderBy(F.md5(F.concat_ws(":", F.col("sig_id").cast("string"),
                                                                 F.col("pos").cast("string"))))
    kept = nz.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max_len - 1)
    w2 = Window.partitionBy("sig_id").orderBy("pos")
    toks = kept.select("sig_id", (F.row_number().over(w2)).alias("position"), F.col("pos").alias("gene_pos"), "value")
    cls = long_binned.select("sig_id").distinct().select("sig_id", F.lit(0).alias("position"),
                                                         F.lit(cls_id).alias("gene_pos"), F.lit(0).alias("value"))
    return cls.unionByName(toks.withColumn("value", F.col("value").cast("int")))


def pad_tokens(tokens: DataFrame, max_len: int = 1000, pad_id: int = -2, pad_value: int = -2) -> DataFrame:
    """the tokens of every profile and pad tokens after them, up to ``max_len``."""
    held = tokens.groupBy("sig_id").agg(F.max("position").alias("__last")).filter(F.col("__last") < max_len - 1)
    pads = held.select("sig_id", F.explode(F.sequence(F.col("__last") + 1, F.lit(max_len - 1))).alias("position"),
                       F.lit(pad_id).alias("gene_pos"), F.lit(pad_value).alias("value"))
    return tokens.unionByName(pads)


def random_value_mask(vec: Column, key: Column, ratio: float = 0.0, mask_value: int = -1,
                      pad_value: int = -2, seed: int = 0) -> Column:
    """replace a ``ratio`` share of non-pad values with ``mask_value``
    (decided by a seeded hash of (key, position)); ratio 0 is the identity."""
    if ratio <= 0:
        return vec
    return F.transform(vec, lambda x, i: F.when(
        (x != pad_value) & ((F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"),
                                                                  i.cast("string"))), 1, 8), 16, 10)
                            .cast("double") / 4294967296.0) < ratio), F.lit(mask_value)).otherwise(x))


def hash_bucket(key: Column, buckets: int, seed: int = 0) -> Column:
    """Deterministic bucket from md5(seed:key) (same value in SQL engines)."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10)
    return (h.cast("long") % buckets).cast("int")


def train_valid_split(df: DataFrame, id_col: str, valid_fraction_tenths: int = 1, seed: int = 0) -> DataFrame:
    """stable row split (default 90/10) by hash bucket of the row id."""
    b = hash_bucket(F.col(id_col), 10, seed)
    return df.withColumn("split", F.when(b < valid_fraction_tenths, F.lit("valid")).otherwise(F.lit("train")))


def group_holdout_split(df: DataFrame, group_col: str, test_fraction_tenths: int = 1, seed: int = 0) -> DataFrame:
    """F16: hold out whole groups (compound-out / cell-out) by hash bucket of the group key."""
    b = hash_bucket(F.col(group_col), 10, seed)
    return df.withColumn("split", F.when(b < test_fraction_tenths, F.lit("test")).otherwise(F.lit("train")))


def key_match_first(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """First row per key in input order.  A ``min_by`` aggregate, so a key
    holding many rows is combined map-side instead of sorted in one window."""
    others = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order_col)).alias("__r"))
    return first.select(key, *[F.col(f"__r.{c}").alias(c) for c in others])


def concat_matrices(sources: list[tuple[DataFrame, list[str]]], id_col: str = "sig_id", vec_col: str = "expr") -> tuple[DataFrame, list[str]]:
    """Rows of several matrices, each with its own gene order, on the union
    of their genes in name order; a gene that a source lacks is null there.

    A source's order is an array of positions in its vectors, one entry a gene of
    the union, so rows are rearranged where they are and nothing is shuffled."""
    if not sources:
        raise ValueError("no matrix to put together")
    for _, genes in sources:
        if len(set(genes)) != len(genes):
            raise ValueError("a gene stands twice in one matrix")
    union = sorted({g for _, genes in sources for g in genes})
    out = None
    for df, genes in sources:
        at = {g: i for i, g in enumerate(genes)}
        place = F.array(*[F.lit(at.get(g)).cast("int") for g in union])
        rows = df.select(id_col, F.transform(place, lambda i: F.get(F.col(vec_col), i)).alias(vec_col))
        out = rows if out is None else out.unionByName(rows)
    return out, union
