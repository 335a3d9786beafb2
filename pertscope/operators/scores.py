"""Score normalisation and the composite confidence score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle


def minmax(df: DataFrame, col: str, out: str) -> DataFrame:
    """(x - min) / (max - min) with min/max as scalar subqueries;
    max = min gives NULL (the reference's 0/0)."""
    lo = df.agg(F.min(col)).scalar()
    hi = df.agg(F.max(col)).scalar()
    return df.withColumn(out, F.when(hi > lo, (F.col(col) - lo) / (hi - lo)))


def max_scaled(df: DataFrame, col: str, out: str) -> DataFrame:
    """X / max, or 0 when the maximum is not positive."""
    hi = df.agg(F.max(col)).scalar()
    return df.withColumn(out, F.when(hi > 0, F.col(col) / hi).otherwise(F.lit(0.0)))


def mean_ignoring_null(cols: list[str]) -> Column:
    """Mean of the non-null columns (NULL when all are NULL)."""
    s = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 0, s / n)


def n_sigs_qc(samples: DataFrame, compounds: DataFrame) -> DataFrame:
    """A5: distinct QC-passing compound samples per compound; missing -> 1."""
    n = (samples.filter((F.col("pert_type") == "trt_cp") & (F.col("qc_pass") == "1"))
         .groupBy("compound").agg(F.countDistinct("cp_sig").alias("n_sigs")))
    return compounds.join(by_shuffle(n), "compound", "left").withColumn(
        "n_sigs", F.coalesce(F.col("n_sigs"), F.lit(1)).cast("long"))


def mean_tas(samples: DataFrame, compounds: DataFrame) -> DataFrame:
    """Mean TAS per compound over its compound samples; missing -> 0."""
    m = samples.filter(F.col("pert_type") == "trt_cp").groupBy("compound").agg(F.avg("tas").alias("mean_tas"))
    return compounds.join(by_shuffle(m), "compound", "left").withColumn("mean_tas", F.coalesce("mean_tas", F.lit(0.0)))
