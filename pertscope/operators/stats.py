"""Statistics and evaluation operators (calibration, rank statistics, ROC,
proportions, summaries).  Global orderings go through ``ranks.prefix_agg`` so
that no operator funnels its input into one partition."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .ranks import average_ranks, exact_percentiles, prefix_agg


# ----------------------------------------------------------- calibration --

def threshold_bin(measure: Column, n: int = 20) -> Column:
    """Number of edges ``i*(1/n)`` (i = 0..n) that are <= measure, minus one.

    Edges are ``i * 0.05`` as doubles (equal to ``linspace(0, 1, 21)``), so a
    measure of exactly 0.15 lands where the reference puts it (0.15 < 3*0.05).
    """
    step = 1.0 / n
    m = measure.cast("double")
    c = F.least(F.lit(n), F.greatest(F.lit(-1), F.floor(m * n).cast("int")))
    up = F.when((c < n) & ((c + 1).cast("double") * step <= m), 1).otherwise(0)
    down = F.when((c >= 0) & (c.cast("double") * step > m), 1).otherwise(0)
    return c + up - down


def accuracy_above_threshold(df: DataFrame, measure: str, truth: Column | str,
                             n_thresholds: int = 21, by: list[str] | None = None) -> DataFrame:
    """E5: for thresholds t_i = i*0.05, rows with measure >= t_i, how many are
    true, and the percentage true (NULL when no row passes); with ``by`` for
    each of its groups, counted together in one pass."""
    n, by = n_thresholds - 1, list(by or [])
    tr = F.col(truth) if isinstance(truth, str) else truth
    binned = (df.filter(F.col(measure).isNotNull())
              .select(*by, threshold_bin(F.col(measure), n).alias("b"), tr.cast("long").alias("t"))
              .groupBy(*by, "b").agg(F.count(F.lit(1)).alias("nb"), F.sum("t").alias("tb")))
    spark = df.sparkSession
    thr = spark.range(0, n + 1).select(F.col("id").cast("int").alias("b"))
    # reverse running sum over at most 21 rows a group (bounded, tiny)
    order = Window.partitionBy(*by).orderBy(F.col("b").desc()) if by else Window.orderBy(F.col("b").desc())
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    if by:
        # zeros for every threshold of every group instead of a null-safe join
        zeros = binned.select(*by).distinct().select(
            *by, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("b"), F.lit(0).alias("nb"), F.lit(0).alias("tb"))
        counted = (binned.filter(F.col("b") >= 0).unionByName(zeros)
                   .groupBy(*by, "b").agg(F.sum("nb").alias("nb"), F.sum("tb").alias("tb")))
    else:
        counted = thr.join(binned, "b", "left")
    j = (counted
         .select(*by, "b", F.coalesce("nb", F.lit(0)).alias("nb"), F.coalesce("tb", F.lit(0)).alias("tb"))
         .select(*by, "b", F.sum("nb").over(w).alias("n_compounds"), F.sum("tb").over(w).alias("n_compounds_true")))
    return j.select(
        *by,
        (F.col("b").cast("double") * F.lit(1.0 / n)).alias("threshold"),
        F.col("n_compounds").cast("long").alias("n_compounds"),
        F.when(F.col("n_compounds") > 0, F.col("n_compounds_true") * 100.0 / F.col("n_compounds"))
        .alias("pct_true"),
        F.col("n_compounds_true").cast("long").alias("n_compounds_true"))


def threshold_correlation(calibration: DataFrame, by: list[str], measure: str = "pct_true") -> DataFrame:
    """E6 on the tables of ``accuracy_above_threshold``: per group Spearman's
    rho of ``measure`` against the threshold, thresholds without a value left
    out; NULL with fewer than two values or when all are equal.

    A group has one row per threshold, so its window is bounded.  Average ranks
    are halves of integers, so the sums below are exact."""
    d = calibration.filter(F.col(measure).isNotNull())

    def rank_of(col: str) -> Column:
        tied = F.count(F.lit(1)).over(Window.partitionBy(*by, col))
        return F.rank().over(Window.partitionBy(*by).orderBy(col)) + (tied - 1) / F.lit(2.0)

    r = d.select(*by, rank_of(measure).alias("x"), rank_of("threshold").alias("y"))
    s = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
                           F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
                           F.sum(F.col("y") * F.col("y")).alias("syy"))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = (n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy)
    return s.select(*by, n.cast("long").alias("n"),
                    F.when(spread > 0, (n * F.col("sxy") - sx * sy) / F.sqrt(spread)).alias("rho"))


def label_set_overlap(a: Column, b: Column, sep: str = ";") -> Column:
    """True when two ';'-joined label strings share an item (NULL = empty)."""
    sa = F.when(a.isNull() | (a == ""), F.array().cast("array<string>")).otherwise(F.split(a, sep))
    sb = F.when(b.isNull() | (b == ""), F.array().cast("array<string>")).otherwise(F.split(b, sep))
    return F.coalesce(F.arrays_overlap(sa, sb), F.lit(False))


# -------------------------------------------------------- proportions --

def value_proportions(df: DataFrame, col: str) -> DataFrame:
    """Count and normalised proportion per value (NULLs dropped)."""
    vc = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = vc.agg(F.sum("n")).scalar()
    return vc.select(col, F.col("n").cast("long").alias("n"), (F.col("n") / total).alias("proportion"))


def fractional_proportions(df: DataFrame, col: str, sep: str = ";", out: str = "label") -> DataFrame:
    """A row with m labels adds 1/m to each; divided by the non-empty rows."""
    items = F.filter(F.transform(F.split(F.col(col), sep), lambda x: F.trim(x)), lambda x: x != "")
    rows = df.filter(F.col(col).isNotNull()).select(items.alias("items")).filter(F.size("items") > 0)
    n_rows = rows.agg(F.count(F.lit(1))).scalar()
    return (rows.select(F.explode("items").alias(out), (1.0 / F.size("items")).alias("w"))
            .groupBy(out).agg((F.sum("w") / n_rows).alias("proportion")))


def top_n(df: DataFrame, order: Column, n: int) -> DataFrame:
    """A report limited to the first n rows of a total order (E7, A8 top N)."""
    return df.orderBy(order).limit(n)


# ---------------------------------------------------- rank statistics --

def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman rho (average ranks, rows with a missing side dropped), n,
    the t statistic and its two-sided p-value."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    rx = average_ranks(d, x, out_col="rx").drop("n")
    ry = average_ranks(d, y, out_col="ry").drop("n")
    r = d.join(rx, x).join(ry, y)
    agg = r.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    out = agg.select(F.col("n").cast("long").alias("n"), "rho",
                     F.when((F.col("n") > 2) & (F.abs(F.col("rho")) < 1), t).alias("t"))
    return out.withColumn("p_value", _t_two_sided(F.col("t"), F.col("n") - 2))


def _betacf(a: float, b: float, x: float) -> float:
    # continued fraction for the regularised incomplete beta (Lentz)
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbeta) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbeta) * _betacf(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    out = []
    for tv, dv in zip(t, dof):
        if tv is None or dv is None or pd.isna(tv) or pd.isna(dv) or dv <= 0:
            out.append(None)
        else:
            out.append(betainc(dv / 2.0, 0.5, dv / (dv + tv * tv)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal (a scalar helper for 1-row results)."""
    return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2.0))).astype("float64")


def mann_whitney_greater(df: DataFrame, value: str, flag: str) -> DataFrame:
    """One-sided U test that values with ``flag`` true are greater.

    U from average ranks; tie-corrected normal approximation with continuity
    correction; NULL when either side is empty.
    """
    # one row per distinct value: a value that many rows share is no hot join key
    counts = (score_class_counts(df.filter(F.col(flag).isNotNull()), value, flag)
              .withColumn("n", F.col("pos") + F.col("neg")))
    ranks = prefix_agg(counts, value, ["n"]).withColumn("r", F.col("n_before") + (F.col("n") + 1) / 2)
    s = ranks.agg(F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("r"))).alias("r1"),
                  F.sum("pos").alias("n1"), F.sum("neg").alias("n2"),
                  F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("tie_sum"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie_sum") / (n * (n - 1))))
    z = F.when(sigma > 0, (u - mu - 0.5) / sigma)
    ok = (F.col("n1") > 0) & (F.col("n2") > 0)
    out = s.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                   F.when(ok, u).alias("u"), F.when(ok, z).alias("z"))
    out = out.withColumn("p_value", normal_sf(F.col("z")))
    return out.withColumn("stars", significance_stars(F.col("p_value")))


def significance_stars(p: Column) -> Column:
    return (F.when(p.isNull(), F.lit("n/a"))
            .when(p < 1e-4, F.lit("****")).when(p < 1e-3, F.lit("***"))
            .when(p < 1e-2, F.lit("**")).when(p < 0.05, F.lit("*")).otherwise(F.lit("ns")))


# ---------------------------------------------------------------- ROC --

def score_class_counts(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    by = list(by or [])
    return (df.filter(F.col(score).isNotNull())
            .groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"),
                                     F.sum((~F.col(label).cast("boolean")).cast("long")).alias("neg")))


def roc_curve(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, descending."""
    by = list(by or [])
    sc = score_class_counts(df, score, label, by)
    pre = prefix_agg(sc, score, ["pos", "neg"], by=by, descending=True, inclusive=True, suffix="_cum")
    if by:
        j = pre.join(sc.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")), by)
    else:
        j = pre.withColumn("P", sc.agg(F.sum("pos")).scalar()).withColumn("N", sc.agg(F.sum("neg")).scalar())
    return j.select(*by, F.col(score).alias("threshold"),
                    F.when(F.col("P") > 0, F.col("pos_cum") / F.col("P")).alias("tpr"),
                    F.when(F.col("N") > 0, F.col("neg_cum") / F.col("N")).alias("fpr"))


def roc_auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """AUROC with ties counted half; NULL when only one class is present."""
    by = list(by or [])
    sc = score_class_counts(df, score, label, by).withColumn("n", F.col("pos") + F.col("neg"))
    pre = prefix_agg(sc, score, ["n"], by=by)
    ranked = pre.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0)
    s = ranked.groupBy(*by).agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("rpos"),
                                F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    return s.select(*by, F.col("P").cast("long").alias("n_pos"), F.col("N").cast("long").alias("n_neg"),
                    F.when((F.col("P") > 0) & (F.col("N") > 0),
                           (F.col("rpos") - P * (P + 1) / 2) / (P * N)).alias("auroc"))


# ------------------------------------------------------------ summaries --

def group_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, exact median and mean per group."""
    base = df.groupBy(by).agg(F.count(F.col(value)).alias("n"), F.avg(value).alias("mean"))
    return base.join(exact_percentiles(df, value, {"median": 0.5}, [by]), by, "left")


def range_histogram(df: DataFrame, value: str, n_bins: int = 37) -> DataFrame:
    """A12 over the data's own range: ``(bin, left, right, count)`` of ``n_bins``
    equal bins from the least to the greatest value, last bin closed, zero bins
    included; one value alone lies in the middle of a range of length 1."""
    v = F.col(value).cast("double")
    lo, hi = (df.agg(f(v)).scalar() for f in (F.min, F.max))
    half = F.when(lo == hi, F.lit(0.5)).otherwise(F.lit(0.0))
    step = (hi - lo + 2 * half) / F.lit(n_bins)
    rows = df.where(v.isNotNull()).select(v.alias("_v")).withColumns({"_lo": lo - half, "_step": step})
    at = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_step")).cast("int"), F.lit(n_bins - 1))
    counts = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = df.sparkSession.range(0, n_bins).select(F.col("id").cast("int").alias("bin"))
    return (bins.join(counts, "bin", "left").withColumns({"_lo": lo - half, "_step": step})
            .select("bin", (F.col("_lo") + F.col("bin") * F.col("_step")).alias("left"),
                    (F.col("_lo") + (F.col("bin") + 1) * F.col("_step")).alias("right"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def histogram(df: DataFrame, value: str, n_bins: int = 20, by: list[str] | None = None) -> DataFrame:
    """Counts on ``n_bins`` equal bins over [0, 1], last bin closed, zero
    bins included."""
    by = list(by or [])
    b = F.least(threshold_bin(F.col(value), n_bins), F.lit(n_bins - 1))
    inside = (F.col(value) >= 0) & (F.col(value) <= 1)
    counts = df.filter(inside).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = df.sparkSession.range(0, n_bins).select(F.col("id").cast("int").alias("bin"))
    keys = df.select(*by).distinct().join(bins) if by else bins
    step = 1.0 / n_bins
    return (keys.join(counts, [*by, "bin"], "left")
            .select(*by, "bin", (F.col("bin") * step).alias("left"), ((F.col("bin") + 1) * step).alias("right"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def five_number_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """q1, median, q3 (linear interpolation) and the upper whisker =
    largest value <= q3 + 1.5*IQR, per group."""
    q = (exact_percentiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
         .join(df.groupBy(*by).agg(F.count(F.col(value)).alias("n")), by))
    j = df.join(q, by)
    fence = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    wh = j.groupBy(*by).agg(F.max(F.when(F.col(value) <= fence, F.col(value))).alias("whisker_high"),
                            F.min(F.when(F.col(value) >= F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                                         F.col(value))).alias("whisker_low"))
    return q.join(wh, by)


def ecdf(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Cumulative fraction at each distinct value (<= value)."""
    by = list(by or [])
    # the cuts, the buckets, their totals and the groups' totals read the distinct values: made once
    vc = materialize(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")),
                     "ecdf-values")
    pre = prefix_agg(vc, value, ["n"], by=by, inclusive=True, suffix="_cum")
    if by:
        j = pre.join(vc.groupBy(*by).agg(F.sum("n").alias("total")), by)
    else:
        j = pre.withColumn("total", vc.agg(F.sum("n")).scalar())
    return j.select(*by, value, (F.col("n_cum") / F.col("total")).alias("ecdf"))


def classification_metrics(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, error rate and macro precision / recall / F1 over the
    classes present in truth or prediction (0 on zero division)."""
    by = list(by or [])
    tp = df.filter(F.col(truth) == F.col(pred)).groupBy(*by, F.col(truth).alias("cls")).agg(F.count(F.lit(1)).alias("tp"))
    nt = df.groupBy(*by, F.col(truth).alias("cls")).agg(F.count(F.lit(1)).alias("n_true"))
    npred = df.groupBy(*by, F.col(pred).alias("cls")).agg(F.count(F.lit(1)).alias("n_pred"))
    per = (nt.join(npred, [*by, "cls"], "full").join(tp, [*by, "cls"], "left")
           .select(*by, "cls", F.coalesce("tp", F.lit(0)).alias("tp"),
                   F.coalesce("n_true", F.lit(0)).alias("n_true"), F.coalesce("n_pred", F.lit(0)).alias("n_pred")))
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    per = per.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0,
                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    agg = per.groupBy(*by).agg(F.sum("tp").alias("correct"), F.sum("n_true").alias("n"),
                               F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                               F.avg("f1").alias("macro_f1"))
    return agg.select(*by, F.col("n").cast("long").alias("n"), (F.col("correct") / F.col("n")).alias("accuracy"),
                      (1 - F.col("correct") / F.col("n")).alias("error_rate"),
                      "macro_precision", "macro_recall", "macro_f1")


def count_overlay(df: DataFrame, label: str, conf: str, threshold: float = 0.25, top_n: int = 10) -> DataFrame:
    """A10: per label, count over all rows and over rows with ``conf`` strictly
    above the threshold, both as % of all labelled rows; the report keeps the
    ``top_n`` labels by filtered count (ties by label)."""
    d = df.filter(F.col(label).isNotNull())
    n_total = d.agg(F.count(F.lit(1))).scalar()
    c = d.groupBy(label).agg(F.count(F.lit(1)).alias("count_all"),
                             F.sum(F.when(F.col(conf) > threshold, 1).otherwise(0)).alias("count_filt"))
    top = c.filter(F.col("count_filt") > 0).orderBy(F.col("count_filt").desc(), F.col(label)).limit(top_n)
    return top.select(label, F.col("count_all").cast("long").alias("count_all"),
                      F.col("count_filt").cast("long").alias("count_filt"),
                      (F.col("count_all") / n_total * 100).alias("perc_all"),
                      (F.col("count_filt") / n_total * 100).alias("perc_filt"))
