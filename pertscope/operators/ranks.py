"""Ordered statistics without a single-partition window.

A window ``ORDER BY x`` with no ``PARTITION BY`` moves every row into one task.
The helpers here instead:

1. reduce the input to distinct values with counts (map-side combine),
2. cut the value range into buckets at approximate quantiles of the distinct
   values, in their own type (a scalar subquery of at most ``n_buckets`` split
   points),
3. run the running aggregate inside each bucket (window partitioned by
   bucket), aggregate each bucket to one row, and carry the bucket totals
   forward with a window over the tiny (groups x buckets) totals table.

Results are exact; the quantiles only balance the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_BUCKETS, MAX_BUCKETS = 64, 1024     # a cluster's shuffle partitions lie between
SAMPLE_PER_BUCKET = 32


def _n_buckets(df: DataFrame) -> int:
    return max(MIN_BUCKETS, min(MAX_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _split_points(df: DataFrame, col: str, n_buckets: int) -> Column:
    """At most ``n_buckets - 1`` values of ``col``, in its own type, that cut the
    rows into about equal parts: a scalar subquery evaluated once inside the
    same plan.  Types without a numeric value are cut by a hashed sample whose
    share falls with the row count, so about 32 values a bucket are sorted."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType)):
        probs = [i / n_buckets for i in range(1, n_buckets)]
        return df.agg(F.percentile_approx(F.col(col), probs, 10000)).scalar()
    every = F.ceil(df.agg(F.count(F.lit(1))).scalar() / F.lit(n_buckets * SAMPLE_PER_BUCKET)).cast("long")
    sample = (df.filter(F.pmod(F.xxhash64(*df.columns), F.greatest(every, F.lit(1))) == 0)
              .agg(F.array_sort(F.collect_list(col)).alias("s")))
    return sample.select(F.transform(
        F.sequence(F.lit(1), F.lit(n_buckets - 1)),
        lambda i: F.get("s", F.floor(i * F.size("s") / F.lit(n_buckets)).cast("int")))).scalar()


def _with_bucket(df: DataFrame, col: str, n_buckets: int, out: str, descending: bool = False) -> DataFrame:
    """Bucket = number of split points that come before the value or equal it;
    null goes to the first bucket.  A binary search, a step a column: a value
    meets a few of the split points, not all."""
    key = F.col(col)
    df = df.withColumn("__splits", _split_points(df, col, n_buckets)).withColumn(out, F.lit(0))
    step = 1 << (n_buckets.bit_length() - 1)
    while step:
        at = F.get("__splits", F.col(out) + F.lit(step - 1))
        # behind the last split point there is a null, which nothing comes before
        df = df.withColumn(out, F.col(out) + F.when(at <= key, F.lit(step)).otherwise(F.lit(0)))
        step >>= 1
    if descending:
        # equal values of the ascending side go on: only what is greater comes first
        df = df.withColumn(out, F.when(key.isNull(), F.lit(0)).otherwise(F.size("__splits") - F.col(out)))
    return df.drop("__splits")


def prefix_agg(vc: DataFrame, order_col: str, cols: list[str], *, by: list[str] | None = None,
               agg: str = "sum", descending: bool = False, inclusive: bool = False,
               n_buckets: int | None = None, suffix: str = "_before") -> DataFrame:
    """Add ``<c><suffix>`` = running ``agg`` of ``c`` over rows that come before
    (or up to, if ``inclusive``) each row in ``order_col`` order, within ``by``.

    ``vc`` should already hold one row per distinct (by, order value); rows
    tied on ``order_col`` are otherwise ordered arbitrarily.  ``order_col`` may
    have any orderable type and is compared in that type (nulls first); the
    bucket count follows the session's shuffle partitions unless given.
    """
    by = list(by or [])
    if agg not in ("sum", "min", "max"):
        raise ValueError(agg)
    fn = {"sum": F.sum, "min": F.min, "max": F.max}[agg]
    vc = _with_bucket(vc, order_col, n_buckets or _n_buckets(vc), "__bucket", descending)
    upper = 0 if inclusive else -1
    order = F.desc_nulls_first(order_col) if descending else F.asc_nulls_first(order_col)
    wl = (Window.partitionBy(*by, "__bucket").orderBy(order)
          .rowsBetween(Window.unboundedPreceding, upper))
    loc = vc
    for c in cols:
        loc = loc.withColumn(f"__loc_{c}", fn(c).over(wl))
    tot = vc.groupBy(*by, "__bucket").agg(*[fn(c).alias(f"__tot_{c}") for c in cols])
    wo = (Window.partitionBy(*by).orderBy("__bucket")
          .rowsBetween(Window.unboundedPreceding, -1))
    off = tot.select(*by, "__bucket", *[fn(f"__tot_{c}").over(wo).alias(f"__off_{c}") for c in cols])
    out = loc.join(off, [*by, "__bucket"], "left")
    for c in cols:
        lo, of = F.col(f"__loc_{c}"), F.col(f"__off_{c}")
        if agg == "sum":
            val = F.coalesce(lo, F.lit(0)) + F.coalesce(of, F.lit(0))
        else:
            val = F.when(lo.isNull(), of).when(of.isNull(), lo).otherwise(
                F.least(lo, of) if agg == "min" else F.greatest(lo, of))
        out = out.withColumn(f"{c}{suffix}", val)
    return out.drop("__bucket", *[f"__loc_{c}" for c in cols], *[f"__off_{c}" for c in cols])


def value_counts(df: DataFrame, value_col: str, by: list[str] | None = None,
                 weight_cols: dict[str, Column] | None = None) -> DataFrame:
    """Distinct (by, value) with ``n`` and optional weighted sums."""
    by = list(by or [])
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, expr in (weight_cols or {}).items():
        aggs.append(F.sum(expr).alias(name))
    return df.groupBy(*by, value_col).agg(*aggs)


def average_ranks(df: DataFrame, value_col: str, by: list[str] | None = None,
                  out_col: str = "avg_rank") -> DataFrame:
    """Distinct values of ``value_col`` (per ``by``) with their 1-based average
    rank (ties share the mean of their positions) and count ``n``."""
    by = list(by or [])
    vc = value_counts(df.filter(F.col(value_col).isNotNull()), value_col, by)
    pre = prefix_agg(vc, value_col, ["n"], by=by)
    return pre.select(*by, value_col, "n",
                      (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(out_col))


def exact_percentiles(df: DataFrame, col: str, quantiles: dict[str, float],
                      by: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles (the usual definition: value at
    position h = (N-1)*q, interpolated between floor(h) and ceil(h)) per ``by``
    group, without gathering a group's values in one task: positions are read
    off bucketed cumulative counts over distinct values."""
    by = list(by or [])
    d = df.filter(F.col(col).isNotNull())
    vc = d.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    pre = prefix_agg(vc, col, ["n"], by=by, inclusive=True, suffix="_cum")
    tot = vc.groupBy(*by).agg(F.sum("n").alias("__total"))
    j = pre.join(tot, by) if by else pre.withColumn("__total", vc.agg(F.sum("n")).scalar())
    aggs = []
    for name, q in quantiles.items():
        h = (F.col("__total") - 1) * F.lit(float(q))
        aggs += [F.min(F.when(F.col("n_cum") > F.floor(h), F.col(col))).alias(f"__lo_{name}"),
                 F.min(F.when(F.col("n_cum") > F.ceil(h), F.col(col))).alias(f"__hi_{name}"),
                 F.first(h - F.floor(h)).alias(f"__f_{name}")]
    agg = j.groupBy(*by).agg(*aggs)
    outs = [(F.col(f"__lo_{n}") + F.col(f"__f_{n}") * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n)
            for n in quantiles]
    return agg.select(*by, *outs)
