"""Exact cosine k-nearest-neighbour search as a tiled Spark job.

Plan (one job, no driver loop, nothing collected):

1. Hash every query row into one of ``Bq`` query blocks and every reference row
   into one of ``Br`` reference blocks (``pmod(xxhash64(id), B)``).  Block sizes
   are bounded by construction (rows / B), independent of any data key, so a
   hot compound or label cannot make a block large.
2. Each query row is replicated to the ``Br`` tiles of its block row and each
   reference row to the ``Bq`` tiles of its block column (the usual block-matrix
   multiply layout).  ``cogroup(...).applyInPandas`` hands one tile - one query
   block and one reference block - to a Python worker at a time.
3. Inside the tile: normalise in float64, one GEMM per 512 query rows or 2 M
   distances, mask
   excluded pairs (same group / same id), keep the local top-k per query row in
   the order (distance, ref_id), ties included, so at most k candidates leave a
   tile however many references are equal.
4. Merge the per-tile candidates with ``row_number() over (partition by query
   order by distance, ref_id) <= k``; Spark plans this as a WindowGroupLimit,
   i.e. a partial top-k before the shuffle and a final one after.

The shuffle carries at most ``k * Br`` candidates per query; pick large
reference blocks to keep ``Br`` small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

DEFAULT_QUERY_BLOCK_ROWS = 4096
DEFAULT_REF_BLOCK_ROWS = 16384
GEMM_ROWS, GEMM_CELLS = 512, 1 << 21     # query rows, and distances, that are held at a time at most


def _normalise_rows(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    norms[norms == 0] = 1.0          # zero vector stays zero: distance 1 to all
    return x / norms[:, None]


def _stack(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack(col.to_numpy()).astype(np.float64, copy=False)


def _cosine_tile(left: pd.Series, right: pd.Series):
    """Distances of one tile: a function of a slice of the left rows."""
    q, r = _normalise_rows(_stack(left)), _normalise_rows(_stack(right))
    return lambda some: 1.0 - q[some] @ r.T


def _nearest(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's ``k`` smallest finite values, ties to the left."""
    width = dist.shape[1] // (8 * k)
    if width >= 4:
        # k pieces have a value at or below the k-th of the pieces' minima: few cells do, and only these are sorted
        pieces = dist[:, :dist.shape[1] // width * width].reshape(len(dist), -1, width).min(axis=2)
        bound = np.partition(pieces, k - 1, axis=1)[:, k - 1, None]
        if not np.isnan(bound).any():
            row, col = np.nonzero(dist <= bound)
            value = dist[row, col]
            order = np.lexsort((col, value, row))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            some = np.sort(order[place < k])
            some = some[np.isfinite(value[some])]
            return row[some], col[some]
    keep = np.isfinite(dist)
    if k < dist.shape[1]:
        kth = np.partition(dist, k - 1, axis=1)[:, k - 1, None]
        nearer, tied = dist < kth, dist == kth
        room = k - nearer.sum(axis=1, keepdims=True)
        keep &= nearer | (tied & (np.cumsum(tied, axis=1) <= room))
    return np.nonzero(keep)


def _tile_topk(k: int, exclude_group: bool, exclude_self: bool, has_group: bool, tile=_cosine_tile):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", "ref_id", "distance"] + (["query_group", "ref_group"] if has_group else [])
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({c: [] for c in cols})
        right = right.sort_values("rid", kind="stable", ignore_index=True)   # ties go to the lower id
        distances = tile(left["v"], right["v"])
        qid = left["qid"].to_numpy()
        rid = right["rid"].to_numpy()
        if has_group:
            codes, _ = pd.factorize(pd.concat([left["qg"], right["rg"]], ignore_index=True))
            qg_code, rg_code = codes[: len(left)], codes[len(left):]
        found = []
        step = max(1, min(GEMM_ROWS, GEMM_CELLS // len(right)))
        for at in range(0, len(left), step):
            some = slice(at, at + step)
            dist = distances(some)
            if exclude_self:
                dist[qid[some, None] == rid[None, :]] = np.inf
            if exclude_group:
                dist[qg_code[some, None] == rg_code[None, :]] = np.inf
            row, col = _nearest(dist, k)
            found.append(((row + at).astype(np.int32), col.astype(np.int32), dist[row, col]))
        rows, cols_idx, distance = (np.concatenate(x) for x in zip(*found))
        del found
        out = {
            "query_id": qid[rows],
            "ref_id": rid[cols_idx],
            "distance": distance,
        }
        if has_group:
            out["query_group"] = left["qg"].to_numpy()[rows]
            out["ref_group"] = right["rg"].to_numpy()[cols_idx]
        return pd.DataFrame(out, copy=False)

    return run


def cosine_knn(query: DataFrame, ref: DataFrame, k: int, *,
               id_col: str = "sig_id", vec_col: str = "embedding",
               group_col: str | None = None, exclude_same_group: bool = False,
               exclude_self: bool = False,
               query_block_rows: int = DEFAULT_QUERY_BLOCK_ROWS,
               ref_block_rows: int = DEFAULT_REF_BLOCK_ROWS,
               checkpoint: bool = True) -> DataFrame:
    """Exact top-k cosine neighbours of every query row among the reference rows.

    Returns ``(query_id, rank, ref_id, distance[, query_group, ref_group])`` with
    ``distance = 1 - cos`` and ``rank`` 1-based in the total order
    (distance, ref_id).  ``k`` is capped by the number of eligible references.
    ``exclude_same_group`` drops reference rows of the query's own group
    (leave-one-group-out search as one join); ``exclude_self`` drops ref_id ==
    query_id (self-graph).
    """
    return tiled_knn(query, ref, k, _cosine_tile, id_col=id_col, vec_col=vec_col, group_col=group_col,
                     exclude_same_group=exclude_same_group, exclude_self=exclude_self,
                     query_block_rows=query_block_rows, ref_block_rows=ref_block_rows, checkpoint=checkpoint)


def tiled_knn(query: DataFrame, ref: DataFrame, k: int, tile, *, id_col: str, vec_col: str,
              group_col: str | None = None, exclude_same_group: bool = False, exclude_self: bool = False,
              query_block_rows: int = DEFAULT_QUERY_BLOCK_ROWS, ref_block_rows: int = DEFAULT_REF_BLOCK_ROWS,
              checkpoint: bool = True) -> DataFrame:
    """``cosine_knn`` with the distances of ``tile(left values, right values)``,
    which gives a function from a slice of left rows to a matrix; infinite
    distances are no neighbours."""
    if k < 1:
        raise ValueError("k must be >= 1")
    if exclude_same_group and group_col is None:
        raise ValueError("exclude_same_group needs group_col")
    spark = query.sparkSession
    has_group = group_col is not None
    id_type = query.schema[id_col].dataType
    vec_type = query.schema[vec_col].dataType
    grp_type = query.schema[group_col].dataType if has_group else None

    q = query.select(F.col(id_col).alias("qid"),
                     *( [F.col(group_col).alias("qg")] if has_group else []),
                     F.col(vec_col).alias("v"))
    r = ref.select(F.col(id_col).cast(id_type).alias("rid"),
                   *( [F.col(group_col).cast(grp_type).alias("rg")] if has_group else []),
                   F.col(vec_col).cast(vec_type).alias("v"))

    # Block counts come from row counts, as scalar subqueries inside the same
    # plan (no driver-side action).  At least one query block per core (while
    # blocks hold >= 256 rows) so small inputs still run in parallel.
    par = spark.sparkContext.defaultParallelism
    n_q = q.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_r = r.agg(F.count(F.lit(1)).alias("n")).scalar()
    bq = F.greatest(F.lit(1), F.ceil(n_q / F.lit(query_block_rows)),
                    F.least(F.lit(par), F.ceil(n_q / F.lit(256)))).cast("long")
    br = F.greatest(F.lit(1), F.ceil(n_r / F.lit(ref_block_rows))).cast("long")

    qx = (q.withColumn("qb", F.pmod(F.xxhash64("qid"), bq))
          .withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), br - 1))))
    rx = (r.withColumn("rb", F.pmod(F.xxhash64("rid"), br))
          .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), bq - 1))))

    fields = [T.StructField("query_id", id_type), T.StructField("ref_id", id_type),
              T.StructField("distance", T.DoubleType())]
    if has_group:
        fields += [T.StructField("query_group", grp_type), T.StructField("ref_group", grp_type)]
    schema = T.StructType(fields)

    cand = (qx.groupBy("qb", "rb").cogroup(rx.groupBy("qb", "rb"))
            .applyInPandas(_tile_topk(k, exclude_same_group, exclude_self, has_group, tile), schema))

    w = Window.partitionBy("query_id").orderBy("distance", "ref_id")
    out = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    cols = ["query_id", "rank", "ref_id", "distance"] + (["query_group", "ref_group"] if has_group else [])
    out = out.select(*cols)
    if checkpoint:
        # The neighbour table is the expensive intermediate every later step
        # reads (often several times); write it once to the shared checkpoint
        # folder so lineage is cut and a lost executor does not redo GEMMs.
        out = materialize(out, "neighbors")
    return out


def _euclidean_tile(left: pd.Series, right: pd.Series):
    """Euclidean distances of one tile, from differences where they are small."""
    q, r = _stack(left), _stack(right)
    nq, nr = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)

    def distances(some: slice) -> np.ndarray:
        scale = nq[some, None] + nr[None, :]
        d2 = q[some] @ r.T
        d2 *= 2
        np.subtract(scale, d2, out=d2)
        # products lose what near rows differ by
        scale *= 1e-6
        i, j = np.nonzero(d2 < scale)
        for k in range(0, len(i), 65536):
            diff = q[some][i[k:k + 65536]] - r[j[k:k + 65536]]
            d2[i[k:k + 65536], j[k:k + 65536]] = np.einsum("ij,ij->i", diff, diff)
        np.maximum(d2, 0.0, out=d2)
        return np.sqrt(d2, out=d2)

    return distances


def knn_graph(profiles: DataFrame, k: int = 15, *, id_col: str = "sig_id", vec_col: str = "embedding",
              metric: str = "cosine") -> DataFrame:
    """Self-neighbour graph (V4): every profile's k nearest others by cosine or,
    with ``metric='euclidean'``, Euclidean distance."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError("metric must be 'cosine' or 'euclidean'")
    tile = _cosine_tile if metric == "cosine" else _euclidean_tile
    return tiled_knn(profiles, profiles, k, tile, id_col=id_col, vec_col=vec_col, exclude_self=True)
