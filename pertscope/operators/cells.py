"""Approximate cosine kNN (V9) on cells that decide who meets whom.

``fit_cells`` trains coarse centres on a bounded sample of the reference and
chooses, on held-out queries of that sample, how many cells a query must visit
to meet the wanted share of its true neighbours.  Clustered vectors need few
cells; vectors without structure need many, and then the search costs what it
must.

``approx_knn`` puts every reference in its nearest centre's cell and sends
every query to the cells of its ``n_probe`` nearest centres: the cell is the
shuffle key, so only rows of one cell are compared.  A cell of more than
``cell_rows`` references is dealt out over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .knn import _cosine_tile, _normalise_rows, _stack, _tile_topk, cosine_knn

SAMPLE_ROWS, MAX_CELLS, HELD_OUT = 16384, 1024, 512
COPIES = 1 << 14                 # rows for their cells that leave a task's Python at a time


@dataclass(frozen=True)
class Cells:
    """Unit centres (rows) and the number of cells a query visits."""
    centres: np.ndarray
    n_probe: int


def fit_cells(ref: DataFrame, k: int = 10, *, id_col: str = "sig_id", vec_col: str = "embedding",
              recall: float = 0.95, n_cells: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = 12,
              seed: int = 7) -> Cells:
    """Centres by spherical k-means on at most ``sample_rows`` references (those
    with the lowest hashed ids), about the square root of the reference's rows
    in number, 1,024 at most.

    ``n_probe`` is the least number of cells that holds the share ``recall`` of
    the k nearest sampled references of up to 512 sampled rows, which are left
    out of the training.  Neighbours in the sample are farther away than in the
    whole table, so the choice errs on the safe side."""
    sample = (ref.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v")).where("v IS NOT NULL")
              .orderBy(F.xxhash64("i"), "i").limit(sample_rows).select("v").collect())
    if not sample:
        return Cells(np.zeros((1, 0)), 1)
    x = _normalise_rows(np.array([r["v"] for r in sample], dtype=np.float64))
    held = min(HELD_OUT, len(x) // 4)
    queries, x = x[:held], x[held:]
    n = n_cells or int(min(MAX_CELLS, max(1, round(ref.count() ** 0.5))))
    n = min(n, len(x))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        full = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(full[:, None], _normalise_rows(sums), centres)
    if not held:
        return Cells(centres, n)
    cell = (x @ centres.T).argmax(axis=1)
    near = np.argpartition(-(queries @ x.T), min(k, len(x)) - 1, axis=1)[:, :min(k, len(x))]
    visit = np.argsort(np.argsort(-(queries @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(visit, cell[near], axis=1).ravel()) + 1
    return Cells(centres, int(needed[max(int(np.ceil(recall * len(needed))) - 1, 0)]))


def _in_cells(df: DataFrame, index: Cells, probes: int) -> DataFrame:
    """``df(..., v)`` once for each of the ``probes`` nearest cells of ``v``."""
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = _normalise_rows(_stack(frame["v"]))
            near = x @ index.centres.T if index.centres.size else np.zeros((len(x), 1))
            cell = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            # a batch's copies leave a few rows at a time, however many cells each row visits
            step = max(1, COPIES // cell.shape[1])
            for at in range(0, len(frame), step):
                some = cell[at:at + step]
                out = frame.iloc[at:at + step]
                out = out.loc[out.index.repeat(some.shape[1])].reset_index(drop=True)
                out["cell"] = some.ravel()
                yield out

    return df.mapInPandas(run, schema)


def _placed(query: DataFrame, ref: DataFrame, index: Cells, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    kind = query.schema[id_col].dataType
    q = query.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("v")).where("v IS NOT NULL")
    r = ref.select(F.col(id_col).cast(kind).alias("rid"), F.col(vec_col).alias("v")).where("v IS NOT NULL")
    return _in_cells(q, index, index.n_probe), _in_cells(r, index, 1)


def compared_pairs(query: DataFrame, ref: DataFrame, index: Cells, *, id_col: str = "sig_id",
                   vec_col: str = "embedding") -> DataFrame:
    """One row: ``compared`` pairs, ``pairs`` in all and their ``share``."""
    q, r = (df.groupBy("cell").agg(F.count("*").alias(n)) for df, n in
            zip(_placed(query, ref, index, id_col, vec_col), ("nq", "nr")))
    met = q.join(r, "cell", "left").agg(
        F.sum(F.col("nq") * F.coalesce("nr", F.lit(0))).alias("compared"), F.sum("nq").alias("visits"))
    n_ref = ref.where(F.col(vec_col).isNotNull()).agg(F.count("*")).scalar()
    pairs = F.col("visits") / index.n_probe * n_ref
    return met.select(F.col("compared").cast("long").alias("compared"), pairs.cast("long").alias("pairs"),
                      (F.col("compared") / pairs).alias("share"))


def approx_knn(query: DataFrame, ref: DataFrame, k: int, *, index: Cells | None = None, id_col: str = "sig_id",
               vec_col: str = "embedding", cell_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """V9: the k nearest references among those in the cells a query visits, as
    ``(query_id, ref_id, distance, rank)``, ties by id.  A query that meets
    fewer than k references is searched exactly, so every query gets
    min(k, references) rows; null vectors are no neighbours and find none."""
    index = index or fit_cells(ref, k, id_col=id_col, vec_col=vec_col)
    q, r = _placed(query, ref, index, id_col, vec_col)
    # both sides feed the counts and the tiles: the placing runs once
    q, r = materialize(q, "cell-queries"), materialize(r, "cell-references")
    counts = r.groupBy("cell").agg(F.count("*").alias("n"))
    dealt = counts.select("cell", F.ceil(F.col("n") / cell_rows).cast("long").alias("parts"))
    busy = q.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("long").alias("lanes"))
    grid = dealt.join(busy, "cell")                      # a row a cell: cells that nobody visits go
    grid = materialize(grid, "cell-grid")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    qx = (q.join(F.broadcast(grid), "cell").withColumn("lane", F.pmod(F.xxhash64("qid"), "lanes"))
          .withColumn("part", upto("parts")).select("cell", "part", "lane", "qid", "v"))
    rx = (r.join(F.broadcast(grid), "cell").withColumn("part", F.pmod(F.xxhash64("rid"), "parts"))
          .withColumn("lane", upto("lanes")).select("cell", "part", "lane", "rid", "v"))
    kind = query.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("ref_id", kind),
                           T.StructField("distance", T.DoubleType())])
    keys = ["cell", "part", "lane"]
    cand = qx.groupBy(*keys).cogroup(rx.groupBy(*keys)).applyInPandas(
        _tile_topk(k, False, False, False, _cosine_tile), schema)
    w = Window.partitionBy("query_id").orderBy("distance", "ref_id")
    found = materialize(cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "cell-neighbours")
    full = found.where(F.col("rank") == k).select("query_id")
    short = (query.where(F.col(vec_col).isNotNull())
             .join(full.withColumnRenamed("query_id", "_full"), F.col(id_col) == F.col("_full"), "left_anti"))
    exact = cosine_knn(short, ref.where(F.col(vec_col).isNotNull()), k, id_col=id_col, vec_col=vec_col,
                       checkpoint=False)
    out = found.join(full, "query_id", "left_semi").unionByName(exact)
    return out.select("query_id", "ref_id", "distance", "rank")
