"""Batch embedding (V8)."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ship_parameters(spark: SparkSession, **arrays: np.ndarray) -> str:
    """Sends named arrays to all executors as one file, fetched once by each,
    and returns its name for ``parameters``."""
    name = f"parameters-{uuid.uuid4().hex}.npz"
    path = os.path.join(tempfile.mkdtemp(prefix="pertscope-parameters-"), name)     # the driver's own copy
    np.savez(path, **arrays)
    spark.sparkContext.addFile(path)
    return name


@functools.lru_cache(maxsize=2)
def parameters(name: str) -> dict[str, np.ndarray]:
    """The arrays shipped under ``name``, read once by each Python worker."""
    with np.load(SparkFiles.get(name)) as held:
        return {k: held[k] for k in held.files}


def batch_embed(df: DataFrame, vec_col: str, fn: Callable[..., np.ndarray], out_dim: int, id_col: str = "sig_id",
                batch_size: int = 64, shipped: str | None = None) -> DataFrame:
    """V8: apply ``fn`` (rows x d -> rows x out_dim) to every profile in batches
    of ``batch_size`` inside ``mapInPandas``.  A model's parameters do not travel
    in the closure: with ``shipped``, a name from ``ship_parameters``, they are
    the second argument of ``fn``."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (parameters(shipped),) if shipped else ()
        for pdf in it:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                x = np.stack(chunk[vec_col].to_numpy()).astype(np.float32)
                y = np.asarray(fn(x, *held), dtype=np.float32)
                yield pd.DataFrame({id_col: chunk[id_col].to_numpy(), "embedding": list(y)})

    return df.select(id_col, vec_col).mapInPandas(run, schema)


def linear_projection(x: np.ndarray, held: dict[str, np.ndarray]) -> np.ndarray:
    """A fixed linear map standing in for the (absent) network weights."""
    return x.astype(np.float64) @ held["weights"].astype(np.float64)
