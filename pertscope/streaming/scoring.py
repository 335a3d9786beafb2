"""Scoring newly arriving query profiles against a static annotated reference
with Structured Streaming.  Each micro-batch runs the same kNN + propagation
plan as the batch job (``foreachBatch``) and writes the top label of each
profile to a folder of its own; the reference side is a static Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.knn import cosine_knn
from ..operators.propagation import propagate_labels


def score_batch(batch: DataFrame, reference: DataFrame, labels: DataFrame, k_raw: int = 50, **kw) -> DataFrame:
    """Propagate labels to the profiles of one micro-batch: ``batch(sig_id,
    pert_id, embedding)``; ``reference`` likewise; ``labels(group, label)``."""
    nb = cosine_knn(batch, reference, k_raw, group_col="pert_id")
    samples = batch.select(F.col("sig_id").alias("query_id"), F.col("pert_id").alias("query_group"))
    return propagate_labels(samples, nb, labels, k_raw=k_raw, **kw).sample_top


def start_scoring(stream: DataFrame, reference: DataFrame, labels: DataFrame, sink_path: str,
                  checkpoint_path: str, k_raw: int = 50, available_now: bool = False):
    """Start the query: every micro-batch is scored and written to
    ``sink_path/epoch=<id>`` (Parquet; read ``sink_path`` for all of them).
    Progress lives in ``checkpoint_path`` on shared storage.  A batch that was
    written but not committed runs again after a restart and overwrites its own
    folder, so no row appears twice."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        score_batch(batch, reference, labels, k_raw).write.mode("overwrite").parquet(
            f"{sink_path.rstrip('/')}/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_path)
    if available_now:
        w = w.trigger(availableNow=True)     # process what is there, then stop
    return w.start()
