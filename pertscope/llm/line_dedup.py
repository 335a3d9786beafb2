"""Line dedup with a suffix array over line sequences.

Positions are lines that hold a word.  Distributed prefix doubling sorts the
suffixes of all documents: rank 0 is the order of the lines themselves, and a
suffix's rank for 2^(k+1) lines is that of its pair (rank for 2^k lines here,
rank for 2^k lines 2^k lines on).  Suffixes whose prefix occurs once leave, as
nothing repeated can start there.  All suffixes with one rank form an interval
of the array whose longest common prefix is at least 2^k lines, and the
interval of any length m is the pair of ranks for 2^j <= m lines at both ends
of the run.

A run is deleted where it occurs later (by id, text hash, line) if it has at
least ``min_words`` words.  Every maximal repeated run is the union of its
shortest runs of ``min_words`` words that start or end at one of its lines, so
the array is sorted to that depth (at most ``min_words`` lines) and exactly
the maximal runs are found, however long.

A first copy always stays: each deleted line has an equal one before it.

Defined results: null and empty texts have no lines and stay as they are;
lines without a word are no positions and stay, unless every worded line of a
document goes, which leaves the empty text; rows that agree in id and text are
one document, with one result for each row; null ids come first; whole texts are
read; an empty table gives an empty table; other columns are ignored by
``repeated_runs`` and kept by ``dedup_lines``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

MIN_WORDS = 50


def runs_of(n_words: np.ndarray, min_words: int) -> list[list[int]]:
    """Per line, the lengths of the shortest runs of ``min_words`` words that
    start there: the one counted forward, and those counted back from an end."""
    n = len(n_words)
    upto = np.cumsum(n_words)
    before = upto - n_words
    out: list[list[int]] = [[] for _ in range(n)]
    stop = np.searchsorted(upto, before + min_words)
    start = np.searchsorted(before, upto - min_words, "right") - 1
    for s in range(n):
        if stop[s] < n:
            out[s].append(int(stop[s]) - s + 1)
    for e in range(n):
        if upto[e] >= min_words:
            m = e - int(start[e]) + 1
            if m not in out[start[e]]:
                out[start[e]].append(m)
    return out


def _worded(text: str) -> tuple[list[str], np.ndarray]:
    lines, counts = [], []
    for line in text.split("\n"):
        n = len(line.encode("utf-8").split())
        if n:
            lines.append(line)
            counts.append(n)
    return lines, np.array(counts, dtype=np.int64)


def _line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(2).to_pylist()
                rows, pos, one, two, runs = [], [], [], [], []
                for k, text in enumerate(texts):
                    lines, counts = _worded(text)
                    for p, (line, r) in enumerate(zip(lines, runs_of(counts, min_words))):
                        h = xxh3_128_intdigest(line)
                        rows.append(k)
                        pos.append(p)
                        one.append((h >> 64) - (1 << 63))
                        two.append((h & (2 ** 64 - 1)) - (1 << 63))
                        runs.append(r)
                take = pa.array(rows, type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(pos, type=pa.int32()),
                     pa.array(one, type=pa.int64()), pa.array(two, type=pa.int64()),
                     pa.array(runs, type=pa.list_(pa.int32()))], names=["doc", "th", "pos", "h1", "h2", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select(docs["doc_id"].alias("doc"), F.xxhash64(text_of(docs)).alias("th"), text_of(docs).alias("x"))
    rows = slim.mapInArrow(run, f"doc {kind}, th long, pos int, h1 long, h2 long, runs array<int>")
    # one row per position, also where a document's row is repeated
    return rows.withColumn("doc", F.struct(F.col("doc").alias("id"), "th")).drop("th")


def _ranked(keys: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Dense rank of distinct keys in their order, without a global window:
    range partitions, numbered inside, with the sizes of those before added."""
    numbered = materialize(
        keys.repartitionByRange(*cols).sortWithinPartitions(*cols)
        .withColumn("_m", F.monotonically_increasing_id()), name)
    sizes = numbered.groupBy(F.shiftright("_m", 33).alias("p")).count().collect()  # one row per partition
    offset = [0] * (max((r["p"] for r in sizes), default=0) + 1)
    for r in sizes:
        offset[r["p"]] = r["count"]
    offset = [0, *np.cumsum(offset).tolist()]
    first = F.get(F.array(*[F.lit(int(o)) .cast("long") for o in offset]), F.shiftright("_m", 33).cast("int"))
    return numbered.withColumn("r", first + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")


def suffix_ranks(lines: DataFrame, max_lines: int) -> list[DataFrame]:
    """Level k: ``(doc, pos, r)`` of the suffixes whose first 2^k lines occur
    more than once, ranked by those lines; up to 2^k <= ``max_lines``."""
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    level = materialize(lines.join(_ranked(often, ["h1", "h2"], "lines-rank"), ["h1", "h2"])
                        .select("doc", "pos", "r"), "lines-level")
    levels, width = [level], 1
    while 2 * width <= max_lines:
        ahead = level.select("doc", (F.col("pos") - width).alias("pos"), F.col("r").alias("r2"))
        pairs = level.join(ahead, ["doc", "pos"])
        often = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1").select(
            F.col("r").alias("a"), F.col("r2").alias("b"))
        ranks = _ranked(often, ["a", "b"], "lines-rank")
        level = materialize(pairs.join(ranks, (F.col("r2") == F.col("b")) & (pairs["r"] == F.col("a")))
                            .select("doc", "pos", ranks["r"]), "lines-level")
        levels.append(level)
        width *= 2
    return levels


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc struct<id, th>, pos, m)``: runs of m lines that are later copies."""
    lines = materialize(_line_rows(docs, min_words).dropDuplicates(["doc", "pos"]), "lines")
    longest = lines.agg(F.max(F.array_max("runs"))).first()[0] or 1         # ``min_words`` at most
    levels = suffix_ranks(lines, longest)
    ranks = levels[0].withColumn("j", F.lit(0))
    for j, level in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(level.withColumn("j", F.lit(j)))
    cand = lines.select("doc", "pos", F.explode("runs").alias("m"))
    cand = cand.withColumn("j", F.floor(F.log2(F.col("m") + 0.5)).cast("int"))
    # the run's two ends: ranks of 2^j lines at its start, and 2^j lines before its end
    cand = cand.join(ranks.withColumnRenamed("r", "ra"), ["doc", "pos", "j"])
    cand = cand.withColumn("at", F.col("pos") + F.col("m") - F.expr("shiftleft(1, j)"))
    cand = materialize(cand.join(ranks.select("doc", F.col("pos").alias("at"), "j", F.col("r").alias("rb")),
                                 ["doc", "at", "j"]).select("doc", "pos", "m", "ra", "rb"), "lines-runs")
    spot = F.struct("doc", "pos")
    first = cand.groupBy("m", "ra", "rb").agg(F.min(spot).alias("first"), F.count("*").alias("n")).where("n > 1")
    # written, so that a run of many copies is split where its copies are joined
    first = materialize(first.drop("n"), "lines-first")
    return cand.join(first, ["m", "ra", "rb"]).where(spot > F.col("first")).select("doc", "pos", "m")


def dedup_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: ``row`` (all its columns), the ``text`` without later
    copies of repeated runs, ``n_lines``, ``n_deleted`` and ``deleted``
    (``line:length`` of each deleted stretch, counting lines with a word from 0)."""
    runs = repeated_runs(docs, min_words).groupBy("doc").agg(F.collect_list(F.struct("pos", "m")).alias("runs"))
    runs = runs.select(F.col("doc.id").alias("rid"), F.col("doc.th").alias("rth"), "runs")

    @F.pandas_udf("text string, n_lines long, n_deleted long, deleted string")
    def cut(text, runs):
        import pandas as pd

        out = []
        for x, r in zip(text, runs):
            out.append((None, 0, 0, "") if x is None else delete_lines(x, r))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_deleted", "deleted"])

    # one struct holds the user's columns, so that no name meets these
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"),
                        F.xxhash64(text_of(docs)).alias("th"))
    both = keyed.join(runs, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    # only touched texts go to Python
    touched = F.col("runs").isNotNull()
    both = both.withColumn("cut", cut(F.when(touched, F.col("row.text")), F.col("runs")))
    worded = F.size(F.filter(F.split(F.coalesce("row.text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return both.select("row", F.when(touched, F.col("cut.text")).otherwise(F.col("row.text")).alias("text"),
                       worded.cast("long").alias("n_lines"),
                       F.when(touched, F.col("cut.n_deleted")).otherwise(F.lit(0)).alias("n_deleted"),
                       F.when(touched, F.col("cut.deleted")).otherwise(F.lit("")).alias("deleted"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated runs; the columns are
    those of ``docs``, with ``n_chars`` counted anew where lines went."""
    found = dedup_report(docs, min_words)
    out = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("n_deleted") > 0, F.char_length("text")).otherwise(
            F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[out.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def delete_lines(text: str, runs) -> tuple[str, int, int, str]:
    """The text without the runs ``(first line, length)``, and what went."""
    lines = text.split("\n")
    worded = [k for k, line in enumerate(lines) if line.encode("utf-8").split()]
    mark = np.zeros(len(worded) + 1, dtype=np.int64)
    for r in runs:
        mark[r["pos"]] += 1
        mark[r["pos"] + r["m"]] -= 1
    gone = np.cumsum(mark)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    deleted = ",".join(f"{a}:{b - a}" for a, b in zip(edges[::2], edges[1::2]))
    if gone.all():
        return "", len(worded), len(worded), deleted
    drop = {worded[k] for k in np.flatnonzero(gone)}
    return ("\n".join(line for k, line in enumerate(lines) if k not in drop), len(worded), int(gone.sum()), deleted)
