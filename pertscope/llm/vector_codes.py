"""Vector codes: product quantization whose assignments walk a lexicographic trie
over the distinct vector parts.

Components become integers, so that distances and means are exact.  The
distinct parts of each position, with their counts, are written once.  An
assignment sorts the parts it is given and goes down their trie depth first: a
node adds its dimension's squared differences to the distances that its parent
has gathered from all codebook entries, once for all parts below it.  Subtrees
of few leaves are finished a dimension at a time.  Leaves take the nearest
entry and add their counted parts to its sums, of which a task sends one row an
entry.

The codebooks hold 4 times 256 entries and go to every task.

Defined results: vectors that are null, hold a null or non-finite component
(a scaled one beyond 10^24 counts as such), or differ in length from the kept
vector with the smallest id are dropped; rows without an id are coded but seed
no codebook; fewer vectors than entries give as many entries; parts are cut at
quarters of the length, rounded down; repeated rows count as often as they
occur; an error beyond a long is null; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAVES = 1024                # parts below a node whose subtree is finished by dimensions
LIMIT = 1e24
ROWS = 4096                  # parts or vectors that a task works on at a time


def _exact(values: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, as 64-bit integers where squares of their
    differences can be added up, else as Python's."""
    most = float(np.abs(values).max(initial=0))
    if most * most * 4 * max(values.shape[-1], 1) < 2 ** 62:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], dtype=object).reshape(values.shape)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` for every row of ``parts``, ties
    to the lower one, and the squared distance."""
    m, width = parts.shape
    index, distance = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=parts.dtype)
    if parts.dtype == object or book.dtype == object:
        parts, book = parts.astype(object), book.astype(object)
        distance = distance.astype(object)
    order = np.lexsort(parts.T[::-1]) if width else np.arange(m)
    rows = parts[order]
    # the dimension in which a row leaves the one before; rows alike leave nowhere
    depth = np.zeros(m, dtype=np.int64)
    differs = rows[1:] != rows[:-1]
    depth[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width) if width else width
    leaf = np.flatnonzero(depth < width) if width else np.arange(min(m, 1))
    rows, depth, leaf_of = rows[leaf], depth[leaf], np.cumsum(np.isin(np.arange(m), leaf)) - 1
    found, least = np.zeros(len(leaf), dtype=np.int64), np.zeros(len(leaf), dtype=distance.dtype)
    stack = [(0, len(leaf), 0, np.zeros(len(book), dtype=distance.dtype))] if m else []
    while stack:
        low, high, d, gathered = stack.pop()
        if high - low > LEAVES and d < width:
            starts = low + np.concatenate([[0], np.flatnonzero(depth[low + 1:high] <= d) + 1])
            for a, b in zip(starts[::-1].tolist(), [high, *starts[:0:-1].tolist()]):
                step = rows[a, d] - book[:, d]
                stack.append((a, b, d + 1, gathered + step * step))
            continue
        below, node = gathered[None, :], np.zeros(high - low, dtype=np.int64)
        for k in range(d, width):
            opens = np.concatenate([[True], depth[low + 1:high] <= k])
            first = np.flatnonzero(opens)
            step = rows[low + first, k][:, None] - book[None, :, k]
            below = below[node[first]] + step * step
            node = np.cumsum(opens) - 1
        at = below.argmin(axis=1)
        found[low:high] = at[node]
        least[low:high] = below[np.arange(len(at)), at][node]
    index[order], distance[order] = found[leaf_of], least[leaf_of]
    return index, distance


def _rows_of(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                  label_col: str | None = "label") -> DataFrame:
    """``(id, label, v)`` of the kept rows, ``v`` in whole numbers."""
    raw = F.transform(vectors[vec_col], lambda x: x.cast("double") * SCALE)
    # beyond 2^53 every double is whole, and a long may not hold it
    whole = F.transform(raw, lambda y: F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(y))
    label = vectors[label_col] if label_col else F.lit(None).cast("int")
    df = vectors.select(vectors[id_col].alias("id"), label.alias("label"), whole.alias("v"))
    return df.where(F.col("v").isNotNull() & F.forall(
        "v", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) <= LIMIT)))


def _round(parts: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose entries are the floored means of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, dtype=object) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                position, n = part.column(0).to_numpy(), part.column(2).to_numpy()
                for k in np.unique(position):
                    some = np.flatnonzero(position == k)
                    x = _exact(_rows_of(part.column(1).take(pa.array(some))))
                    index, _ = nearest(x, books[k])
                    order = np.argsort(index, kind="stable")
                    entry, first = np.unique(index[order], return_index=True)
                    counts[k][entry] += np.add.reduceat(n[some][order], first)
                    weight = n[some][:, None]
                    if x.dtype == object or int(np.abs(x).max(initial=0)) * int(weight.sum()) >= 2 ** 62:
                        x, weight = x.astype(object), weight.astype(object)
                    weighed = x * weight
                    if x.shape[1]:
                        sums[k][entry] += np.add.reduceat(weighed[order], first, axis=0)
        rows = [(k, e, int(counts[k][e]), [str(s) for s in sums[k][e]])
                for k in range(len(books)) for e in np.flatnonzero(counts[k]).tolist()]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], type=pa.int32()), pa.array(cols[1], type=pa.int32()), pa.array(cols[2], type=pa.int64()),
             pa.array(cols[3], type=pa.list_(pa.string()))], names=["position", "entry", "n", "sums"])

    found = parts.mapInArrow(run, "position int, entry int, n long, sums array<string>")
    widths = [b.shape[1] for b in books]
    added = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(max(widths, default=0))]
    out = [b.copy() for b in books]
    for r in found.groupBy("position", "entry").agg(F.sum("n").alias("n"), *added).collect():   # a row an entry
        k = r["position"]
        mean = np.array([int(r[f"s{i}"]) // r["n"] for i in range(widths[k])], dtype=object)
        out[k] = out[k].astype(object)
        out[k][r["entry"]] = mean
    return [_exact(b.astype(float)) if b.size and np.abs(b).max() < 2 ** 50 else b for b in out]


def fit(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks, one array (entry, dimension) for each part position."""
    first = [r["v"] for r in whole.where("id IS NOT NULL").orderBy("id", "v").limit(entries).select("v").collect()]
    width = len(first[0]) if first else 0
    first = [v for v in first if len(v) == width]
    cut = [k * width // parts for k in range(parts + 1)]
    books = [_exact(np.array([v[a:b] for v in first], dtype=float).reshape(len(first), b - a))
             for a, b in zip(cut, cut[1:])]
    if not first:
        return books
    pieces = F.array(*[F.struct(F.lit(k).alias("position"), F.slice("v", a + 1, b - a).alias("part"))
                       for k, (a, b) in enumerate(zip(cut, cut[1:]))])
    distinct = (whole.where(F.size("v") == width).select(F.explode(pieces).alias("p"))
                .groupBy("p.position", "p.part").agg(F.count("*").alias("n"))
                .sortWithinPartitions("position", "part"))
    distinct = materialize(distinct, "vector-parts")
    for _ in range(rounds):
        books = _round(distinct, books)
    return books


def encode(whole: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``(id, label, code, error)``: two hex digits for each part, and the
    squared distance to the entries."""
    width = sum(b.shape[1] for b in books)
    cut = np.concatenate([[0], np.cumsum([b.shape[1] for b in books])]).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                v = _rows_of(part.column(2))
                codes, error = [], np.zeros(len(v), dtype=object)
                for book, a, b in zip(books, cut, cut[1:]):
                    index, distance = nearest(_exact(v[:, a:b]), book)
                    codes.append(index.astype(np.uint8))
                    error += distance.astype(object)
                text, step = np.stack(codes, axis=1).tobytes().hex(), 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([text[i:i + step] for i in range(0, len(text), step)], type=pa.string()),
                     pa.array([e if e < 2 ** 63 else None for e in error], type=pa.int64())],
                    names=["id", "label", "code", "error"])

    of = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
    schema = f"id {of['id']}, label {of['label']}, code string, error long"
    if not books or not len(books[0]):
        return whole.sparkSession.createDataFrame([], schema)
    return whole.where(F.size("v") == width).mapInArrow(run, schema)


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and dimension, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
             label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """``(id, label, code, error, label_error)`` of every kept vector, the last
    being the error of all vectors with its label; and the codebooks."""
    whole = whole_vectors(vectors, id_col, vec_col, label_col)
    books = fit(whole)
    codes = materialize(encode(whole, books), "vector-codes")
    # written, so that a label of many rows is split where it is joined
    sums = materialize(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")),
                       "vector-label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books
