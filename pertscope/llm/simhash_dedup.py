"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits link at ``max_bits`` (3) or fewer differing bits.  The
anchors are the codewords of a covering code over 46 of the bits: two blocks of
23 bits, each the perfect binary Golay code (covering radius 3), so any value
has exactly one anchor within the radius in each block.  Two fingerprints at 3
bits or fewer have a value between them, at most 1 bit from one and 2 from the
other; the anchor of that value lies within radius + 2 of both.  So it is enough
to replicate every distinct fingerprint to each anchor whose distances exceed
the radius by at most 2 over both blocks, about 60 of 2^24 anchors, and to
compare per anchor.  (Radius + 3 on one side and radius on the other also
covers, with five times the copies.)

Equal fingerprints are one node; inside an anchor's bucket a breadth-first
search leaves a spanning tree of links, not all pairs; the trees of all anchors
together connect what pairwise comparison connects.

Defined results: null, empty and word-free texts have fingerprint zero, which
links like any other; texts under the shingle length are one shingle; whole
texts are read; repeated rows share a fingerprint; null ids never become a
component's id unless it has no other; an empty table gives an empty table;
other columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, text_of

SEED = 42
BLOCK = 23                     # bits of a Golay block
GENERATOR = 0b101011100011     # fixed value: generator polynomial of the Golay code, degree 11
RADIUS = 3


def simhash(text: str, shingle: int) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    return int(_simhashes([text], shingle)[0])


def _simhashes(texts: list[str], shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        words = text.encode("utf-8").lower().split()
        if not words:
            continue
        if len(words) <= shingle:
            hashes.append(xxh64_intdigest(b" ".join(words), SEED))
            counts[k] = 1
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[:len(words) - shingle + 1].tolist()
        stops = (ends[shingle - 1:] - 1).tolist()
        hashes += [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)]
        counts[k] = len(starts)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    all_hashes = np.array(hashes, dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum(counts[full])])
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, a, b in zip(full, offsets[:-1], offsets[1:]):
        ones = np.zeros(64, dtype=np.int64)
        for c in range(a, b, 65536):     # bounded memory for very long texts
            part = np.ascontiguousarray(all_hashes[c:min(b, c + 65536)]).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = bit[2 * ones > b - a].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id") -> DataFrame:
    """``(id, fp)``: the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = _simhashes([t or "" for t in part.column(1).to_pylist()], shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_of(docs).alias("_text")).mapInArrow(run, f"{id_col} {kind}, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit values by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def error_patterns(excess: int) -> list[list[np.ndarray]]:
    """``[e][syndrome]``: bit patterns of weight radius + e (radius or less for
    e = 0) with that syndrome; a value XOR each is a codeword at that distance."""
    patterns = np.zeros(1, dtype=np.int64)
    weight_of = [patterns]
    for _ in range(RADIUS + excess):
        wider = (patterns[:, None] | (1 << np.arange(BLOCK))[None, :]).ravel()
        patterns = np.unique(wider[wider != np.repeat(patterns, BLOCK)])
        weight_of.append(patterns)
    table = []
    for e in range(excess + 1):
        some = np.concatenate(weight_of[:RADIUS + 1]) if e == 0 else weight_of[RADIUS + e]
        syn = _syndromes(some)
        order = np.argsort(syn, kind="stable")
        bounds = np.searchsorted(syn[order], np.arange(2 ** 11 + 1))
        table.append([some[order[a:b]] for a, b in zip(bounds[:-1], bounds[1:])])
    return table


def anchors_of(fp: int, table: list[list[np.ndarray]]) -> np.ndarray:
    """Anchors (both blocks' 12 message bits) whose distances exceed the
    radius by at most ``len(table) - 1`` in sum."""
    mask = (1 << BLOCK) - 1
    near = []
    for block in (fp & mask, (fp >> BLOCK) & mask):
        syn = int(_syndromes(np.array([block]))[0])
        near.append([(block ^ per[syn]) >> 11 for per in table])
    out = [(near[0][a][:, None] << 12 | near[1][b][None, :]).ravel()
           for a in range(len(table)) for b in range(len(table) - a)]
    return np.concatenate(out)


def links(distinct_fp: DataFrame, max_bits: int) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints ``fp``."""
    excess = (max_bits + 1) // 2

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = error_patterns(excess)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 2000):
                part = values[at:at + 2000]
                found = [anchors_of(int(v) & (2 ** 64 - 1), table) for v in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).astype(np.int32)),
                     pa.array(np.repeat(part, [len(f) for f in found]))], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_f = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate([held_a, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(a, a[-1])) if len(a) else 0  # the last bucket may go on
            held_a, held_f = a[cut:], f[cut:]
            yield from _linked(a[:cut], f[:cut], max_bits)
        yield from _linked(held_a, held_f, max_bits)

    # A value makes about 60 rows: small partitions of values are dealt out first, by an
    # expression of their own, as an exchange by fp would merge into the one of the distinct.
    parts = int(distinct_fp.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (distinct_fp.select("fp").repartition(parts, F.xxhash64("fp"))
            .mapInArrow(replicate, "anchor int, fp long"))
    return (rows.repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(compare, "a long, b long").distinct())


def _linked(anchor: np.ndarray, fp: np.ndarray, max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within buckets of rows sorted by anchor: small buckets row against
    later row, large ones by breadth-first search."""
    if not len(anchor):
        return
    bounds = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
    sizes = np.diff(bounds)
    small = np.repeat(sizes <= 64, sizes)
    value = fp.view(np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    here = np.flatnonzero(small)
    end = np.repeat(bounds[1:], sizes)
    for lag in range(1, 64):
        here = here[here + lag < end[here]]
        if not len(here):
            break
        hit = here[np.bitwise_count(value[here] ^ value[here + lag]) <= max_bits]
        if len(hit):
            found.append((fp[hit], fp[hit + lag]))
    for k in np.flatnonzero(sizes > 64):
        found += _search(fp[bounds[k]:bounds[k + 1]], max_bits)
    if found:
        a, b = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _search(fp: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first search among one bucket's values: whoever is reached
    leaves the rest, so a dense group costs few comparisons."""
    found, rest = [], fp
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            v = queue.pop()
            near = np.bitwise_count(rest.view(np.uint64) ^ np.int64(v).view(np.uint64)) <= max_bits
            if near.any():
                got, rest = rest[near], rest[~near]
                found.append((np.full(len(got), v), got))
                queue += list(got)
    return found


def clusters(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``(id, fp, component_id)``: the smallest id that links reach."""
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0 to 4")  # bits beyond would need wider error patterns
    fps = materialize(fingerprints(docs, shingle, id_col), "simhash-fp")
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("_low"))
    near = components(links(fps.select("fp").distinct(), max_bits), "simhash")
    classes = (nodes.join(near, nodes["fp"] == near["node"], "left")
               .select(nodes["fp"].alias("_fp"), "_low", F.coalesce("component", nodes["fp"]).alias("_c")))
    lowest = classes.groupBy(F.col("_c").alias("_lc")).agg(F.min("_low").alias("component_id"))
    per_fp = classes.join(lowest, F.col("_c") == F.col("_lc")).select("_fp", "component_id")
    return fps.join(per_fp, F.col("fp") == F.col("_fp")).select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The documents with one left of each component: the one with its id.
    Rows that repeat that id leave one too; rows without an id leave the
    smallest text hash of a component that has no id."""
    key = F.struct(docs["doc_id"].alias("i"), F.xxhash64(text_of(docs)).alias("h"))
    found = clusters(docs.select(key.alias("key"), docs["text"]), shingle, max_bits, "key")
    keep = found.groupBy("component_id").agg(
        F.min(F.struct(F.col("key.i").isNull(), F.col("key.i").alias("i"), F.col("key.h").alias("h")))
        .alias("k")).select(F.struct(F.col("k.i"), F.col("k.h")).alias("kept"))
    # one struct holds the user's columns, so that no name meets these
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    chosen = rows.join(keep, F.col("key.i").eqNullSafe(F.col("kept.i")) & (F.col("key.h") == F.col("kept.h")), "left_semi")
    return chosen.dropDuplicates(["key"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
