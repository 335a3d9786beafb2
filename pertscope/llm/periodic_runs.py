"""Periodic runs of words, by longest common extensions (LCE) over a difference
cover.

The words of a slice of documents become one integer sequence, a value of its
own closing each document.  Only suffixes that start at cover positions (6 of
every 31) are sorted: blocks of 31 words first, then by doubling.  Any two
positions reach a pair of such suffixes within 31 words, so an LCE compares few
words and then takes the least neighbouring prefix of the sorted samples
between the two from a sparse table.

Runs come from harmonic grids: for every period p the words at multiples of p
are compared with those p on.  A run of four periods holds three equal grid
pairs in a row; the LCE there gives its end, a binary search over LCEs its
start.  A stretch found for several periods keeps the smallest.

Defined results: a null or empty text has no words and no run; documents are
independent, so repeated rows give repeated results; a document is worked on
whole, in one task; an empty table gives an empty table; a null id stays null;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Every difference modulo 31 is one of two of these.
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
MIN_LENGTH, MIN_PERIODS = 6, 4
SLICE_BYTES = 2 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _shifts() -> np.ndarray:
    """Least d with i + d and j + d both in the cover, for residues i, j."""
    inside = np.zeros(MODULUS, dtype=bool)
    inside[COVER] = True
    at = np.arange(MODULUS)
    out = np.full((MODULUS, MODULUS), -1)
    for d in range(MODULUS - 1, -1, -1):
        here = inside[(at + d) % MODULUS]
        out[here[:, None] & here[None, :]] = d
    return out


SHIFT = _shifts()
PLACE = np.searchsorted(COVER, np.arange(MODULUS))


class Extensions:
    """LCEs of a sequence of integers of at least 0, whose last value is unique."""

    def __init__(self, seq: np.ndarray):
        n, per = len(seq), len(COVER)
        # what lies behind the end is equal to nothing
        self.seq = np.concatenate([seq, -1 - np.arange(2 * MODULUS)]).astype(">i4")
        spots = (np.arange(0, n, MODULUS)[:, None] + COVER).ravel()
        spots = spots[spots < n]
        m = len(spots)
        blocks = np.lib.stride_tricks.sliding_window_view(self.seq, MODULUS)[spots]
        rank = np.unique(blocks.view(np.dtype((np.void, 4 * MODULUS))).ravel(), return_inverse=True)[1].ravel()
        ranks, ahead = [rank], per
        while m and rank.max() < m - 1:
            after = np.zeros(m, dtype=np.int64)
            after[:max(m - ahead, 0)] = rank[ahead:] + 1
            rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1]
            ranks.append(rank)
            ahead *= 2
        self.seq = self.seq.astype(np.int32)
        self.rank = rank
        order = np.empty(m, dtype=np.int64)
        order[rank] = np.arange(m)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for k in range(len(ranks) - 2, -1, -1):
            some = np.flatnonzero((a < m) & (b < m))
            some = some[ranks[k][a[some]] == ranks[k][b[some]]]
            common[some] += MODULUS << k
            a[some] += per << k
            b[some] += per << k
        common += self._compared(spots[order[:-1]] + common, spots[order[1:]] + common,
                                 np.full(len(common), MODULUS))
        self.least = [common]
        while 1 << len(self.least) <= len(common):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal values from i and j on, counted up to ``most``."""
        out = most.copy()
        going = np.flatnonzero(most > 0)
        t = 0
        while len(going):
            same = self.seq[i[going] + t] == self.seq[j[going] + t]
            out[going[~same]] = t
            t += 1
            going = going[same]
            going = going[most[going] > t]
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, i <> j."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        out = self._compared(i, j, shift)
        met = np.flatnonzero(out == shift)
        a, b = i[met] + shift[met], j[met] + shift[met]
        a = self.rank[a // MODULUS * len(COVER) + PLACE[a % MODULUS]]
        b = self.rank[b // MODULUS * len(COVER) + PLACE[b % MODULUS]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.least[k]
            out[met[at]] += np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def runs_of(seq: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, by start and then period.
    ``seq`` holds documents, longest first, each closed by a value of its own
    at the position before its end in ``ends``."""
    sizes = np.diff(ends, prepend=0) - 1
    points, periods = [], []
    for p in range(1, int(sizes[0]) // MIN_PERIODS + 1 if len(sizes) else 0):
        # documents too short for this period lie behind
        upto = np.searchsorted(-sizes, -max(MIN_LENGTH, MIN_PERIODS * p), "right")
        if not upto:
            break
        upto = ends[upto - 1]
        same = seq[:upto - p:p] == seq[p:upto:p]
        hit = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(hit):
            points.append(hit * p)
            periods.append(np.full(len(hit), p))
    if not points:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    g, p = np.concatenate(points), np.concatenate(periods)
    ext = Extensions(seq)
    on = ext.lce(g, g + p)
    # the first grid point of a run lies less than a period behind its start
    far = on > 2 * p
    g, p, on = g[far], p[far], on[far]
    first = np.ones(len(g), dtype=bool)
    behind = np.flatnonzero(g >= p)
    first[behind] = ext.lce(g[behind] - p[behind], g[behind]) < p[behind]
    g, p, on = g[first], p[first], on[first]
    back, most = np.zeros_like(g), np.minimum(p - 1, g)
    while (going := np.flatnonzero(back < most)).size:
        mid = (back[going] + most[going] + 1) // 2
        at = g[going] - mid
        reaches = ext.lce(at, at + p[going]) >= mid
        back[going[reaches]] = mid[reaches]
        most[going[~reaches]] = mid[~reaches] - 1
    start, length = g - back, back + on + p
    long = length >= np.maximum(MIN_LENGTH, MIN_PERIODS * p)
    start, length, p = start[long], length[long], p[long]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    smallest = np.ones(len(start), dtype=bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[smallest], length[smallest], p[smallest]
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


class _Names(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slice(texts: list[bytes]) -> tuple[list, list, list, list, list[bytes]]:
    """Per text: words; runs as counts and three flat lists; the collapsed text."""
    split = [t.split() for t in texts]
    names = _Names()
    by_size = sorted(range(len(split)), key=lambda k: -len(split[k]))
    ends = np.cumsum([len(split[k]) + 1 for k in by_size])
    seq = np.empty(ends[-1], dtype=np.int32)
    is_word = np.ones(len(seq), dtype=bool)
    is_word[ends - 1] = False
    seq[is_word] = np.fromiter(map(names.__getitem__, chain.from_iterable(split[k] for k in by_size)), dtype=np.int32)
    seq[ends - 1] = len(names) + np.arange(len(ends))
    start, length, period = runs_of(seq, ends)
    which = np.searchsorted(ends, start, "right")
    gone = np.zeros(len(seq) + 1, dtype=np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    gone = np.cumsum(gone) > 0
    cuts = np.searchsorted(which, np.arange(len(ends) + 1))
    place = {k: r for r, k in enumerate(by_size)}
    counts, picked, collapsed = [], [], []
    for k, own in enumerate(split):
        r = place[k]
        a, b = cuts[r], cuts[r + 1]
        base = ends[r] - len(own) - 1
        if b > a:
            picked.append((start[a:b] - base, length[a:b], period[a:b]))
            drop = gone[base:base + len(own)]
            own = [w for w, d in zip(own, drop) if not d]
        counts.append(b - a)
        collapsed.append(b" ".join(own))
    runs = [np.concatenate(x) if picked else np.zeros(0, dtype=np.int64) for x in (zip(*picked) if picked else [()] * 3)]
    return [len(w) for w in split], counts, runs, collapsed


def find_runs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_words, runs, collapsed)``: each document's runs by start and
    period, in word numbers from 0, and its words without those that a run
    holds behind its first period, joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            sizes = np.cumsum([0 if x is None else x for x in batch.column(2).to_pylist()]) // SLICE_BYTES
            marks = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for at, to in zip(marks, marks[1:]):
                part = batch.slice(at, to - at)
                n, counts, runs, collapsed = _slice([x or b"" for x in part.column(1).to_pylist()])
                rows = pa.StructArray.from_arrays([pa.array(x, type=pa.int64()) for x in runs], fields=list(kind))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), type=pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, type=pa.int64()), pa.ListArray.from_arrays(offsets, rows),
                     pa.array(collapsed, type=pa.binary()).cast(pa.string())],
                    names=[id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = text_of(docs)
    return docs.select(docs[id_col], text.cast("binary").alias("_text"), F.octet_length(text).alias("_size")).mapInArrow(
        run, f"{id_col} {kind}, n_words long, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, compared exactly; of equal
    ones the first; null without any."""
    return F.reduce(runs, F.lit(None).cast(RUN), lambda best, x: F.when(
        best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def listed(runs: Column) -> Column:
    """All runs as lines of start, length and period."""
    return F.array_join(F.transform(runs, lambda x: F.concat(F.concat_ws(
        ",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
