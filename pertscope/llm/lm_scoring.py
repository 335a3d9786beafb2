"""LM scoring with a weighted backoff automaton of order 3 learnt from the corpus.

States are the root, every word seen and every pair of words seen; a state has
an arc for each word seen after its context and a failure arc to the state of
the context without its first word (pair to word, word to root).  An arc leads
to the longest context seen that ends in its word.  Counts are smoothed with a
Dirichlet prior of weight ``mu`` on the next lower order, so for N tokens and V
types::

    root's arc:       p(w)    = (c(w) + 0.5) / (N + 0.5 (V + 1))
    arc of state h:   p(w|h)  = (c(h w) + mu p(w|h')) / (c(h) + mu)
    failure arc of h: mu / (c(h) + mu), then on from h'

where h' is h without its first word; a state's arcs and its failure arc's share
sum to one.  A traversal from left to right carries the state, follows failure
arcs down to a state that has an arc for the token (the root has one for every
token) and adds the logarithms.  A text starts in the state of the end token.

Neither vocabulary nor arcs are ever gathered in one place.  Each task cuts the
texts it reads into groups of about ``group_bytes`` and writes their token
numbers once; texts are not shuffled.  A group sends the sorted distinct hashes
of its n-grams (64 bits for words, 56 for longer ones: among 10^12 of them one
in 70,000 shares its hash with another) and its training counts to the owners of
key ranges; an owner adds up the counts of its range over all groups and answers each group
with counts in the group's own key order.  There are as many owners of an order
as hold ``owner_bytes`` of its keys each.  A group then has exactly the part of
the automaton that its texts walk.  A frequent word or pair is one number per
group, so no key is hot.

Defined results: a null or empty text is its end token alone; a null id counts
as the empty text in the hold-out rule; repeated rows count and are scored each;
with no training text N and V are 0, every base score is that of count 0 and no
state but the root exists; whole texts are read; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

MU = 20.0
ORDERS = (1, 2, 3)
PACKED = ("places", "ends", "hashes")
GROUP_BYTES = 6 << 20
OWNER_BYTES = 16 << 20
BLOCK = 1 << 16              # tokens that a traversal holds as Python numbers at a time
DROPPED = np.uint64(8)       # low bits of a pair's or triple's key that are not kept
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Tokens:
    """Tokens of a group of texts, each ended by the end token, as places in the
    sorted ``hashes`` that name them in all groups, and where each text ends."""

    def __init__(self, place: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        self.place, self.ends, self.hashes = place, ends, hashes

    @classmethod
    def of(cls, texts: list[str | None]) -> Tokens:
        from xxhash import xxh64_intdigest

        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        end = vocabulary[b" end"]      # a word holds no space
        parts = []
        for text in texts:
            ids = [vocabulary[w] for w in (text or "").encode("utf-8").lower().split()]
            ids.append(end)
            parts.append(np.array(ids, dtype=np.uint32))
        hashes = np.array([xxh64_intdigest(w) for w in vocabulary], dtype=np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(hashes), dtype=np.uint32)
        place[order] = np.arange(len(hashes))
        return cls(place[np.concatenate(parts)], np.cumsum([len(p) for p in parts], dtype=np.int64), hashes[order])

    def packed(self) -> list[bytes]:
        gaps = np.diff(self.hashes, prepend=np.uint64(0))
        return [_pack(self.place, 4), _pack(self.ends), _pack(gaps)]

    @classmethod
    def unpacked(cls, place: bytes, ends: bytes, gaps: bytes) -> Tokens:
        return cls(_unpack(place, 4), _unpack(ends).astype(np.int64), np.cumsum(_unpack(gaps), dtype=np.uint64))


class Grams:
    """N-grams of a group of texts: ``keys[n]`` sorted and distinct, ``at[n]``
    each position's place there, ``seat[n]`` a position where each stands.  A
    text's first word has the end token as context and no trigram (place -1)."""

    def __init__(self, tokens: Tokens):
        hashes, uni_at = tokens.hashes, tokens.place.astype(np.int64)
        self.ends = tokens.ends
        self.starts = np.concatenate([[0], self.ends[:-1]])
        first = np.zeros(len(uni_at), dtype=bool)
        first[self.starts] = True
        inner = np.flatnonzero(~first)
        self.end = int(uni_at[-1])
        own = hashes[uni_at]
        # before a text's first token stands the end of the one before: the state at a start
        self.context_at = np.concatenate([[self.end], uni_at[:-1]])
        context = hashes[self.context_at]
        pair = _scramble(context * _MIX[0] + (own ^ (own >> np.uint64(29))))
        triple = _scramble(pair[inner - 1] * _MIX[0] + (own[inner] ^ (own[inner] >> np.uint64(31))))
        bi, bi_at = np.unique(pair >> DROPPED, return_inverse=True)
        tri, inner_at = np.unique(triple >> DROPPED, return_inverse=True)
        tri_at = np.full(len(uni_at), -1, dtype=np.int64)
        tri_at[inner] = inner_at
        self.first, self.inner = first, inner
        self.keys = {1: hashes, 2: bi, 3: tri}
        self.at = {1: uni_at, 2: bi_at, 3: tri_at}
        self.seat = {n: np.empty(len(self.keys[n]), dtype=np.int64) for n in (2, 3)}
        self.seat[2][bi_at] = np.arange(len(uni_at))
        self.seat[3][inner_at] = inner

    def counts(self, order: int, training: np.ndarray) -> np.ndarray:
        """Occurrences of each key in the texts marked as training."""
        weight, at = np.repeat(training, self.ends - self.starts), self.at[order]
        if order == 3:
            weight, at = weight[self.inner], at[self.inner]
        return np.bincount(at, weights=weight, minlength=len(self.keys[order])).astype(np.uint64)


class Automaton:
    """The states and arcs that a group's texts can meet.

    State 0 is the root, 1 + k the group's word k, 1 + words + k its pair k.
    ``arc[n]`` is the log weight of the arc that reads n-gram k, NaN if there is
    none; ``fail`` and ``fall`` are a state's failure arc, weight and goal.
    """

    def __init__(self, grams: Grams, total: dict[int, np.ndarray], log_all: float, mu: float):
        self.grams, self.words = grams, len(grams.keys[1])
        word, pair, triple = (total[n].astype(float) for n in ORDERS)
        root = np.log10(word + 0.5) - log_all
        low = grams.seat[2]
        p2 = (pair + mu * 10 ** root[grams.at[1][low]]) / (word[grams.context_at[low]] + mu)
        top = grams.seat[3]
        p3 = (triple + mu * p2[grams.at[2][top]]) / (pair[grams.at[2][top - 1]] + mu)
        self.arc = {1: root, 2: np.where(pair > 0, np.log10(p2), np.nan),
                    3: np.where(triple > 0, np.log10(p3), np.nan)}
        # an unknown word's arc leads back to the root
        self.word_state = np.where(word > 0, 1 + np.arange(self.words), 0)
        self.fail = np.log10(mu) - np.log10(np.concatenate([[0.0], word, pair]) + mu)
        self.fall = np.concatenate([np.zeros(1 + self.words, dtype=np.int64), self.word_state[grams.at[1][low]]])

    def walk(self) -> np.ndarray:
        """The log10 probability of every token, each text walked from the end
        token's state."""
        at, words = self.grams.at, self.words
        root, word_arc, pair_arc = (self.arc[n].data for n in ORDERS)
        fail, fall, word_state = self.fail.data, self.fall.data, self.word_state.data
        start = int(self.word_state[self.grams.end])
        state, steps = start, np.empty(len(at[1]))
        for a in range(0, len(steps), BLOCK):
            block = []
            for first, w, p, t in zip(*(x[a:a + BLOCK].tolist() for x in (self.grams.first, at[1], at[2], at[3]))):
                if first:
                    state = start
                step = 0.0
                if state > words:
                    arc = pair_arc[t]
                    if arc == arc:
                        block.append(arc)
                        state = 1 + words + p
                        continue
                    step, state = fail[state], fall[state]
                if state:
                    arc = word_arc[p]
                    if arc == arc:
                        block.append(step + arc)
                        state = 1 + words + p
                        continue
                    step += fail[state]
                block.append(step + root[w])
                state = word_state[w]
            steps[a:a + BLOCK] = block
        return steps


def _pack(values: np.ndarray, width: int = 8) -> bytes:
    """Byte planes, compressed: high planes of small numbers are zeros."""
    from zstandard import ZstdCompressor

    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, width: int = 8) -> np.ndarray:
    from zstandard import ZstdDecompressor

    planes = np.frombuffer(ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel()


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _groups(rows: DataFrame, group_bytes: int) -> DataFrame:
    """One row per group of about ``group_bytes`` of text of one task: its ids
    and hold-out marks, its tokens, and how many words and tokens it has."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        texts, marks, size = [], [], 0

        def group():
            tokens = Tokens.of(texts)
            values = [_ipc(pa.Table.from_batches(marks)), *tokens.packed()]
            counts = [task << 32 | number, len(tokens.hashes), len(tokens.place)]
            return pa.RecordBatch.from_arrays(
                [*[pa.array([v], pa.binary()) for v in values], *[pa.array([c], pa.int64()) for c in counts]],
                names=["marks", *PACKED, "grp", "n_words", "n_tokens"])

        for batch in batches:
            column, from_row = batch.column("text"), 0
            plain = batch.select(["doc_id", "held_out"])
            for k in range(batch.num_rows):
                text = column[k].as_py()
                texts.append(text)
                size += len(text)
                if size >= group_bytes:
                    marks.append(plain.slice(from_row, k + 1 - from_row))
                    yield group()
                    texts, marks, size, number, from_row = [], [], 0, number + 1, k + 1
            if from_row < batch.num_rows:
                marks.append(plain.slice(from_row))
        if texts:
            yield group()

    return rows.mapInArrow(cut, "marks binary, " + ", ".join(f"{c} binary" for c in PACKED)
                                + ", grp long, n_words long, n_tokens long")


def _opened(row: dict) -> tuple[Grams, pa.Table]:
    return Grams(Tokens.unpacked(*(row[c] for c in PACKED))), pa.ipc.open_stream(row["marks"]).read_all()


def score(docs: DataFrame, held_out, mu: float = MU, group_bytes: int = GROUP_BYTES,
          owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """``held_out`` is a boolean column: true rows are scored, not learnt."""
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    groups = materialize(_groups(rows, group_bytes), "lm-groups")
    n_words, n_tokens = groups.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    owners = {n: max(1, -(-8 * ((n_words if n == 1 else n_tokens) or 0) // owner_bytes)) for n in ORDERS}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                grams, marked = _opened(row)
                training = ~marked.column("held_out").to_numpy().astype(bool)
                for order in ORDERS:
                    keys, counts, out = grams.keys[order], grams.counts(order, training), []
                    high = keys >> (np.uint64(32) if order == 1 else np.uint64(32) - DROPPED)
                    owner = (high * np.uint64(owners[order])) >> np.uint64(32)
                    bounds = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
                    for a, b in zip(bounds[:-1], bounds[1:]) if len(keys) else ():
                        gaps = np.concatenate([keys[a:a + 1], np.diff(keys[a:b])])
                        out.append((order, int(owner[a]), row["grp"], _pack(gaps), _pack(counts[a:b])))
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, type=t) for c, t in zip(zip(*out), (
                                pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                            names=["gram", "owner", "grp", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(k.as_py()), dtype=np.uint64) for k in table.column("keys")]
        counts = np.concatenate([_unpack(c.as_py()) for c in table.column("counts")])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), dtype=np.uint64)
        np.add.at(total, at, counts)
        replies = np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])
        n = len(keys)
        once = [int((total > 0).sum()), int(total.sum())]
        return pa.Table.from_arrays(
            [table.column("gram"), table.column("owner"), table.column("grp"),
             pa.array([_pack(r) for r in replies], type=pa.binary()),
             pa.array([once[0]] + [0] * (n - 1), type=pa.int64()),
             pa.array([once[1]] + [0] * (n - 1), type=pa.int64())],
            names=["gram", "owner", "grp", "totals", "types", "tokens"])

    groups = groups.select("grp", "marks", *PACKED)
    sent = groups.mapInArrow(
        send, "gram int, owner long, grp long, keys binary, counts binary")
    replies = materialize(sent.groupBy("gram", "owner").applyInArrow(
        answer, "gram int, owner long, grp long, totals binary, types long, tokens long"), "lm-replies")
    known = replies.where("gram = 1").agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = known[0] or 0, known[1] or 0
    log_all = float(np.log10(tokens + 0.5 * (types + 1)))

    def walk(table: pa.Table, replied: pa.Table) -> pa.Table:
        grams, marked = _opened(table.to_pylist()[0])
        total = {}
        for order in ORDERS:
            part = replied.filter(pa.compute.equal(replied.column("gram"), order)).sort_by("owner")
            total[order] = np.concatenate([np.zeros(0, np.uint64), *[_unpack(t.as_py()) for t in part.column("totals")]])
            if len(total[order]) != len(grams.keys[order]):
                raise RuntimeError("an owner's answer does not fit the group's keys")
        automaton = Automaton(grams, total, log_all, mu)
        sums = lambda x: np.add.reduceat(x, grams.starts)
        seen = (total[1] > 0).astype(np.int64)[grams.at[1]]
        n = grams.ends - grams.starts
        return pa.Table.from_arrays(
            [marked.column("doc_id"), marked.column("held_out"), pa.array(n), pa.array(sums(seen)),
             pa.array(np.full(len(n), tokens, dtype=np.int64)), pa.array(sums(automaton.arc[1][grams.at[1]])),
             pa.array(sums(automaton.walk()))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return groups.groupBy("grp").cogroup(
        replies.select("gram", "owner", "grp", "totals").groupBy("grp")).applyInArrow(
        walk, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")


def hold_out(docs: DataFrame, folds: int = 5, fold: int = 1):
    """The contract's rule: crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))) % folds == fold
