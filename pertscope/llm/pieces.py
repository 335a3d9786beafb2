"""SentencePiece encoding and decoding by vectorised merge rounds.

Texts are cut into words where no piece of the model can reach across: before
a run of spaces, around line ends, and between any two characters that stand
side by side in no piece.  Words not met before lie in flat numpy arrays, one
entry a symbol.  Each round looks up the rank of every pair, takes the least of
each word (a segmented minimum), merges its leftmost non-overlapping places at
once, and compacts the arrays; words without a pair leave.

A merge could open a better pair only where a piece ranks before a part of it.
Such parts are marked when the model is read; where one is made, the pairs with
its neighbours are looked up, and a word merges its places up to the first that
opens such a pair, as the sequential rule does.

Defined results: a null or empty text has no piece, so only the end id; texts
are encoded whole; repeated rows give repeated results; an empty table gives an
empty table; other columns are kept by ``encode`` and ``decode``, whatever
their names; a null list of ids decodes to null; bytes that are no UTF-8 decode
to U+FFFD each.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SPACE = "▁"             # how the model writes a blank
LINE_ENDS = "\n\r\t\x0b\x0c"
CHARS = 1 << 21              # above every code point
SLICE_BYTES = 1 << 20
LONG = 64                    # characters; longer words are not remembered
NONE = np.iinfo(np.int32).max
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6      # kinds of pieces in a model file


class _Table:
    """A map from whole numbers to whole numbers for arrays of keys: open
    addressing with steps of one, a quarter full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int32)
        left, at, self.steps = np.arange(len(keys)), self._home(keys), 0
        while len(left):
            # of the keys that want a free place one gets it
            free = np.flatnonzero(self.keys[at] < 0)
            place, first = np.unique(at[free], return_index=True)
            self.keys[place], self.values[place] = keys[left[free[first]]], values[left[free[first]]]
            stay = self.keys[at] != keys[left]
            left, at = left[stay], (at[stay] + 1) & (len(self.keys) - 1)
            self.steps += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1).astype(np.int32)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left]]
            found = held == keys[left]
            out[left[found]] = self.values[at[left[found]]]
            left = left[~found & (held >= 0)]
        return out


class Pieces:
    """The tables of one model file: BPE with byte fallback, identity
    normalization, a blank put first, and no user-defined or unused piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if (train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix
                or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix
                or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces)):
            raise ValueError(f"not a model of the kind that is encoded here: {path}")
        self.end = train.eos_id
        self.texts = [p.piece for p in model.pieces]
        self.kinds = np.array([p.type for p in model.pieces])
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        scores = np.array([-p.score for p in model.pieces])
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        self._pairs()
        self._surfaces()

    def _symbol(self, text: str) -> int | None:
        """Pieces come after all characters, which stand for themselves."""
        return ord(text) if len(text) == 1 else CHARS + self.ids[text] if text in self.ids else None

    def _pairs(self) -> None:
        made, beside = {}, set()
        for text, k in self.ids.items():
            beside.update(ord(a) * CHARS + ord(b) for a, b in zip(text, text[1:]))
            for cut in range(1, len(text)):
                a, b = self._symbol(text[:cut]), self._symbol(text[cut:])
                if a is not None and b is not None:
                    made[a * 2 * CHARS + b] = k
        keys, made = (np.array(x, dtype=np.int64) for x in (list(made), list(made.values())))
        self.pairs = _Table(keys, made)
        beside = np.array(sorted(beside), dtype=np.int64)
        self.beside = _Table(beside, np.ones(len(beside), dtype=np.int64))
        # pieces that open a pair ranking no later than themselves
        self.early = np.zeros(len(self.rank), dtype=bool)
        for part in (keys // (2 * CHARS), keys % (2 * CHARS)):
            some = part >= CHARS
            piece = part[some] - CHARS
            self.early[piece[self.rank[made[some]] <= self.rank[piece]]] = True
        loners = [c for c in LINE_ENDS if not any(c in t for t in self.ids if len(t) > 1)]
        ends = re.escape("".join(loners))
        tail = f"|[{ends}]+" if loners else ""
        splits = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)
        self.words = re.compile(f"{SPACE}*[^{SPACE}{ends}]+|{SPACE}+{tail}" if splits else r"(?s:.+)").findall

    def _surfaces(self) -> None:
        """What each id decodes to, and whether it may lose a leading blank."""
        plain = []
        for text, kind in zip(self.texts, self.kinds):
            plain.append(b"" if kind == CONTROL else bytes([int(text[3:5], 16)]) if kind == BYTE
                         else " ⁇ ".encode() if kind == UNKNOWN else text.replace(SPACE, " ").encode())
        self.sizes = np.array([len(x) for x in plain])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(plain), dtype=np.uint8)
        self.blank = np.array([k == NORMAL and t.startswith(SPACE) for t, k in zip(self.texts, self.kinds)])

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs of symbols; the rank NONE where there is no piece."""
        made = self.pairs.get(left.astype(np.int64) * (2 * CHARS) + right)
        return np.where(made >= 0, self.rank[made], NONE), made

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in order, and the word of each."""
        sym = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<i4").astype(np.int32)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        inside = owner[1:] == owner[:-1]
        inside &= self.beside.get(sym[:-1].astype(np.int64) * CHARS + sym[1:]) > 0
        # a word from here on: a stretch whose neighbours occur together in some piece
        word = np.zeros(len(sym), dtype=np.int32)
        word[1:] = np.cumsum(~inside)
        place = np.arange(len(sym), dtype=np.int32)
        rank, made = np.full(len(sym), NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int32)
        done: list[tuple] = []

        def look(spots: np.ndarray) -> None:
            """Pairs of the entries at ``spots`` with the next of the same word."""
            spots = spots[(spots >= 0) & (spots < len(sym))]
            rank[spots] = NONE
            spots = spots[spots < len(sym) - 1]
            spots = spots[word[spots] == word[spots + 1]]
            rank[spots], made[spots] = self._lookup(sym[spots], sym[spots + 1])

        look(place)
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(sym)))
            keep = least < NONE
            done.append((place[~keep], sym[~keep]))
            hit = np.flatnonzero((rank == least) & keep)
            if not len(hit):
                break
            head = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])])
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
            hit = hit[since % 2 == 0]
            if (some := np.flatnonzero(self.early[made[hit]])).size:
                hit = hit[self._undisturbed(hit, some, sym, word, made, least)]
            sym[hit] = made[hit] + CHARS
            keep[hit + 1] = False
            moved = np.cumsum(keep)[hit] - 1
            sym, word, place, rank, made = (x[keep] for x in (sym, word, place, rank, made))
            look(np.concatenate([moved - 1, moved]))
        if not done:
            return sym, owner
        place, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return sym[order], owner[place[order]]

    def _undisturbed(self, hit: np.ndarray, some: np.ndarray, sym: np.ndarray, word: np.ndarray, made: np.ndarray,
                     least: np.ndarray) -> np.ndarray:
        """Which merges come before any that opens a pair ranking no later than
        the merge itself, in each word; ``some`` may do so."""
        at, last = hit[some], len(sym) - 1
        new = made[at] + CHARS
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, last)
        previous = hit[np.maximum(some - 1, 0)]
        left = np.where((some > 0) & (previous == at - 2), made[previous] + CHARS, sym[before])
        opens = (self._lookup(left, new)[0] <= least[at]) & (at > 0) & (word[before] == word[at])
        opens |= (self._lookup(new, sym[after])[0] <= least[at]) & (at + 2 <= last) & (word[after] == word[at])
        n = np.zeros(len(hit), dtype=np.int64)
        n[some[opens]] = 1
        earlier = np.cumsum(n) - n
        first = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
        return earlier == earlier[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers."""
        sym, word = self.merge(words)
        single = sym < CHARS
        chars, back = np.unique(sym[single], return_inverse=True)
        as_ids = [[self.ids[c]] if (c := chr(x)) in self.ids else [self.byte_ids[b] for b in c.encode("utf-8")]
                  for x in chars.tolist()]
        n = np.ones(len(sym), dtype=np.int64)
        n[single] = np.array([len(x) for x in as_ids], dtype=np.int64)[back]
        ids = np.empty(n.sum(), dtype="<i4")
        at = np.cumsum(n) - n
        ids[at[~single]] = sym[~single] - CHARS
        flat = np.array([i for x in as_ids for i in x], dtype=np.int32)
        starts = np.cumsum([0, *[len(x) for x in as_ids]])[:-1]
        for k in range(4):                               # a character has four bytes at most
            some = np.flatnonzero(single)[n[single] > k]
            ids[at[some] + k] = flat[starts[back[n[single] > k]] + k]
        ends = 4 * np.cumsum(np.bincount(word, weights=n, minlength=len(words)).astype(np.int64))
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of lists of ids, given flat with the offsets of the lists."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            raise ValueError("an id lies outside the vocabulary")
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.bytes[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        shown = np.flatnonzero(sizes > 0)                # the first id of a list that is no control
        lead = np.searchsorted(shown, offsets[:-1])
        # a control parts the bytes before it from those behind
        kind = self.kinds[ids]
        parted = np.flatnonzero((kind[:-1] == BYTE) & (kind[1:] == CONTROL)) + 1
        cuts = {}
        for at, which in zip(parted.tolist(), (np.searchsorted(offsets, parted, "right") - 1).tolist()):
            cuts.setdefault(which, []).append(int(ends[at]))
        out = []
        for n, (a, b, k) in enumerate(zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist(), lead.tolist())):
            a += bool(b > a and self.blank[ids[shown[k]]])
            marks = [a, *(x for x in cuts.get(n, ()) if a < x < b), b]
            out.append("".join([raw[x:y].decode("utf-8", "one_by_one") for x, y in zip(marks, marks[1:])]))
        return out


codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


class Encoder:
    """Encodes texts, remembering words; of more than ``memo`` words it starts
    the memory anew, so that it stays bounded."""

    def __init__(self, path: str, memo: int = 150_000):
        self.pieces, self.memo, self.known = Pieces(path), memo, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces.words((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > self.memo:
            self.known = {}
        new = [w for w in set().union(*split) if w not in self.known]
        if new:
            self.known.update(zip(new, self.pieces.encode_words(new)))
        out = [b"".join(map(self.known.__getitem__, own)) for own in split]
        for word in new:
            if len(word) > LONG:
                del self.known[word]
        return out


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about ``SLICE_BYTES`` each."""
    marks = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
    ends = [0, *marks.tolist(), len(sizes)] if len(sizes) else [0]
    return zip(ends, ends[1:])


def encode(docs: DataFrame, model_path: str, out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` as one struct ``row`` beside the ids of its text, end id last,
    and, where ``decoded_col`` names a column, what these ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = _encoder(model_path)
            end = int(encoder.pieces.end).to_bytes(4, "little")
            for at, to in _slices(batch.column(2).to_numpy()):
                found = [x + end for x in encoder.encode(batch.column(1).slice(at, to - at).to_pylist())]
                offsets = np.cumsum([0, *[len(x) // 4 for x in found]])
                values = np.frombuffer(b"".join(found), dtype="<i4")
                out = [batch.column(0).slice(at, to - at),
                       pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(values))]
                if decoded_col:
                    out.append(pa.array(encoder.pieces.decode_flat(values, offsets), type=pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["row", out_col, decoded_col][:len(out)])

    text = text_of(docs)
    slim = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("_text"),
                       F.octet_length(text).alias("_size"))
    kind = slim.schema["row"].dataType.simpleString()
    return slim.mapInArrow(run, f"row {kind}, {out_col} array<int>" + (f", {decoded_col} string" if decoded_col else ""))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of a column of ids added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids, counts = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
            texts = _encoder(model_path).pieces.decode_flat(ids, np.concatenate([[0], np.cumsum(counts)]))
            shown = pa.array(texts, type=pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), shown], names=["_row", out_col])

    packed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("_row"), rows[ids_col].alias("_ids"))
    kind = packed.schema["_row"].dataType.simpleString()
    out = packed.mapInArrow(run, f"_row {kind}, {out_col} string")
    return out.select("_row.*", out_col)
