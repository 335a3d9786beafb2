"""Packing by vector bin packing: the dot-product heuristic places examples
under simultaneous limits on tokens, segments and loss-bearing tokens.

Every Spark task packs what it reads, so nothing is shuffled: full sequences
are cut off long examples at once, remainders wait in a pool of bounded size,
and a sequence takes, again and again, the waiting example with the largest
dot product between its size vector and the sequence's room (both relative to
the limits).  When nothing fits whole, the best example is cut to fill the
sequence.  What the last sequence of a task lacks is not padded: its tokens
are dealt out to sequences whose lengths are powers of two.

Defined results: a null or empty text is its end token alone; very long texts
are cut, never dropped; ties go to the example that waits longest; repeated
rows are packed each by itself; an empty table gives no pieces; other columns
are ignored.  Sequence ids hold the task's number in the upper bits, so a task
that runs again gives the same ids.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
END_ID = 1
LATIN_END = "\u0250"  # letters below are in composed form, with the same properties in all Unicode versions
PIECES = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "n_loss long")


class Packer:
    """Streams examples into sequences; ``emit`` gets each finished piece as
    ``(key, start, ids, total, n_loss, sequence, offset)``."""

    def __init__(self, emit: Callable, capacity: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
                 max_loss: int = MAX_TOKENS, pool: int = 512, first_sequence: int = 0):
        if min(capacity, max_segments, max_loss) < 1:
            raise ValueError("limits must be positive")
        self.emit, self.pool, self.sequence = emit, pool, first_sequence
        self.caps = np.array([capacity, max_segments, max_loss], dtype=float)
        self.waiting: list[tuple] = []  # (key, start, ids, loss sums, total)
        self.sizes = np.zeros((0, 2))

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> None:
        """``loss`` marks loss-bearing tokens; by default all are."""
        n = len(ids)
        sums = np.arange(n + 1) if loss is None else np.concatenate([[0], np.cumsum(loss.astype(np.int64))])
        at, cap = 0, int(self.caps[0])
        while n - at >= cap and sums[at + cap] - sums[at] <= self.caps[2]:
            self._close([(key, at, ids[at:at + cap], sums[at:at + cap + 1] - sums[at], n)])
            at += cap
        if at < n:
            self.waiting.append((key, at, ids[at:], sums[at:] - sums[at], n))
            if len(self.waiting) >= self.pool:
                self._pack(self.pool // 2)

    def finish(self) -> None:
        self._pack(0)

    def _pack(self, leave: int) -> None:
        size = np.array([(len(w[2]), w[3][-1]) for w in self.waiting], dtype=float).reshape(-1, 2)
        alive = np.ones(len(size), dtype=bool)
        while alive.sum() > leave:
            room, placed = self.caps.copy(), []
            while room.min() >= 1 and alive.any():
                fits = alive & (size[:, 0] <= room[0]) & (size[:, 1] <= room[2])
                # one segment each: its term is the same for all and decides nothing
                score = size[:, 0] * room[0] / self.caps[0] ** 2 + size[:, 1] * room[2] / self.caps[2] ** 2
                if fits.any():
                    k = int(np.argmax(np.where(fits, score, -1)))
                    item = self.waiting[k]
                    alive[k] = False
                else:
                    k = int(np.argmax(np.where(alive, score, -1)))
                    key, start, ids, sums, total = self.waiting[k]
                    cut = min(int(room[0]), len(ids), int(np.searchsorted(sums, room[2], "right")) - 1)
                    if cut <= 0:
                        break
                    item = (key, start, ids[:cut], sums[:cut + 1], total)
                    self.waiting[k] = (key, start + cut, ids[cut:], sums[cut:] - sums[cut], total)
                    size[k] = (len(ids) - cut, sums[-1] - sums[cut])
                placed.append(item)
                room -= (len(item[2]), 1, item[3][-1])
            self._close(placed)
        self.waiting = [w for w, a in zip(self.waiting, alive) if a]

    def _close(self, placed: list[tuple]) -> None:
        """Writes a full sequence, or several whose lengths are powers of two."""
        left = sum(len(p[2]) for p in placed)
        queue = list(placed)[::-1]
        while left:
            want = min(int(self.caps[0]), 1 << (left.bit_length() - 1)) if left < self.caps[0] else left
            offset = 0
            while offset < want:
                key, start, ids, sums, total = queue.pop()
                cut = min(want - offset, len(ids))
                self.emit(key, start, ids[:cut], total, int(sums[cut] - sums[0]), self.sequence, offset)
                if cut < len(ids):
                    queue.append((key, start + cut, ids[cut:], sums[cut:], total))
                offset += cut
            left -= want
            self.sequence += 1


class WordTokenizer:
    """Ids of whole texts from a tokenizer that drops white space.

    Each run of other characters is looked up in a memo; a run not met before
    is split as the tokenizer's own pattern splits it, and each part goes to
    the tokenizer's model alone, which spares building an encoding for every
    run.  Special tokens, characters beyond the Latin blocks (whose properties
    differ between Unicode versions) and tokenizers of another make take the
    tokenizer's full path.

    The memo is bounded: of two generations of ``memo`` runs the older is let
    go, and runs that are met again move to the newer.
    """

    def __init__(self, path: str, memo: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.memo, self.most = Tokenizer.from_file(path), _Memo(self._new, {}), memo
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        # the dotted capital i has a lower case of two characters
        self.special = ["\u0130", *[t["content"] for t in made.get("added_tokens") or []]]
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.parts = _parts(made)

    def ids(self, text: str | bytes) -> np.ndarray:
        runs = (text.encode("utf-8") if isinstance(text, str) else text).split()
        if len(self.memo) > self.most:
            self.memo = _Memo(self._new, dict(self.memo))
        return np.frombuffer(b"".join(map(self.memo.__getitem__, runs)), dtype="<u4")

    def _new(self, run: bytes) -> bytes:
        low = run.lower()
        if self.parts and low.isalpha():        # ASCII letters
            return self._part(low.decode("ascii")) if low == run else self.memo[low]
        text = run.decode("utf-8")
        if self.parts is None or max(text) >= LATIN_END or any(t in text for t in self.special):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = [p.encode("utf-8") for p in self.parts(text.lower())]
        if len(parts) == 1 and parts[0] == run:
            return self._part(text)
        if len(run) <= 64:                      # parts of common length are worth remembering
            return b"".join([self.memo[p] for p in parts])
        return b"".join([self._part(p.decode("utf-8")) for p in parts])

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = self.bytes_of(part)[0][0]
        return _packed([t.id for t in self.tokenizer.model.tokenize(part)])


class _Memo(dict):
    """Makes what is missing, looking first in the generation before."""

    def __init__(self, make: Callable, older: dict):
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, run: bytes) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            ids = self.make(run)
        self[run] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _parts(made: dict) -> Callable | None:
    """The splitting function of a tokenizer file that normalizes by NFC, white
    space and lower case, splits by one pattern and maps bytes; else None."""
    import regex

    norm = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
    pre = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if norm != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in pre] != ["Split", "ByteLevel"]:
        return None
    split, by_byte = pre
    if (split.get("behavior"), split.get("invert"), by_byte.get("use_regex"), by_byte.get("add_prefix_space")) != (
            "Removed", True, False, False) or made["model"].get("type") != "BPE":
        return None
    return regex.compile(split["pattern"]["Regex"]).findall


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, kept from task to task."""
    return WordTokenizer(path)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", capacity: int = MAX_TOKENS,
                   max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: one row for each, with its place in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out: list[tuple] = []

        def emit(key, start, ids, total, n_loss, sequence, offset):
            out.append((key, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()), total,
                        sequence, offset, n_loss))

        packer = Packer(emit, capacity, max_segments, max_loss,
                        first_sequence=TaskContext.get().partitionId() << 40)
        tokenizer, key_type = None, None
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            tokenizer, key_type = tokenizer or _tokenizer(tokenizer_path), batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(key, np.concatenate([tokenizer.ids(text.as_py() or b""), end]))
            if out:
                yield _batch(out, key_type)
                out.clear()
        packer.finish()
        if out:
            yield _batch(out, key_type)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col("text").cast("string").cast("binary").alias("_text")).mapInArrow(
        run, f"{id_col} {kind}, {PIECES}")


def pack_examples(examples: DataFrame, capacity: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
                  max_loss: int = MAX_TOKENS) -> DataFrame:
    """Instruction data: rows ``(id, ids array<int>, loss array<boolean>)``,
    the mask telling which tokens bear loss.  Null ids pack nothing; a null
    mask means that all tokens bear loss."""

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        out: list[tuple] = []

        def emit(key, start, ids, total, n_loss, sequence, offset):
            out.append((key, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()), total,
                        sequence, offset, n_loss))

        packer = Packer(emit, capacity, max_segments, max_loss,
                        first_sequence=TaskContext.get().partitionId() << 40)
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"]
        for frame in frames:
            for key, ids, loss in zip(frame["id"], frame["ids"], frame["loss"]):
                if ids is not None and len(ids):
                    packer.add(key, np.asarray(ids, dtype="<u4"), None if loss is None else np.asarray(loss, bool))
            yield pd.DataFrame(out, columns=names)
            out.clear()
        packer.finish()
        yield pd.DataFrame(out, columns=names)

    kind = examples.schema["id"].dataType.simpleString()
    return examples.select("id", "ids", "loss").mapInPandas(run, f"id {kind}, {PIECES}")


def _batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], type=key_type), *[pa.array(c, type=pa.int64()) for c in cols[1:]]], names=names)
