"""Sum-of-squares online packing of tokenised documents into training windows.

A document is its token ids and an end id. It is cut into whole windows and a rest; the rest goes to the fill level h for
which the sum of squares of N(h), the number of windows open at each level, grows least. N is kept in a level array, so a
placement costs one pass over that array, however many windows are open. Ties go to the fullest window.

Each task packs the rows of its own input split; nothing is shuffled and a repeated task gives the same rows. At its end,
and whenever ``max_open`` windows are open, a task fills its fullest open windows with pieces cut from its emptiest ones; what
is left of a task at last, less than one window, is cut into sequences whose sizes are powers of two. No sequence needs padding.

Nulls and edges: a null or empty text is the end id alone; a null or repeated doc_id stays as it is, each row being a document
of its own; a text of any length is tokenised whole; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
MAX_OPEN = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Vocabulary:
    """One byte-level vocabulary in the two forms that public libraries read: merges as JSON, and ranks with the splitting pattern."""

    merges: str
    ranks: str
    pattern: str

    @classmethod
    def of_files(cls, merges_path: str, ranks_path: str, pattern: str) -> Vocabulary:
        with open(merges_path, encoding="utf-8") as m, open(ranks_path, encoding="ascii") as r:
            return cls(m.read(), r.read(), pattern)


class Encoder:
    """Token ids of whole texts. The rank form is three times as fast; a text it cannot take goes to the merge form, whose ids are the same."""

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.merges = Tokenizer.from_str(vocabulary.merges)
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, vocabulary.ranks.splitlines())}
        special = {t.content: k for k, t in self.merges.get_added_tokens_decoder().items()}
        self.ranks = tiktoken.Encoding("shared", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        try:
            return self.ranks.encode_to_numpy(text, allowed_special="all")
        except BaseException as error:  # the rank library ends in a panic, no ordinary exception, on some very long runs
            if isinstance(error, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
            return np.array(self.merges.encode(text, add_special_tokens=False).ids, "<u4")


class Levels:
    """Open windows by fill level. A piece is (document, start, ids); a window a list of pieces."""

    def __init__(self, window: int, max_open: int):
        self.window, self.max_open, self.n_open = window, max_open, 0
        self.open: dict[int, list[list]] = {}
        self.rise = np.ones(window + 1, np.int64)  # what one window more at a level adds to the sum of squares
        self.rise[window] = 0
        self.fall = np.full(window + 1, -(1 << 60), np.int64)  # what one window less takes off; impossible where none is
        self.fall[0] = 0

    def _count(self, level: int) -> None:
        n = len(self.open.get(level, ()))
        self.rise[level], self.fall[level] = 2 * n + 1, 2 * n - 1 if n else -(1 << 60)

    def _push(self, level: int, pieces: list) -> None:
        self.open.setdefault(level, []).append(pieces)
        self.n_open += 1
        self._count(level)

    def _pop(self, level: int) -> list:
        pieces = self.open[level].pop()
        self.n_open -= 1
        self._count(level)
        return pieces

    def place(self, piece: tuple) -> Iterator[list]:
        """Place a piece shorter than a window; yields the windows that are full now."""
        size = len(piece[2])
        cost = self.rise[size:] - self.fall[: self.window - size + 1]
        level = self.window - size - int(np.argmin(cost[::-1]))
        pieces = self._pop(level) if level else []
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
        else:
            self._push(level + size, pieces)
            if self.n_open > self.max_open:
                yield from self.settle()

    def settle(self) -> Iterator[list]:
        """Fill the fullest windows from the emptiest, cutting pieces; at most one window stays open."""
        queue = [(level, w) for level in sorted(self.open) for w in self.open[level]]
        for level in list(self.open):
            self.open[level] = []
            self._count(level)
        self.n_open = 0
        low, high, source = 0, len(queue) - 1, []
        while low <= high:
            level, target = queue[high]
            high -= 1
            gap = self.window - level
            while gap and (source or low <= high):
                if not source:
                    source = queue[low][1]
                    low += 1
                doc, start, ids = source.pop()
                cut = max(0, len(ids) - gap)
                target.append((doc, start + cut, ids[cut:]))
                gap -= len(ids) - cut
                if cut:
                    source.append((doc, start, ids[:cut]))
            if gap:
                self._push(self.window - gap, target)
            else:
                yield target
        if source:
            self._push(sum(len(p[2]) for p in source), source)

    def last(self) -> Iterator[list]:
        """Everything still open, the rest cut into sequences of powers of two."""
        yield from self.settle()
        for level in list(self.open):
            for rest in self.open[level]:
                left = level
                while left:
                    size = 1 << (left.bit_length() - 1)
                    left -= size
                    taken = []
                    while size:
                        doc, start, ids = rest.pop(0)
                        if len(ids) > size:
                            rest.insert(0, (doc, start + size, ids[size:]))
                            ids = ids[:size]
                        taken.append((doc, start, ids))
                        size -= len(ids)
                    yield taken
        self.open = {}


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One per Python worker."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def pack(docs: DataFrame, vocabulary: Vocabulary, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): where each stands in its document and in its sequence; with ``ids`` the ids themselves."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of fixed size, sent along instead of looked for on executors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        levels = Levels(window, max_open)
        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        number = 0

        def write(pieces: list) -> None:
            nonlocal number
            at = 0
            for (doc, total), start, ids in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first + number, at, *([ids] if with_ids else [])))
                at += len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                whole = len(ids) // window * window
                mark = (doc, len(ids))
                for start in range(0, whole, window):
                    write([(mark, start, ids[start : start + window])])
                if whole < len(ids):
                    for full in levels.place((mark, whole, ids[whole:])):
                        write(full)
                if len(rows) > 5000:
                    yield flush()
        for rest in levels.last():
            write(rest)
        yield flush()

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)
