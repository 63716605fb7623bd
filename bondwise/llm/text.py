"""Shared pieces: word hashes over raw bytes, ASCII lower-casing, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what counts as a word after A-Z are lower-cased
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# the same for text that is not lower-cased yet
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACES = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 1 << 20
_ODD, _WORD_ODD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does that for pure ASCII and is far cheaper than ``translate``."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def ensure(docs: DataFrame, **kinds: str) -> DataFrame:
    """Cast the columns an operator reads; the others pass unchanged."""
    return docs.withColumns({name: F.col(f"`{name}`").cast(kind) for name, kind in kinds.items()})


def packed(docs: DataFrame, *read: str) -> DataFrame:
    """The columns an operator reads, and all others as one struct ``rest``, where no result column can clash with them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in read]
    return docs.select(*[F.col(f"`{c}`") for c in read], F.struct(*rest, *([] if rest else [F.lit(True).alias("none")])).alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame, read: tuple[str, ...], **new: Column) -> list[Column]:
    """The columns of ``docs`` from packed rows, in their order and types; ``new`` gives those that change."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    own = lambda c: new[c] if c in new else F.col(f"`{c}`") if c in read else F.col(f"rest.`{c}`")
    return [own(c).cast(kinds[c]).alias(c) if c in new or c in read else own(c).alias(c) for c in docs.columns]


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return low, word


LOW_BYTE, WORD_BYTE = _byte_tables()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse modulo 2^64 for i below n; kept, and grown when a longer run comes."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            run = np.full(size, b, np.uint64)
            run[0] = 1
            both.append(np.multiply.accumulate(run))
        _POWERS[base] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD_ODD, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return (total[width:] - total[: n - width + 1]) * down[: n - width + 1]


def spans_of_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in UTF-8 bytes. Bytes from 128 belong to words, so no decoding is needed."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = WORD_BYTE[raw]
    step = np.flatnonzero(inside[1:] != inside[:-1])
    return step[::2], step[1::2]


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every lower-cased word, block by block, so that memory stays near that of the text."""
    out, at = [], 0
    while at < len(raw):
        stop = min(at + BLOCK, len(raw))
        while stop < len(raw):  # move the cut to a byte outside words
            gap = np.flatnonzero(~WORD_BYTE[raw[at:stop]])
            if len(gap):
                stop = at + int(gap[-1]) + 1
                break
            stop = min(stop + BLOCK, len(raw))
        part = raw[at:stop]
        start, end = spans_of_words(part)
        if len(start):
            up, down = powers(_ODD, len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((LOW_BYTE[part] + np.uint64(1)) * up[: len(part)], out=total[1:])
            h = (total[end] - total[start]) * down[start]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            out.append(h)
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text; null gives none."""
    for value in column:
        data = value.as_buffer() if value.is_valid else None
        yield np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
