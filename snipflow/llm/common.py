"""Helpers shared by the text operators: Arrow text buffers, words, hashes.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` everywhere, in Spark expressions and
in the byte arrays that Python tasks see. Byte work is done in slices of a few
megabytes, so a task's memory does not depend on the size of its partition (a
single longer document forms a slice of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SPACE_CLASS = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1          # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)


def words_column(text: Column) -> Column:
    """Array of the words of a text; empty for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def text_frame(df: DataFrame, id_col: str, text_col: str, *extra: str) -> DataFrame:
    """The columns an operator needs, under fixed names, null texts as empty.

    Other columns, whatever their names, do not travel with the texts."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (one more than rows) of an Arrow text column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """Ranges (i, j) of rows that hold at most ``most`` bytes, or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.uint64(base & (2**64 - 1))
        np.multiply.accumulate(out, out=out)
    return out


class Words:
    """Word hashes of the documents of one slice.

    ``hash``: 64-bit hash of each word; ``doc``: row of the slice it lies in;
    ``first``: index of the first word of each row (one more than rows);
    ``start``, ``end``: byte range in the slice.
    """

    _pow: np.ndarray = powers(_P, 1 << 16)
    _inv: np.ndarray = powers(_P_INV, 1 << 16)

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, also: bytes = b""):
        """``lower``: ASCII letters in lower case; ``also``: bytes that separate
        words besides white space."""
        base, n = int(off[0]), int(off[-1] - off[0])
        b = data[base:base + n]
        rel = off - base
        if n == 0:                          # nothing but empty texts
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, np.uint64), np.zeros(len(rel), np.int64)
            return
        if lower:
            b = _LOWER[b]
        between = _SPACE
        if also:
            between = _SPACE.copy()
            between[list(also)] = True
        word = ~between[b]
        edge = np.empty(n + 1, bool)        # a word starts or ends before byte i
        edge[:1] = word[:1]
        edge[-1:] = word[-1:]
        edge[1:-1] = word[1:] != word[:-1]
        inner = np.unique(rel[1:-1])
        inner = inner[(inner > 0) & (inner < n)]
        split = inner[word[inner - 1] & word[inner]]   # words that meet at a document edge
        starts = np.flatnonzero(edge)
        if len(split):
            starts = np.sort(np.concatenate([starts, split, split]), kind="stable")
        self.start, self.end = starts[0::2], starts[1::2]
        need = n + 1
        if len(Words._pow) < need:
            size = 1 << need.bit_length()
            Words._pow, Words._inv = powers(_P, size), powers(_P_INV, size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * Words._pow[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * Words._inv[self.start]
                        + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, rel)
        self.doc = np.repeat(np.arange(len(rel) - 1), np.diff(self.first))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of every ``n`` consecutive items."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * np.uint64(0x9FB21C651E98DF25)
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + h[i:i + m]
    return mix(out)
