"""Vectorised work on the bytes of Arrow string columns.

Python workers receive whole record batches.  The functions here read the
UTF-8 buffer of a string column in place, cut it into chunks of bounded size
(a longer text is a chunk of its own) and find words, word hashes and lines
with NumPy, so that no Python object is made for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def string_array(column) -> pa.Array:
    """A column of a record batch as one ``large_string`` array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of runs of rows of at most *limit* bytes, or of one row."""
    column = string_array(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def _lut(pairs: dict[int, int]) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for a, b in pairs.items():
        table[a] = b
    return table


#: A-Z to a-z; every other byte stays, so that UTF-8 sequences are untouched.
LOWER = _lut({c: c + 32 for c in range(65, 91)})
#: Space and the controls 0x09-0x0D.
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: ASCII letters and digits, and all bytes of longer UTF-8 sequences.
IS_WORDISH = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


@lru_cache(maxsize=1)
def _mixers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first *n* powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, base & _MASK, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        if size > 4 * CHUNK_BYTES:  # a very long text: not kept
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes that do not cross rows: starts, ends (exclusive), runs per row."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


class SpanHasher:
    """Hashes of spans of one array of bytes, from running sums over it.

    A longer array is hashed in pieces of at most a megabyte, so that its running sums, powers and mixers are never
    there as a whole: a span's hash does not depend on where it stands.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.total = self._sums(data) if len(data) <= CHUNK_BYTES else None

    @staticmethod
    def _sums(data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_mixers()[data] * powers(len(data) + 1)[0][:-1], out=total[1:])
        return total

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.total is not None:
            h = (self.total[ends] - self.total[starts]) * powers(len(self.total))[1][starts]
        else:
            h = self._by_pieces(starts, ends)
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix64(h)

    def _by_pieces(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        order = np.argsort(starts, kind="stable") if len(starts) and (np.diff(starts) < 0).any() else None
        first = starts if order is None else starts[order]
        lo = 0
        while lo < len(first):
            begin = int(first[lo])
            hi = int(np.searchsorted(first, begin + CHUNK_BYTES // 2))
            at = np.arange(lo, hi) if order is None else order[lo:hi]
            lo = hi
            long = ends[at] > begin + CHUNK_BYTES
            short = at[~long]
            if len(short):
                total = self._sums(self.data[begin : int(ends[short].max())])
                s = starts[short] - begin
                h[short] = (total[ends[short] - begin] - total[s]) * powers(len(total))[1][s]
            for k in at[long]:
                h[k] = self._long(int(starts[k]), int(ends[k]))
        return h

    def _long(self, start: int, end: int) -> np.uint64:
        """The sum of a span over many pieces."""
        total = 0
        for lo in range(start, end, CHUNK_BYTES):
            piece = self._sums(self.data[lo : min(lo + CHUNK_BYTES, end)])
            total += int(piece[-1]) * pow(_BASE, lo - start, 1 << 64)
        return np.uint64(total & _MASK)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    return SpanHasher(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: hashes, words per row, starts, ends."""
    low = LOWER[data]
    starts, ends, per_row = spans(~IS_SPACE[low], offsets)
    return span_hashes(low, starts, ends), per_row, starts, ends


def row_of(per_row: np.ndarray) -> np.ndarray:
    """The row of each item, given the items per row."""
    return np.repeat(np.arange(len(per_row)), per_row)


def ngram_hashes(words: np.ndarray, per_row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of *n* words within rows, and the runs per row."""
    per = np.maximum(per_row - n + 1, 0)
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros_like(per)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h *= np.uint64(0xA24BAED4963EE407)
        h += words[k : len(words) - n + 1 + k]
    first = np.cumsum(per_row) - per_row
    at = np.repeat(first - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    return mix64(h[at]), per
