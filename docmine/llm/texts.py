"""Numpy kernels over Arrow batches of texts: bytes, words, word runs and their hashes.

Every kernel works on a slice of a batch at a time, so a task holds a bounded number of
text bytes (or one text, if that is longer). A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kernels allocate some 60 bytes for a byte of a slice, and workers keep what they once held.
SLICE_BYTES = 1 << 19

_U = np.uint64
with np.errstate(over="ignore"):
    _STEP = _U(0x9E3779B97F4A7C15)
    _BASE = _U(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64
    _BACK = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = np.zeros(256, bool)
GAP[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble of every element."""
    x = x + _STEP
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_codes(fold: bool) -> np.ndarray:
    codes = mix(np.arange(256, dtype=_U))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


EXACT_CODES, FOLDED_CODES = _byte_codes(False), _byte_codes(True)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            for name, base in (("up", _BASE), ("down", _BACK)):
                row = np.full(size + 1, base, _U)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=_U))
        return self.up, self.down


POWERS = _Powers()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds at most ``limit`` bytes of the column, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at, done = 0, 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at, done = stop, int(ends[stop - 1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, row offsets)."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hashes(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hashes`` takes the hash of any byte span."""
    up, _ = POWERS.get(len(data))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = POWERS.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the range of its words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ink = ~gap[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = ink[begins]
    closes = offsets[1:][np.diff(offsets) > 0] - 1
    last[closes] = ink[closes]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (rows not yet told apart)."""
    if len(words) < n:
        return np.zeros(0, _U)
    up, _ = POWERS.get(n)
    total = np.zeros(len(words) - n + 1, _U)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * up[j]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per row its sorted distinct shingles of ``n`` words, A-Z folded to lower case.

    A row with fewer words has its whole word sequence as its one shingle; a row without
    words has none."""
    starts, ends, words = word_spans(data, offsets)
    hashes = span_hashes(prefix_hashes(data, FOLDED_CODES), starts, ends)
    runs = run_hashes(hashes, n)
    up, _ = POWERS.get(n)
    for a, b in zip(words[:-1], words[1:], strict=True):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield mix((hashes[a:b] * up[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a))
        else:
            yield np.zeros(0, _U)
