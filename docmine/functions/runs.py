"""Hashed word and token runs of texts, in Arrow batches: the values of ``scalars.shingle_bits``
and ``text.hash_int`` without an interpreted step per word."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5
from math import sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries that a task remembers of a function of words or runs.
KEPT = 1 << 17
#: Rows of a batch that are held as Python objects at a time.
ROWS = 128
#: Spans whose MD5 rounds run together, few enough to stay in a core's cache.
SPANS = 8192
GAP = np.zeros(256, bool)
GAP[[32, 9, 10, 11, 12, 13]] = True
_STATE = tuple(np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(sin(i + 1)) * (1 << 32))) for i in range(64)]


def hash_int(text: str) -> int:
    """The first eight hex digits of the md5 value, as ``text.hash_int`` takes them."""
    return int.from_bytes(md5(text.encode()).digest()[:4], "big")


def word_places(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with one blank after every word, starts and ends of the words in them, number of
    the first word per row and, last, of all words). White space is ``\\s`` of Java."""
    rows = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    ink = ~GAP[data]
    before = np.concatenate([[False], ink[:-1]])
    kept = ink | before
    at = np.cumsum(kept) - kept
    opened = np.flatnonzero(ink & ~before)
    ends = at[np.flatnonzero(~ink & before)]
    row_starts = np.cumsum([0, *[len(r) + 1 for r in rows]])
    return np.where(ink, data, 32).astype(np.uint8)[kept], at[opened], ends, np.searchsorted(opened, row_starts)


def md5_heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``hash_int`` of every span of bytes: the MD5 rounds over blocks of spans; the few spans
    that are longer than one MD5 block go through hashlib."""
    out = np.zeros(len(starts), np.int64)
    sizes = ends - starts
    for i in np.flatnonzero(sizes > 55):
        out[i] = int.from_bytes(md5(data[starts[i] : ends[i]].tobytes()).digest()[:4], "big")
    short = np.flatnonzero(sizes <= 55)
    # Blocks are as wide as the longest span; words behind it but the size are zero.
    width = int(sizes[short].max(initial=0)) // 4 * 4 + 4
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)
    inside = (np.arange(width) < np.arange(width)[:, None]).view(np.uint8)
    for at in range(0, len(short), SPANS):
        mine = short[at : at + SPANS]
        size = sizes[mine]
        block = windows[starts[mine]] * inside[size]
        block[np.arange(len(mine)), size] = 0x80
        words = dict(enumerate(np.ascontiguousarray(block.view("<u4").T)))
        words[14] = (size * 8).astype(np.uint32)
        out[mine] = _first_word(words, len(mine)).astype("<u4").view(">u4")
    return out


def _first_word(words: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first word of the MD5 state after one block of the given words (others are zero)."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _STATE)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(f, a, out=f)
        if g in words:
            np.add(f, words[g], out=f)
        np.add(f, _SINES[i], out=f)
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(f, turn, out=t)
        np.right_shift(f, 32 - turn, out=f)
        np.bitwise_or(f, t, out=f)
        # The oldest word is read; its place takes the newest.
        np.add(f, b, out=a)
        a, d, c, b = d, c, b, a
    return a + _STATE[0]


class remembered(dict):
    """Values of a function by argument, forgotten all at once when there are ``KEPT``."""

    def __init__(self, fn: Callable):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        if len(self) >= KEPT:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def word_run_bits(texts: list[str | None], n: int, slots: int) -> tuple[np.ndarray, pa.Array]:
    """(rows that have words, their sorted distinct slots of all runs of ``n`` words); a row of
    fewer words is one run."""
    data, starts, ends, first = word_places(texts)
    counts = np.diff(first)
    row, word = np.repeat(np.arange(len(counts)), counts), np.arange(len(starts))
    last = first[1:][row]
    heads = np.flatnonzero((word + n <= last) | (word == first[:-1][row]))
    slot = md5_heads(data, starts[heads], ends[np.minimum(heads + n, last[heads]) - 1]) % slots
    keys = np.unique(row[heads] << 32 | slot)
    some = counts > 0
    cuts = np.searchsorted(keys, np.flatnonzero(some) << 32)
    offsets = pa.array(np.append(cuts, len(keys)).astype(np.int32))
    return some, pa.ListArray.from_arrays(offsets, pa.array((keys & 0xFFFFFFFF).astype(np.int32)))


def text_bits(df: DataFrame, key: str, text: str, n: int, slots: int) -> DataFrame:
    """(id, bits): slots of the word runs of every text that has words."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                some, bits = word_run_bits(part.column(1).to_pylist(), n, slots)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(some)), bits], names=["id", "bits"])

    return df.select(key, text).mapInArrow(run, f"id {kind}, bits array<int>")


def token_bits(df: DataFrame, key: str, text: str, pattern: str, n: int, slots: int) -> DataFrame:
    """(id, bits): slots of the runs of ``n`` tokens of every text; null gives none, no token
    an empty list."""
    kind = df.schema[key].dataType.simpleString()
    tokens = re.compile(pattern, re.ASCII)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = remembered(lambda gram: hash_int(" ".join(gram)) % slots)

        def bits(value: str | None) -> list[int]:
            found = tokens.findall(value or "")
            grams = zip(*[found[i:] for i in range(n)], strict=False) if len(found) >= n else [tuple(found)][: len(found)]
            return sorted({slot[g] for g in grams})

        for batch in batches:
            for at in range(0, batch.num_rows, 4 * ROWS):
                part = batch.slice(at, 4 * ROWS)
                values = pa.array([bits(v) for v in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=["id", "bits"])

    return df.select(key, text).mapInArrow(run, f"id {kind}, bits array<int>")
