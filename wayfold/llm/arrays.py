"""Vectorised text kernels: words, lines and windows of a whole Arrow column as numpy arrays.

Everything works on UTF-8 bytes, so a text is never copied into Python strings. A null text reads as empty.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is handled alone.
BLOCK_BYTES = 2 << 20

SPACE_BYTES = b" \t\n\x0b\x0c\r"
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACE_BYTES)] = False
#: Digits, letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def once(key: str, build: Callable):
    """A value built once in the life of a Python worker, whichever way the code got there."""
    kept = sys.__dict__.setdefault("_wayfold_once", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def release(*keys: str) -> None:
    """Forget what other operators keep in this worker: all but the values of these keys and those of this module."""
    kept = sys.__dict__.setdefault("_wayfold_once", {})
    for key in [*kept]:
        if key not in (*keys, "powers", "byte values"):
            del kept[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = once("powers", lambda: {})
    if kept.get("n", 0) < n:
        size = 1 << max(n, 1 << 16).bit_length()
        up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
        up[0] = down[0] = 1
        kept.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
        if size > 4 * BLOCK_BYTES:  # a rare long text: not kept
            return kept.pop("up"), (kept.pop("down"), kept.pop("n"))[0]
    return kept["up"], kept["down"]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in the bytes) for runs of rows of at most limit bytes or one row."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    rows = len(column)
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, np.int64, rows + 1, column.offset * 8) if rows else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that stay inside one text."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    cuts = offsets[1:] - 1
    after[cuts[cuts >= 0]] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial over random byte values, from one prefix sum."""
    up, down = _powers(len(data) + 1)
    table = once("byte values", lambda: mix(np.arange(1, 257, dtype=np.uint64) * BASE))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * MIX_2)


class Words:
    """The words of a block: byte spans, text numbers and hashes, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: bool):
        self.data = LOWER[data] if fold else data
        self.starts, self.ends = runs(is_word[data], offsets)
        self.first = np.searchsorted(self.starts, offsets)  # text t has words first[t] up to first[t + 1]
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of so many words that stays inside one text."""
        count = len(self) - size + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        text = self.texts()
        at = np.flatnonzero(text[:count] == text[size - 1 :])
        total = np.zeros(count, np.uint64)
        for k in range(size):
            total *= BASE
            total += self.hashes[k : k + count]
        return at, mix(total[at])

    def joined(self, first: int, size: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[first : first + size], self.ends[first : first + size]))


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's range first[t] up to first[t + 1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
