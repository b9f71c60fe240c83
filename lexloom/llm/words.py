"""Vectorised words, hashes and n-grams of UTF-8 texts, for use inside Spark tasks.

A block holds the bytes of some whole texts, one after another. Words are runs of
bytes outside a separator class, so no text is decoded and the work per byte is a
few array operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def release() -> None:
    """Give memory that is free back to the system: worker processes live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def released(run: Callable) -> Callable:
    """The function of a task's batches, with its memory released at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def released_group(run: Callable) -> Callable:
    """The function of a group's table, with its memory released at its end: the worker may wait between tasks, or meet a smaller group."""

    def whole(table: pa.Table) -> pa.Table:
        made = run(table)
        release()
        return made

    return whole


def byte_class(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


#: ASCII white space, as in [\x20\x09-\x0D].
SPACE = byte_class(b" \t\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that are hashed at a time; bounds the memory of the per-byte arrays.
_PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits of the result."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            both = []
            for b in (self.base, self.inverse):
                steps = np.full(size, b, _U)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            self.up, self.down = both
        return self.up, self.down


def _random_bytes_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


class Hasher:
    """64-bit hash of byte or word runs from differences of one running sum."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed + 77)
        self.table = _random_bytes_table(seed)
        self.powers = _Powers(int(rng.integers(1, 1 << 62)) * 4 + 3)
        self.salts = rng.integers(1, 1 << 63, 64, dtype=np.int64).astype(_U) * _U(2) + _U(1)

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[starts[i]:ends[i]]."""
        up, down = self.powers.get(len(values) + 1)
        total = np.zeros(len(values) + 1, _U)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * self.salts[0])

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), _U)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE, side="right")))
            low = int(starts[at])
            out[at:to] = self.runs(self.table[buf[low : ends[to - 1]]], starts[at:to] - low, ends[at:to] - low)
            at = to
        return out

    def grams(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hash of each run of n consecutive entries of h, by its first entry."""
        count = max(0, len(h) - n + 1)
        total = np.zeros(count, _U)
        for j in range(n):
            total += h[j : j + count] * self.salts[j + 1 if n < 60 else 1 + j % 60]
        return mix(total + _U(n))


HASH, SECOND = Hasher(11), Hasher(23)


class Words:
    """Words of the texts of a block: byte bounds, text of each word, first word of each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False):
        self.buf = _LOWER[buf] if lower else buf
        self.n_texts = len(offsets) - 1
        inside = ~separators[buf]
        change = np.zeros(len(buf) + 1, bool)  # a word may begin here: text start or a separator before
        change[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | change[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | change[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)  # and one more entry: the number of words
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(self.n_texts), self.counts)

    def hashes(self, hasher: Hasher = HASH) -> np.ndarray:
        return hasher.words(self.buf, self.starts, self.ends)

    def windows(self, n: int) -> np.ndarray:
        """Whether n words of one text begin at each word."""
        at = np.arange(len(self.starts))
        return at + n <= self.first[1:][self.text]


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the bounds of its rows; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def blocks(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows with up to ``limit`` bytes of text, one row at least: (row, row after, bytes, bounds)."""
    buf, offsets = text_column(batch, name)
    at, rows = 0, batch.num_rows
    while at < rows:
        to = min(rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1))
        yield at, to, buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def integers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
