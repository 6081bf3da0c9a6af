"""Whole texts as byte buffers: word and line spans and 64-bit span hashes for numpy, without a Python string a word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE = 2 << 20

#: The white space of `[^\x20\x09-\x0D]+`; fixed values.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

WORD_BYTE = np.ones(256, bool)
WORD_BYTE[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about `size` bytes of text each: (rows, bytes, offsets)."""
    data, offsets = raw(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    trim()


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of `inside` bytes that stay within one row."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; fixed values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(2)
def powers(n: int, base: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        step = step * step % 2**64
        have += more
    return out


def trim() -> None:
    """Give freed memory back to the system: a reused worker would keep the most it ever held, and tables of powers too."""
    powers.cache_clear()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back:
        give_back(0)


class Hashes:
    """64-bit hashes of any spans of a buffer from one prefix sum (a polynomial with an odd base, mod 2 ** 64)."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(20, (len(data) + 1).bit_length())
        self.inverse = powers(n, pow(BASE, -1, 2**64))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * powers(n, BASE)[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
