"""Whole-column text handling inside tasks: words, hashes and runs of Arrow batches as numpy arrays, without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone. Bounds a task's memory whatever the batch holds.
CHUNK_BYTES = 4 << 20
#: Rows handled at once: two bytes can number them.
CHUNK_ROWS = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _table(separators: list[int]) -> np.ndarray:
    t = np.ones(256, bool)
    t[separators] = False
    return t


#: Bytes that are part of words. All separators are ASCII, so bytes of UTF-8 do as well as code points.
SPACE_BYTES = _table([0x20, *range(0x09, 0x0E)])
ALNUM_BYTES = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets) of slices with about `size` bytes of text and CHUNK_ROWS rows at most; nulls are empty."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        column = batch.column(at)
        if not pa.types.is_string(column.type):
            column = column.cast(pa.string())
        column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(column):
            j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1), i + CHUNK_ROWS)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of true bytes; runs end where a row ends."""
    if not len(mask):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.empty(len(mask), bool)
    first[0], last = True, np.empty(len(mask), bool)
    first[1:] = ~mask[:-1]
    last[-1], last[:-1] = True, ~mask[1:]
    edge = offsets[:-1][offsets[:-1] < len(mask)]
    first[edge] = True
    last[edge[edge > 0] - 1] = True
    start, end = np.flatnonzero(mask & first), np.flatnonzero(mask & last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, CHUNK_BYTES + 1), _BASE, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _inverse_powers(exponents: np.ndarray) -> np.ndarray:
    """_INVERSE ** exponent, by table of two digits."""
    low = np.cumprod(np.r_[np.uint64(1), np.full(4095, _INVERSE, np.uint64)])
    step = low[-1] * _INVERSE
    high = np.cumprod(np.r_[np.uint64(1), np.full(int(exponents.max(initial=0)) // 4096 + 1, step, np.uint64)])
    return low[exponents & 4095] * high[exponents >> 12]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: the polynomial of its bytes modulo 2**64, with its length, mixed. Equal spans have equal
    hashes at any place; different ones collide with a chance of about 2**-64 a pair."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=total[1:])
        h = (total[end] - total[start]) * _inverse_powers(start)
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of each run of n words within a row."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        k = np.full(m, n, np.uint64)
        for j in range(n):
            k = mix(k * np.uint64(0xA0761D6478BD642F) + h[j : j + m])
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return k[at], at


def lists(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of n rows into an array sorted by row."""
    return np.searchsorted(row, np.arange(n + 1))
