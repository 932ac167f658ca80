"""Vectorised work on the texts of an Arrow batch: slices, words, rolling hashes.

Everything here runs inside a task on one slice of about ``SLICE_BYTES``; a longer text is a slice of
its own. Hashes only find candidates or bins, unless a caller says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 2), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a bijection), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return total


def gram_hashes(values: np.ndarray, n: int, base: int = _WORD_BASE) -> np.ndarray:
    """A hash for each run of ``n`` consecutive values (len - n + 1 of them, or none)."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    total = _sums(values, base)
    return mix((total[n:] - total[:-n]) * powers(inverse(base), len(values))[: len(values) - n + 1])


def byte_gram_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    return gram_hashes(buf.astype(np.uint64) + np.uint64(1), n, _BYTE_BASE)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = _sums(buf.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
    return mix((total[ends] - total[starts]) * powers(inverse(_BYTE_BASE), len(buf))[starts])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, in log2(w) passes."""
    if len(x) < w:
        return x[:0]
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds of the rows in them) of a string column; null is empty."""
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, and where each row's runs begin among them."""
    inside = is_word[buf]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)


def per_word(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its row, and the end of that row's words."""
    counts = np.diff(first)
    return np.repeat(np.arange(len(counts)), counts), np.repeat(first[1:], counts)


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a window of ``length`` from one of the starts."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(starts + length, n), minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
