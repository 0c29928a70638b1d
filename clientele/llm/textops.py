"""Words and byte n-grams of many texts at once, in numpy over Arrow buffers.

A text is cut at ASCII white space (space and 0x09-0x0D). Every function works on
whole texts; ``slices`` only groups rows so that temporary arrays stay bounded.
"""

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (xor-shift and multiply)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _byte_values(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    if lower:
        table[65:91] = table[97:123]
    return table


_PLAIN, _LOWER = _byte_values(False), _byte_values(True)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the hash base and of its inverse, grown to the longest slice seen."""

    up = _powers(_ODD, 1)
    down = _powers(_INVERSE, 1)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_ODD, n), _powers(_INVERSE, n)
        return cls.up[:n], cls.down[:n]


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """(first row, end row) of runs of rows of about ``most`` bytes; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def is_white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; ``offsets`` are relative to ``data``."""
    solid = ~is_white(data)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    before[firsts] = False
    after[firsts[firsts > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; ``lower`` folds A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.get(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _PLAIN)[data] * up, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def shingles(
    data: np.ndarray, offsets: np.ndarray, size: int, lower: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row bounds, words per row): each row's sorted distinct word shingles.

    A row of fewer words than ``size`` gives its whole sequence as one shingle, a row
    without words gives none.
    """
    n = len(offsets) - 1
    starts, ends, rows = words(data, offsets)
    h = word_hashes(data, starts, ends, lower)
    counts = np.bincount(rows, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    out, bounds = [], np.zeros(n + 1, np.int64)
    if len(h) >= size:
        run = h[: len(h) - size + 1].copy()
        for j in range(1, size):
            run = mix(run * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - size + 1 + j])
    else:
        run = h[:0]
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            own = np.sort(run[a : b - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = np.array([b - a], np.uint64)
            for j in range(a, b):
                own = mix(own * np.uint64(_ODD) + h[j : j + 1])
        else:
            own = h[:0]
        out.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), bounds, counts
