"""Golomb codes (divisor a power of two) of sorted distinct integers, and bitmaps."""

import numpy as np


def divisor_bits(width: int, n: int) -> int:
    """Bits of the remainder that suit ``n`` values spread over ``2**width``."""
    gap = (1 << width) / max(n, 1)
    return max(0, int(np.floor(np.log2(max(gap * 0.69, 1)))))


def encode(values: np.ndarray, k: int) -> bytes:
    """Gaps of sorted distinct non-negative ``values``: all quotients in unary, then all k-bit remainders."""
    if not len(values):
        return b""
    values = values.astype(np.int64)
    gaps = np.diff(values, prepend=np.int64(-1)) - 1
    quotient = gaps >> k
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = (gaps[:, None] >> np.arange(k)) & 1 if k else np.zeros((0, 0), np.int64)
    return np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def decode(code: bytes, n: int, k: int) -> np.ndarray:
    """The ``n`` values that ``encode`` was given."""
    if not n:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    start = (int(ends[-1]) // 8 + 1) * 8
    gaps = quotient.astype(np.int64) << k
    if k:
        rest = bits[start : start + n * k].reshape(n, k).astype(np.int64)
        gaps += rest @ (np.int64(1) << np.arange(k, dtype=np.int64))
    return np.cumsum(gaps + 1) - 1


def pack(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)
