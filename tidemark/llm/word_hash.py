"""Hashes of all words of many texts at once, by numpy over their UTF-8 bytes.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``. Its hash is the sum of
a random 64-bit value of each byte times a power of its place, modulo 2^64, read
from running sums; no table of words is kept. Bytes are taken in blocks that end
between words, so memory is a block, or the longest word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 1 << 18
_P = 0x9E3779B97F4A7C15
_RANDOM = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _running(x: np.ndarray, dtype: type) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype)
    np.cumsum(x, out=out[1:])
    return out


def word_hashes(data: bytes, strip: np.ndarray | None = None, mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, whether some byte is in ``mark``) of every word.

    Bytes in ``strip`` do not count at a word's ends, unless it has no others. Both are tables of 256 truth values.
    """
    b = np.frombuffer(data, np.uint8)
    hashes, starts, marks, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], 0
    while at < len(b):
        end = min(at + BLOCK, len(b))
        while end < len(b) and not (cut := np.flatnonzero(_SPACE[b[at:end]])).size:
            end = min(end + (end - at), len(b))
        if end < len(b):
            end = at + int(cut[-1]) + 1
        x = b[at:end]
        solid = np.concatenate([[False], ~_SPACE[x], [False]])
        turn = np.flatnonzero(solid[1:] != solid[:-1])
        first, last = turn[::2], turn[1::2]
        up, down = _powers(1 << max(BLOCK, len(x)).bit_length())
        total = _running(_RANDOM[x] * up[: len(x)], np.uint64)
        a, z = first, last
        if strip is not None and len(a):
            core = ~strip[x] & solid[1:-1]
            n, where = _running(core, np.int64), np.flatnonzero(core)
            if len(where):
                has = n[last] > n[first]
                a = np.where(has, where[np.minimum(n[first], len(where) - 1)], first)
                z = np.where(has, where[n[last] - 1] + 1, last)
        hashes.append((total[z] - total[a]) * down[a])
        starts.append(first + at)
        if mark is not None:
            n = _running(mark[x], np.int64)
            marks.append(n[last] > n[first])
        at = end
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(marks)


def byte_table(chars: str) -> np.ndarray:
    """Truth values of the ASCII characters."""
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out
