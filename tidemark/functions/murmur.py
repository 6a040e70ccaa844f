"""Canonical Murmur3 x86 32-bit over byte strings, vectorised per batch.

Spark's own ``hash`` treats the tail bytes differently, so bit compatibility
needs this function. Keys of one length are hashed together in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = np.uint64(0xFFFFFFFF)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & _M


def _mix(k: np.ndarray) -> np.ndarray:
    return (_rotl((k * np.uint64(0xCC9E2D51)) & _M, 15) * np.uint64(0x1B873593)) & _M


def murmur3_array(keys: list[bytes], seed: int = 0) -> np.ndarray:
    """uint64 array of the 32-bit hashes of ``keys``."""
    out = np.zeros(len(keys), dtype=np.uint64)
    lengths = np.fromiter((len(k) for k in keys), dtype=np.int64, count=len(keys))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        b = np.frombuffer(b"".join(keys[i] for i in at), dtype=np.uint8).reshape(len(at), int(n)).astype(np.uint64)
        h = np.full(len(at), seed, dtype=np.uint64)
        whole = int(n) // 4 * 4
        for i in range(0, whole, 4):
            word = b[:, i] | b[:, i + 1] << np.uint64(8) | b[:, i + 2] << np.uint64(16) | b[:, i + 3] << np.uint64(24)
            h = (_rotl(h ^ _mix(word), 13) * np.uint64(5) + np.uint64(0xE6546B64)) & _M
        if n > whole:
            tail = np.zeros(len(at), dtype=np.uint64)
            for j in range(whole, int(n)):
                tail |= b[:, j] << np.uint64(8 * (j - whole))
            h ^= _mix(tail)
        h ^= np.uint64(n)
        h ^= h >> np.uint64(16)
        h = (h * np.uint64(0x85EBCA6B)) & _M
        h ^= h >> np.uint64(13)
        h = (h * np.uint64(0xC2B2AE35)) & _M
        out[at] = h ^ (h >> np.uint64(16))
    return out


def murmur3(key: Column) -> Column:
    """Murmur3 (seed 0) of a string or binary column as an unsigned value in a long; null hashes as empty."""

    @F.pandas_udf("long")
    def hashed(s: pd.Series) -> pd.Series:
        return pd.Series(murmur3_array([b"" if v is None else bytes(v) for v in s]).astype(np.int64))

    return hashed(key.cast("binary"))
