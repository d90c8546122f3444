"""Compact binary columns for numpy arrays that travel through a Spark shuffle.

One Arrow row carries the entries that one piece of input has for one bucket,
as a few zstandard-compressed arrays, instead of one row per entry.
"""

from __future__ import annotations

import numpy as np
import zstandard

_CODE = {"u1": np.uint8, "u2": np.uint16, "u4": np.uint32, "u8": np.uint64, "i4": np.int32, "i8": np.int64}


def pack(a: np.ndarray, delta: bool = False) -> bytes:
    """zstd of the array's byte planes; ``delta`` for ascending unsigned values."""
    if delta and len(a):
        a = np.diff(a, prepend=a.dtype.type(0))
    head = a.dtype.str[1:].encode() + (b"d" if delta else b".")
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return head + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    dtype = np.dtype(_CODE[b[:2].decode()])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[3:]), dtype=np.uint8)
    a = np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)
    return np.cumsum(a, dtype=dtype) if b[2:3] == b"d" else a


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a 64-bit hash by range of its value: ascending hashes give ascending buckets."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def concat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype)
