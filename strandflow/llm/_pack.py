"""Compact blocks of integers for shuffles: a few large rows instead of one row a record.

Sorted or slowly changing columns are written as differences in byte planes, which Spark's shuffle
compression then squeezes; hashes are written as they are.
"""

from __future__ import annotations

import numpy as np


def planes(values: np.ndarray, delta: bool = True) -> bytes:
    """An int64 column: first its differences, then byte by byte of significance (zig-zag, so signs are cheap)."""
    v = values.astype(np.int64, copy=False)
    with np.errstate(over="ignore"):
        if delta:
            v = np.diff(v, prepend=np.int64(0))
        z = ((v << np.int64(1)) ^ (v >> np.int64(63))).view(np.uint64)
    top = int(z.max()).bit_length() if len(z) else 0
    width = max(1, -(-top // 8))
    raw = z.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(raw.T).tobytes()


def unplanes(data: memoryview, n: int, delta: bool = True) -> tuple[np.ndarray, int]:
    """(column, bytes used)."""
    width = data[0]
    raw = np.zeros((n, 8), dtype=np.uint8)
    raw[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=1).reshape(width, n).T
    z = raw.reshape(-1).view(np.uint64)
    v = (z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)
    return (np.cumsum(v) if delta else v), 1 + n * width


def hashes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of 64-bit hashes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unhashes(data: memoryview, n: int, width: int) -> np.ndarray:
    raw = np.zeros((n, 8), dtype=np.uint8)
    raw[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width).reshape(n, width)
    return raw.reshape(-1).view(np.uint64)


def parts_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash, from its top bits, which stay implied when only low bytes are written."""
    return ((h >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def by_part(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parts, cuts): a stable order by part, the parts there are and where each begins and ends."""
    order = np.argsort(part.astype(np.int32), kind="stable")
    found, at = np.unique(part[order], return_index=True)
    return order, found, np.append(at, len(part))
