"""Vectorised word access to Arrow string columns, shared by the text operators.

A word is a maximal run of bytes outside space and 0x09-0x0D. All functions take a
pyarrow string array (nulls count as empty text), work on its raw buffers with numpy
and never loop over characters in Python. Hashes are 64 bit and depend on content only,
so they agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _byte_table(lower: bool) -> np.ndarray:
    key = f"bytes{lower}"
    if key not in _tables:
        t = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
        if lower:
            t[65:91] = t[97:123]
        _tables[key] = t
    return _tables[key]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("pow", ())) < n:
        size = 1 << max(21, int(n - 1).bit_length())
        for key, base in (("pow", _BASE), ("inv", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _tables[key] = np.cumprod(p, dtype=np.uint64)
    return _tables["pow"][:n], _tables["inv"][:n]


def is_space(data: np.ndarray) -> np.ndarray:
    if "space" not in _tables:
        t = np.zeros(256, dtype=bool)
        t[list(SPACES)] = True
        _tables["space"] = t
    return _tables["space"][data]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets has one entry more than rows and starts at 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """Words of consecutive texts: byte spans, hashes, and first word of each text (one entry more than texts)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(texts: pa.Array, lower: bool = False) -> Words:
    """All words of the texts, hashed; lower: A-Z count as a-z."""
    data, off = buffers(texts)
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(len(off), dtype=np.int64), np.zeros(0, dtype=np.uint64))
    inside = ~is_space(data)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < n)]
    begin[edge] = inside[edge]
    stop[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    p, q = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_byte_table(lower)[data] * p, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * q[starts])
    return Words(data, starts, ends, np.searchsorted(starts, off), hashes)


def grams(w: Words, n: int) -> np.ndarray:
    """Hash of the n words from each word on; only entries for which `whole` holds are of one text."""
    h, m = w.hashes, len(w.hashes)
    out = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            if k < m:
                out[: m - k] += h[k:] * np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
    return mix(out)


def whole(w: Words, n: int) -> np.ndarray:
    """Whether n words from each word on lie in its text."""
    return np.arange(len(w.hashes)) + n <= np.repeat(w.first[1:], w.counts)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, each of one row at least: bounds memory, drops nothing."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to
    pa.default_memory_pool().release_unused()


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """An Arrow binary array whose rows are values[cuts[i]:cuts[i+1]]."""
    width = values.dtype.itemsize
    off = (np.asarray(cuts, dtype=np.int64) * width).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())
