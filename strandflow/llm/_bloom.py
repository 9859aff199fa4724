"""A bit set of fixed size over a column of 64-bit hashes: thins a scan's rows before a shuffle; never decides alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm._text import mix

BITS = 1 << 26


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = mix(x.view(np.uint64))
    return (x % np.uint64(BITS)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(BITS)).astype(np.int64)


def build(rows: DataFrame, name: Callable[..., np.ndarray] = lambda x: x) -> np.ndarray:
    """The bits of the hashes that `name` makes of the rows' columns of longs. BITS / 8 bytes (8 MB) reach the driver at most, whatever the rows."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_places(name(*(c.to_numpy() for c in b.columns)))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.left_shift(np.int64(1), at & 31))], ["at", "bits"])

    found = rows.mapInArrow(places, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 32, dtype=np.uint32)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def has(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    one, two = _places(x)
    bit = lambda at: (table[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)
    return (bit(one) & bit(two)) > 0
