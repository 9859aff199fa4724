"""Exact deduplication over a sharded cuckoo-filter index of live digests.

Texts are equal when identical after deleting ASCII white space. A row's digest is the SHA-256 of that text. Splits fold their
own copies, so that a digest leaves a split at most once, and digests are dealt to index shards by hash.

A shard keeps a cuckoo filter in memory (two bytes a live digest, besides 16 bytes of each key to resize from), no digests
and no rows. A digest that the filter does not hold is new: it is inserted and becomes content. A digest that it may hold is a
hit, and hits are verified against the content by a join on the digest, which both sides are dealt by; a hit without content
was a collision of fingerprints and is content of its own. A filter that overflows is built anew at twice the size from the
stored keys. Digests can be taken out of the index again: `retire` verifies them
likewise and then deletes them from the filter, and a later resize leaves them out.

Defined results: null counts as empty text, and all empty texts are equal; of equal texts the row with the most code
points stays, then the smallest doc_id (null last), and of repeated rows that tie in both the first one; an empty table
gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm._store import written
from strandflow.llm._text import SPACES


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; every key has two buckets. Keys are digests (bytes, 16 at least)."""

    SLOTS, KICKS = 4, 400

    def __init__(self, capacity: int = 1024):
        """Room for `capacity` keys at a load of 0.9."""
        self.mask = 1
        while self.mask * self.SLOTS < capacity / 0.9:
            self.mask <<= 1
        self.table = np.zeros((self.mask, self.SLOTS), dtype=np.uint16)
        self.mask -= 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        a = int.from_bytes(key[10:16], "little") & self.mask
        return mark, a, self._other(a, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        return mark in self.table[a] or mark in self.table[b]

    def insert(self, key: bytes) -> bool:
        """False: no room after the last kick; one mark is then homeless, so the filter must be built anew."""
        mark, a, b = self._places(key)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = b
        for k in range(self.KICKS):
            slot = (k + mark) % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = self._other(at, mark)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False


class DigestFilter:
    """A cuckoo filter that grows: it keeps 16 bytes of each live key, to be built anew from."""

    KEY = 16

    def __init__(self, capacity: int = 1024):
        self.filter, self.keys, self.resizes = CuckooFilter(capacity), bytearray(), 0
        self.gone: dict[bytes, int] = {}

    def __contains__(self, key: bytes) -> bool:
        return key in self.filter

    def put(self, key: bytes) -> None:
        self.keys += key[: self.KEY]
        if not self.filter.insert(key):
            self._resize()

    def delete(self, key: bytes) -> bool:
        """Takes out a key that is known to be live; the next resize leaves it out, too."""
        held = self.filter.delete(key)
        if held:
            self.gone[key[: self.KEY]] = self.gone.get(key[: self.KEY], 0) + 1
        return held

    def _live(self) -> bytes:
        out = bytearray()
        for at in range(0, len(self.keys), self.KEY):
            key = bytes(self.keys[at : at + self.KEY])
            if self.gone.get(key):
                self.gone[key] -= 1
            else:
                out += key
        return bytes(out)

    def _resize(self) -> None:
        room = 2 * self.filter.table.size
        view = self._live() if self.gone else bytes(self.keys)
        self.keys, self.gone = bytearray(view), {}
        while True:
            self.filter, self.resizes = CuckooFilter(room), self.resizes + 1
            if all(self.filter.insert(view[at : at + self.KEY]) for at in range(0, len(view), self.KEY)):
                return
            room *= 2


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One index shard: `hit` tells of every digest whether the filter may have held it already."""
    index = DigestFilter()
    for b in batches:
        hit = []
        for digest in b.column(0).to_pylist():
            hit.append(digest in index)
            if not hit[-1]:
                index.put(digest)
        yield b.append_column("hit", pa.array(hit, pa.bool_()))


def _leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, gone) of one shard, the live ones first, of which all that go are known to be live: each leaves the filter as it goes."""
    index = DigestFilter()
    for b in batches:
        out = []
        for digest, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not gone:
                index.put(digest)
            elif index.delete(digest):
                out.append(digest)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["digest"])


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_code, digest, row) of every row, written once; `row` tells repeated rows apart."""
    said = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.translate(said, SPACES.decode(), ""), 256))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.char_length(said).cast("long").alias("n_code"), digest.alias("digest"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


#: The order in which rows stay: most code points, then smallest doc_id, null last, then the first row.
_BEST = "struct(-n_code AS down, doc_id IS NULL AS none, doc_id, row)"


def live_digests(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) per digest: folded by splits, through the index shards, hits verified against content."""
    folded = rows.groupBy("digest", F.spark_partition_id().alias("split")).agg(F.min(F.expr(_BEST)).alias("best"), F.count("*").alias("copies"))
    seen = folded.select("digest", "best", "copies").repartition(F.col("digest"))
    seen = written(seen.mapInArrow(_shard, "digest binary, best struct<down: long, none: boolean, doc_id: long, row: long>, copies long, hit boolean"), "index")
    hits = seen.where("hit").groupBy("digest").agg(F.min("best").alias("more"), F.sum("copies").alias("again"))
    both = seen.where("not hit").select("digest", "best", "copies").join(hits, "digest", "full_outer")
    best = F.least(F.coalesce("best", "more"), F.coalesce("more", "best"))
    size = F.coalesce("copies", F.lit(0)) + F.coalesce("again", F.lit(0))
    return both.select("digest", best.alias("b"), size.alias("group_size")).select("digest", F.col("b.doc_id").alias("keep_id"), F.col("b.row").alias("keep_row"), "group_size")


def retire(live: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of live (digest, ...) whose digest is not in gone (digest).

    A filter may only delete keys that it holds, or it would take another key's mark: what goes is verified against the content first."""
    content = live.select("digest").distinct()
    known = gone.select("digest").distinct().join(content, "digest", "left_semi")
    rows = content.withColumn("gone", F.lit(False)).unionByName(known.withColumn("gone", F.lit(True)))
    leaving = rows.repartition(F.col("digest")).sortWithinPartitions("gone").mapInArrow(_leaving, "digest binary")
    return live.join(leaving, "digest", "left_anti")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_code, digest, keep_id, group_size, kept) for every row of docs.

    The last join may meet a hot digest on its large side only, which adaptive execution splits.
    """
    rows = digests(docs, key, text)
    out = rows.join(live_digests(rows), "digest")
    return out.select("doc_id", "n_code", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
