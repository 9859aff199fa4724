"""Ranked lexical search over document-sharded CSR postings with integer impacts.

`build_index` deals documents to shards of some SHARD terms, as the scan yields them. A shard is one row: its documents in order
of id, its terms in order of hash, and a list of (document, impact) a term in CSR form. A posting's impact is the integer
10^9 tf div (1000 tf + 8 m), computed once from the corpus's totals. The weight of a term is the same for all of its postings, so
it multiplies a list when it is read; document frequencies are then sums of list lengths, and no dictionary of the corpus is made.

`search` takes items in blocks of MOST terms. Each task goes through its shards, adds an item's lists term by term into a dense
accumulator, takes the k best by argpartition with all ties at the k-th place in order of id, and keeps k an item over its
shards; a window merges k rows a task and item.

A term is a maximal run of bytes outside ASCII but for digits and letters, A-Z lower-cased; terms are told apart by 64-bit hashes
(10^4 terms of items among 10^10 of a corpus meet by chance with odds of 5 in a million).

Defined results: null and empty texts have no term and are never found, nor counted as documents; an item without terms,
or whose terms no document holds, has no rows; items that share an id (or have none) are one item; of equal scores the smaller
doc_id comes first, null last; rows that share a doc_id are documents of their own; a text may have any length, its terms
are hashed in pieces; empty tables give no rows; other columns, whatever their names, are not read. n * N must stay below 10^17.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm._store import drop, written
from strandflow.llm._text import _byte_table, _powers, buffers, mix, slices

SHARD, MOST, PIECE = 1 << 21, 1 << 18, 1 << 20
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
SHARD_SCHEMA = "documents binary, without_id long, terms binary, lists binary, postings binary, impacts binary"


def term_hashes(texts: pa.Array, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every term, in order of place."""
    data, off = buffers(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _INSIDE[data]
    edge = off[(off > 0) & (off < n)]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    begin[edge], stop[edge - 1] = inside[edge], inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    hashes, lo = np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):
        a = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, a + piece, "right")))
        p, q = _powers(ends[hi - 1] - a)
        total = np.zeros(len(p) + 1, np.uint64)
        np.cumsum(_byte_table(True)[data[a : ends[hi - 1]]] * p, out=total[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        hashes[lo:hi] = mix((total[e] - total[s]) * q[s])
        lo = hi
    return hashes, np.searchsorted(off, starts, "right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms, of each batch."""
    for batch in batches:
        found, terms = 0, 0
        for b in slices(batch):
            data, off = buffers(b.column(0))
            if len(data):
                begin = _INSIDE[data]
                edge = off[off < len(data)]
                first = begin[edge]
                begin[1:] &= ~_INSIDE[data[:-1]]
                begin[edge] = first
                n = np.diff(np.append(0, np.cumsum(begin))[off])
                found, terms = found + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([found]), pa.array([terms])], ["documents", "terms"])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places at which any of the sorted columns changes."""
    new = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(np.ones(min(len(columns[0]), 1), bool), new))


def shard_row(ids: list[int | None], hashes: np.ndarray, owner: np.ndarray, documents: int, terms: int) -> pa.RecordBatch:
    """One shard in CSR form. documents, terms: of the whole corpus."""
    missing = np.array([i is None for i in ids], dtype=bool)
    value = np.array([i or 0 for i in ids], dtype=np.int64)
    by_id = np.lexsort((value, missing))
    rank = np.empty(len(ids), np.int32)
    rank[by_id] = np.arange(len(ids), dtype=np.int32)
    length = np.bincount(owner, minlength=len(ids))[by_id]
    doc = rank[owner]
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    at = _starts(h, d)
    tf = np.diff(np.append(at, len(h)))
    h, d = h[at], d[at]
    first = _starts(h)
    m = 10 + 90 * length * documents // max(terms, 1)
    impact = (1_000_000_000 * tf // (1000 * tf + 8 * m[d])).astype(np.int32)
    parts = [value[by_id], h[first], np.append(first, len(h)).astype(np.int64), d, impact]
    a, b, c, e, f = (pa.array([x.tobytes()], pa.binary()) for x in parts)
    return pa.RecordBatch.from_arrays([a, pa.array([int(missing.sum())], pa.int64()), b, c, e, f], [x.split()[0] for x in SHARD_SCHEMA.split(", ")])


@dataclass(frozen=True)
class Index:
    """shards: a written table, one row a shard; documents: those with a term; terms: all of theirs."""

    shards: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> Index:
    """Two scans of the texts: totals, then shards of about `shard` terms, each of one document at least."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = d.select("text").mapInArrow(_counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = (int(x or 0) for x in total)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, owner, held = [], [], [], 0
        for batch in batches:
            for b in slices(batch):
                h, o = term_hashes(b.column(1))
                if not len(h):
                    continue
                has = np.unique(o)
                own = b.column(0).to_pylist()
                hashes.append(h)
                owner.append(np.searchsorted(has, o) + len(ids))
                ids += [own[i] for i in has.tolist()]
                held += len(h)
                if held >= shard:
                    yield shard_row(ids, np.concatenate(hashes), np.concatenate(owner), documents, terms)
                    ids, hashes, owner, held = [], [], [], 0
        if held:
            yield shard_row(ids, np.concatenate(hashes), np.concatenate(owner), documents, terms)

    return Index(written(d.mapInArrow(shards, SHARD_SCHEMA), "postings"), documents, terms)


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, term) once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                h, o = term_hashes(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(o)), pa.array(h.view(np.int64))], ["item_id", "term"])

    return items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(run, "item_id long, term long").distinct()


def _lists(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the wanted terms there are, their places in terms); both sorted."""
    at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
    there = np.flatnonzero(terms[at] == wanted) if len(terms) else np.zeros(0, np.int64)
    return there, at[there]


def _frequencies(shards: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Documents that hold each wanted term: sums of list lengths. Reads terms and list bounds alone."""
    held = shards.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, lists in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                which, at = _lists(np.frombuffer(terms, np.uint64), held.value)
                size = np.diff(np.frombuffer(lists, np.int64))[at]
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(size)], ["term", "documents"])

    out = np.zeros(len(wanted), np.int64)
    for term, n in shards.select("terms", "lists").mapInArrow(run, "term long, documents long").groupBy("term").agg(F.sum("documents")).collect():
        out[term] = n
    return out


def best_places(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores above 0; of equal scores at the k-th place, the first ones."""
    if len(score) > k:
        least = score[np.argpartition(score, len(score) - k)[len(score) - k]]
        if least > 0:
            above = np.flatnonzero(score > least)
            return np.sort(np.append(above, np.flatnonzero(score == least)[: k - len(above)]))
    return np.flatnonzero(score > 0)


def _scored(shards: DataFrame, items: list[tuple[int | None, np.ndarray]], terms: np.ndarray, weights: np.ndarray, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of each task. items: id and places of its terms."""
    held = shards.sparkSession.sparkContext.broadcast((items, terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, weights = held.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                raw = [batch.column(c)[row].as_py() for c in range(6)]
                ids, (own, lists), (docs, impacts) = np.frombuffer(raw[0], np.int64), (np.frombuffer(raw[2], np.uint64), np.frombuffer(raw[3], np.int64)), (np.frombuffer(raw[x], np.int32) for x in (4, 5))
                named = len(ids) - raw[1]
                place = np.full(len(terms), -1)
                which, at = _lists(own, terms)
                place[which] = at
                for j, (_, wanted) in enumerate(items):
                    score = np.zeros(len(ids), np.int64)
                    for t in wanted[place[wanted] >= 0].tolist():
                        a, b = lists[place[t]], lists[place[t] + 1]
                        score[docs[a:b]] += weights[t] * impacts[a:b]
                    top = best_places(score, k)
                    best[j] = heapq.nsmallest(k, best[j] + [(-s, p >= named, i) for s, p, i in zip(score[top].tolist(), top.tolist(), ids[top].tolist(), strict=True)])
        rows = [(items[j][0], None if no else i, -s) for j, found in enumerate(best) for s, no, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return shards.mapInArrow(run, "item_id long, doc_id long, score long")


def _blocks(pairs: DataFrame, most: int) -> int:
    """So many blocks that none has more than `most` (item, term) pairs, but for an item that has more on its own."""
    sizes, blocks = pairs.groupBy("item_id").count(), 1
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
        over = sizes.groupBy(block.alias("block")).agg(F.sum("count").alias("pairs"), F.count("*").alias("items")).where(f"pairs > {most} and items > 1")
        if not over.limit(1).count():
            return blocks
        blocks *= 2


def search(index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents."""
    pairs = written(_item_terms(items, key, text), "items")
    blocks, out = _blocks(pairs, most), []
    for block in range(blocks):
        held: dict[int | None, list[int]] = {}
        for i, t in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            held.setdefault(i, []).append(t)
        own = {i: np.array(t, np.int64).view(np.uint64) for i, t in held.items()}
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *own.values()]))
        df = _frequencies(index.shards, terms)
        weights = np.floor(1000 * np.log((2 * index.documents + 2) / (2 * df + 1))).astype(np.int64)
        out.append(_scored(index.shards, [(i, np.searchsorted(terms, t)) for i, t in own.items()], terms, weights, k))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = written(found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked")
    drop(pairs)
    return out
