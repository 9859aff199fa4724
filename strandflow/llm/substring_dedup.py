"""Substring deduplication by relative Lempel-Ziv factors.

Every window of `length` consecutive words is indexed in a reference block, by hash. Map tasks hash the windows of their split,
keep the first window of each kind and settle the split's other copies at once; the rest go, packed, to their block. A
block knows each window's first place over the whole corpus, and tells all later places their reference: (document, word).

A document is then parsed greedily from left to right: at the first window that has a reference a factor begins, and it grows
word by word as long as the same reference goes on; where it stops, the next window is looked up on its own, so factors
that touch or overlap are found whole. A factor has `length` words at least. Factors of exactly `length` words rest on one
hash, so the words at both of their ends and between are compared with the reference's (by 128 bits of the words
themselves); longer factors rest on two hashes at least that agree in place. The words of all factors are the duplicate spans.

Order: smaller doc_id first (null last), then earlier start. Defined results: null or empty text has no words and loses
none; texts shorter than a window lose none; rows that share a doc_id or have none are rows of their own, in the order of
the table's rows, so of repeated rows the first stays whole; an empty table gives no rows; other columns, whatever their
names, are not read. Window hashes have 64 bits, of which at least 56 and the block number travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import _bloom, _pack
from strandflow.llm._order import ID, with_order
from strandflow.llm._store import written
from strandflow.llm._text import grams, mix, slices, whole, words

WIDTH = 7
WINDOWS, MARKS, FACTORS, TEXTS = 0, 1, 2, 3
_SCHEMA = "part int, kind int, data binary"
_FACTOR = ["doc", "start", "length", "ref_doc", "ref_start"]


def _longs(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


def _doc_part(ids: np.ndarray, parts: int) -> np.ndarray:
    return _pack.parts_of(mix(ids.view(np.uint64) + np.uint64(1)), parts)


def _block(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "data"])


def _packed(columns: list[np.ndarray]) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(_pack.planes(c) for c in columns)


def _unpacked(data: bytes, count: int) -> list[np.ndarray]:
    view = memoryview(data)
    n, at, out = int(np.frombuffer(view, dtype=np.int64, count=1)[0]), 8, []
    for _ in range(count):
        c, used = _pack.unplanes(view[at:], n)
        out.append(c)
        at += used
    return out


def _later(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, first): the entries that have an earlier entry of the same hash, and for each of these the first one."""
    order = np.argsort(h)
    s = h[order]
    same = np.zeros(len(h), dtype=bool)
    same[1:] = s[1:] == s[:-1]
    again = same.copy()
    again[:-1] |= same[1:]
    order = order[again]
    order = order[np.lexsort((pos[order], doc[order], h[order]))]
    head = np.ones(len(order), dtype=bool)
    head[1:] = h[order[1:]] != h[order[:-1]]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return order[~head], first[~head]


def _marks(doc: np.ndarray, pos: np.ndarray, later: np.ndarray, first: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Marks (document, word, reference's document, how far its word lies ahead), dealt by document. Runs of a factor differ in the word alone."""
    order = np.lexsort((pos[later], doc[later]))
    later, first = later[order], first[order]
    order, found, cuts = _pack.by_part(_doc_part(doc[later], parts))
    for part, a, b in zip(found, cuts[:-1], cuts[1:], strict=True):
        x, y = later[order[a:b]], first[order[a:b]]
        yield int(part), MARKS, _packed([doc[x], pos[x], doc[y], pos[y] - pos[x]])


def _windows(length: int, parts: int, most: int = 4 << 20):
    """Map side: windows of a split, folded, then dealt by hash; marks of the split's own later copies."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, bytes]]:
        h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        later, first = _later(h, doc, pos)
        yield from _marks(doc, pos, later, first, parts)
        keep = np.ones(len(h), dtype=bool)
        keep[later] = False
        h, doc, pos = h[keep], doc[keep], pos[keep]
        order, found, cuts = _pack.by_part(_pack.parts_of(h, parts))
        for part, a, b in zip(found, cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            yield int(part), WINDOWS, np.int64(b - a).tobytes() + _pack.hashes(h[at], WIDTH) + _pack.planes(doc[at]) + _pack.planes(pos[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for b in slices(batch):
                w = words(b.column(1))
                ok = np.flatnonzero(whole(w, length))
                if not len(ok):
                    continue
                own = w.owner()[ok]
                held.append((grams(w, length)[ok], _longs(b.column(0))[own], ok - w.first[own]))
                n += len(ok)
                if n >= most:
                    yield _block(list(flush(held)))
                    held, n = [], 0
        if held:
            yield _block(list(flush(held)))

    return run


def _references(parts: int):
    """Reduce side: one reference block at a time. Local marks pass through."""

    def settle(held: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        h, doc, pos = [], [], []
        for data in held:
            view = memoryview(data)
            n = int(np.frombuffer(view, dtype=np.int64, count=1)[0])
            h.append(_pack.unhashes(view[8:], n, WIDTH))
            d, used = _pack.unplanes(view[8 + n * WIDTH :], n)
            doc.append(d)
            pos.append(_pack.unplanes(view[8 + n * WIDTH + used :], n)[0])
        h, doc, pos = np.concatenate(h), np.concatenate(doc), np.concatenate(pos)
        yield from _marks(doc, pos, *_later(h, doc, pos), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None
        for b in batches:
            out = []
            for part, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if kind == MARKS:
                    out.append((part, kind, data.as_py()))
                    continue
                if part != now and held:
                    out += settle(held)
                    held = []
                now = part
                held.append(data.as_py())
            if out:
                yield _block(out)
        if held and (out := list(settle(held))):
            yield _block(out)

    return run


def parse(doc: np.ndarray, pos: np.ndarray, ref_doc: np.ndarray, ref_pos: np.ndarray, length: int) -> list[np.ndarray]:
    """Factors (document, first word, words, reference's document and first word) of windows that have a reference, sorted by (document, word).

    A factor goes on while the next window stands next to it in the document and in the same reference.
    """
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_pos[1:] != ref_pos[:-1] + 1)
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(doc)))
    return [doc[at], pos[at], run + length - 1, ref_doc[at], ref_pos[at]]


def _parse(length: int):
    """Marks, sorted by part: the factors of their documents."""

    def settle(held: list[bytes]) -> pa.RecordBatch:
        doc, pos, ref, ahead = (np.concatenate(c) for c in zip(*(_unpacked(x, 4) for x in held), strict=True))
        order = np.lexsort((pos, doc))
        doc, pos, ref, ahead = doc[order], pos[order], ref[order], ahead[order]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in parse(doc, pos, ref, pos + ahead, length)], _FACTOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if part != now and held:
                    yield settle(held)
                    held = []
                now = part
                held.append(data.as_py())
        if held:
            yield settle(held)

    return run


def _wanted(bits):
    """Scan: the documents whose id the bit set holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_bloom.has(bits.value, _longs(b.column(0)).view(np.uint64))))

    return run


def _window_names(length: int):
    """(doc, start, name): 128 bits of the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start, name = [], [], []
            for d, text, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                w = text.as_py().encode().split()
                for k in at:
                    doc.append(d)
                    start.append(k)
                    name.append(hashlib.md5(b" ".join(w[k : k + length])).digest())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(name, pa.binary())], ["doc", "start", "name"])

    return run


def unequal(found: DataFrame, d: DataFrame, length: int) -> DataFrame:
    """(doc, start) of factors of one window whose words are not those of their reference, written."""
    one = found.where(F.col("length") == length)
    places = one.select("doc", "start").union(one.select("ref_doc", "ref_start")).distinct().groupBy("doc").agg(F.collect_list("start").alias("at"))
    places = written(places, "places")
    bits = d.sparkSession.sparkContext.broadcast(_bloom.build(places.select("doc")))
    texts = d.mapInArrow(_wanted(bits), f"{ID} long, text string").join(places, F.col(ID) == F.col("doc")).select("doc", "text", "at")
    names = written(texts.mapInArrow(_window_names(length), "doc long, start long, name binary"), "window_names")
    ref = names.toDF("ref_doc", "ref_start", "ref_name")
    pairs = one.join(names, ["doc", "start"]).join(ref, ["ref_doc", "ref_start"])
    return written(pairs.where("name <> ref_name").select("doc", "start"), "unequal")


def factors_of(d: DataFrame, length: int) -> DataFrame:
    """(doc, start, length, ref_doc, ref_start) of every factor, written. d: (ID, text)."""
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = d.mapInArrow(_windows(length, n), _SCHEMA).repartition(n, "part").sortWithinPartitions("part")
    marks = found.mapInArrow(_references(n), _SCHEMA).repartition(n, "part").sortWithinPartitions("part")
    out = written(marks.mapInArrow(_parse(length), ", ".join(f"{c} long" for c in _FACTOR)), "factors")
    bad = unequal(out, d, length)
    return written(out.join(bad, ["doc", "start"], "left_anti").select(_FACTOR), "factors") if bad.limit(1).count() else out


def _spans(parts: int):
    """Factors, dealt as texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start, n = (_longs(b.column(k)) for k in range(3))
            order, found, cuts = _pack.by_part(_doc_part(doc, parts))
            yield _block([(int(part), FACTORS, _packed([doc[order[x:y]], start[order[x:y]], n[order[x:y]]])) for part, x, y in zip(found, cuts[:-1], cuts[1:], strict=True)])

    return run


def _texts(parts: int):
    """Documents, dealt as factors are, in compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=16 << 20):
                order, found, cuts = _pack.by_part(_doc_part(_longs(b.column(0)), parts))
                out = []
                for part, a, e in zip(found, cuts[:-1], cuts[1:], strict=True):
                    sink = pa.BufferOutputStream()
                    rows = b.take(pa.array(order[a:e]))
                    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as to:
                        to.write_batch(rows)
                    out.append((int(part), TEXTS, sink.getvalue().to_pybytes()))
                yield _block(out)

    return run


def _covered(first: np.ndarray, ids: np.ndarray, n_words: int, doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words of the batch lie in factors; these are sorted by doc."""
    lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
    n = hi - lo
    at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    begin = np.repeat(first[:-1], n) + start[at]
    edge = np.bincount(begin, minlength=n_words + 1) - np.bincount(begin + length[at], minlength=n_words + 1)
    return np.cumsum(edge[:n_words]) > 0


def _cut(texts: bool):
    """Documents with their factors: what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            for part, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != now:
                    now, held, ready = part, [], None
                if kind == FACTORS:
                    held.append(_unpacked(data.as_py(), 3))
                    continue
                if ready is None:
                    spans = [np.concatenate([np.zeros(0, np.int64), *(x[k] for x in held)]) for k in range(3)]
                    order = np.argsort(spans[0], kind="stable")
                    ready, held = tuple(c[order] for c in spans), []
                for block in pa.ipc.open_stream(data.as_buffer()):
                    for b in slices(block):
                        yield _kept(b, ready, texts)

    return run


def _kept(b: pa.RecordBatch, spans: tuple[np.ndarray, ...], texts: bool) -> pa.RecordBatch:
    raw = b.column(1).cast(pa.large_string()).fill_null("")
    lists = [bytes(x.as_buffer()).split() for x in raw]
    n = np.array([len(x) for x in lists], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    gone = _covered(first, _longs(b.column(0)), int(first[-1]), *spans)
    removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) * (n > 0) if len(n) else n
    out = []
    for i, x in enumerate(lists):
        out.append(b" ".join(compress(x, ~gone[first[i] : first[i + 1]]) if removed[i] else x))
    cols = [b.column(2), pa.array(n), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in out])]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if texts:
        cols, names = [*cols, pa.array(out, pa.binary()).cast(pa.string())], [*names, "kept_text"]
    return pa.RecordBatch.from_arrays(cols, names)


def remove_repeats(docs: DataFrame, length: int = 20, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every row of docs.

    Four shuffles of packed blocks: windows by hash, references and then factors by document, texts by document. The number
    of blocks is spark.sql.shuffle.partitions, which grows with the data, and a task holds one block at a time.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = with_order(docs, F.col(key), F.col(text).alias("text"), F.col(key).cast("long").alias("doc_id"))
    found = factors_of(d.select(ID, "text"), length)
    dealt = found.mapInArrow(_spans(n), _SCHEMA).unionByName(d.mapInArrow(_texts(n), _SCHEMA)).repartition(n, "part").sortWithinPartitions("part", "kind")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return dealt.mapInArrow(_cut(texts), schema)
