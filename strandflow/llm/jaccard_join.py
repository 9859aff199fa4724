"""Similarity join on shingle sets by count vectors.

Shingles hash into groups, and a document is the point of its group counts. sum(min(count_a, count_b)) bounds the
overlap of two sets from above, so points whose bound is too small for the similarity cannot link. Points meet where
they can: sets that reach the similarity differ in at most t shingles, so of more than t groups at least one is the
same in both (its count and its content); a key per group deals the points, and no pair is lost. Groups that are
empty may be the only ones that agree; a document with that many of them is dealt by its smallest shingles as well.

1. One scan makes classes (equal sets are one class), their points and keys, packed; a reduce task keeps the keys of two or
   more classes. Classes that share a key are a name; equal names are one.
2. Names that lie mostly in the largest name of their members become one block with it, so a group of near copies, which shares
   hundreds of keys, meets once and not hundreds of times.
3. In a block an R-tree over the points (leaves packed by size, boxes bounded by their upper corners) finds the pairs whose bound
   suffices: over folded points first, which only tells which points have any; these are searched again with all their groups.
   No pairs are given out, but one edge a point at most that keeps together what near pairs connect. The components of
   these edges hold every pair that may link, and every class is in one of them at most.
4. In a component the near pairs that are not yet connected are verified on the shingles of both texts and joined if they link, so
   a group of near copies is joined by about as many links as it has members. The links' components are the result.

Blocks of more than MOST points or LONG shingles are dealt in chunks, and every two chunks are one task, so no task holds a hot
block.

Defined results: null or empty text has an empty set and links with nothing; fewer words than a shingle are one shingle;
classes are the nodes, so rows that share a doc_id or have none belong to the component of their own text; a component's id is
its least doc_id, null where no row has one; repeated rows are rows; an empty table gives no rows; other columns, whatever
their names, are not read. Classes are named by 64 bits of their shingles' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import _bloom, _pack
from strandflow.llm._graph import components
from strandflow.llm._store import drop, written
from strandflow.llm._text import binaries, grams, mix, slices, words

NONE = 2**63 - 1
KEY_BYTES = 5
KEYS, SKETCH = 0, 1
#: Points and shingles of one chunk of a block; any numbers give the same result.
MOST, LONG = 4096, 4 << 20


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): the distinct shingle hashes of text i, ascending, are hashes[cuts[i]:cuts[i+1]]."""
    w = words(texts, lower=True)
    g, sets = grams(w, size), []
    for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        if b - a >= size:
            h = np.sort(g[a : b - size + 1])
            keep = np.ones(len(h), dtype=bool)
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            sets.append(h[keep])
        elif b > a:
            name = np.array([b - a], dtype=np.uint64)
            for x in w.hashes[a:b]:
                name = mix(name * np.uint64(0x9E3779B97F4A7C15) + x)
            sets.append(name)
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def set_class(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, equal for equal sets."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(1)), dtype=np.uint64)))
    n = np.diff(cuts)
    return mix(total[cuts[1:]] - total[cuts[:-1]] + mix(n.astype(np.uint64)))


def most_apart(top: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles two linked sets can differ in if neither has more than `top`."""
    return 2 * top * (100 - percent) // (100 + percent)


def group_keys(h: np.ndarray, cuts: np.ndarray, percent: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owner): keys such that linked, unequal sets share one at least.

    Sets are dealt in classes of size [2^c, 2^(c+1)) by the larger of two; a set is the larger one in its own class and may be
    the smaller one in the next. A class with t as its greatest difference has t + 1 + e groups.
    """
    n = np.diff(cuts)
    keys, owners, prefix = [], [], np.zeros(len(n), dtype=bool)
    own = np.zeros(len(n), dtype=np.int64)
    own[n > 0] = np.floor(np.log2(n[n > 0])).astype(np.int64)
    widest = n * 100 // percent
    up = np.zeros(len(n), dtype=np.int64)
    up[n > 0] = np.floor(np.log2(widest[n > 0])).astype(np.int64)
    for c, takes in ((own, n > 0), (own + 1, (n > 0) & (up > own))):
        t = most_apart((np.int64(2) << c) - 1, percent)
        spare = -(-(t + 1) * 14 // 100)
        m = t + 1 + spare
        rows = np.flatnonzero(takes & (t > 0))
        if not len(rows):
            continue
        lens = n[rows]
        who = np.repeat(rows, lens)
        at = np.repeat(cuts[rows] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        x = h[at]
        g = ((x >> np.uint64(32)) * m[who].astype(np.uint64)) >> np.uint64(32)
        head = np.ones(len(x), dtype=bool)
        head[1:] = (who[1:] != who[:-1]) | (g[1:] != g[:-1])
        starts = np.flatnonzero(head)
        content = np.add.reduceat(mix(x + np.uint64(3)), starts)
        names = mix(g[starts] + (c[who[starts]].astype(np.uint64) << np.uint64(40)) + np.uint64(7))
        keys.append(mix(content + names))
        owners.append(who[starts])
        filled = np.bincount(who[starts], minlength=len(n))
        prefix[rows] |= (m - filled)[rows] > spare[rows]
    rows = np.flatnonzero(prefix)
    if len(rows):
        lens = n[rows] - -(-n[rows] * percent // 100) + 1
        at = np.repeat(cuts[rows] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        keys.append(mix(h[at] + np.uint64(11)))
        owners.append(np.repeat(rows, lens))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def groups_for(n: int) -> int:
    """How many groups a set of n shingles has: one or two shingles a group, so that unlike sets have unlike counts."""
    return max(64, 1 << (max(n, 1).bit_length() - 1))


def count_vector(h: np.ndarray) -> bytes:
    """The point: a flag, then how many shingles fall into each group, two groups a byte. Flag 1: a count is too large, so the point bounds nothing."""
    groups = groups_for(len(h))
    counts = np.bincount((mix(h + np.uint64(5)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    if counts.max() > 15:
        return b"\x01" + bytes(groups // 2)
    c = counts.astype(np.uint8)
    return b"\x00" + (c[0::2] | (c[1::2] << 4)).tobytes()


def point(packed: bytes) -> np.ndarray:
    """Counts by group; 255 everywhere for a point that bounds nothing."""
    raw = np.frombuffer(packed, np.uint8, offset=1)
    if packed[0] == 2:
        return raw.astype(np.uint16)
    if packed[0]:
        return np.full(2 * len(raw), 255, np.uint16)
    out = np.empty(2 * len(raw), np.uint16)
    out[0::2], out[1::2] = raw & 15, raw >> 4
    return out


def coarse(packed: bytes) -> bytes:
    """The point folded to an eighth of its groups, a byte each (flag 2)."""
    p = point(packed)
    p = folded(p[None], max(64, len(p) // 8))[0]
    return b"\x02" + np.minimum(p, 255).astype(np.uint8).tobytes() if packed[0] == 0 and p.max() < 256 else b"\x01" + bytes(len(p) // 2)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points (rows) over fewer groups: groups that agree modulo the new number are added."""
    return points.reshape(len(points), -1, groups).sum(axis=1, dtype=np.uint16)


def enough(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of these sizes link."""
    return -(-(n_a + n_b) * percent // (100 + percent))


class CountRTree:
    """Points in order of size, packed into leaves of `fan` and leaves into nodes; a box is known by its upper corner and its sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 32):
        self.points, self.sizes, self.fan = points, sizes, fan
        cut = np.arange(0, len(sizes), fan)
        self.leaf_top = np.maximum.reduceat(points, cut, axis=0) if len(cut) else points
        self.leaf_lo, self.leaf_hi = sizes[cut], sizes[np.minimum(cut + fan, len(sizes)) - 1]
        cut = np.arange(0, len(self.leaf_lo), fan)
        self.node_top = np.maximum.reduceat(self.leaf_top, cut, axis=0) if len(cut) else points
        self.node_lo, self.node_hi = self.leaf_lo[cut], self.leaf_hi[np.minimum(cut + fan, len(self.leaf_lo)) - 1]

    def search(self, point: np.ndarray, size: int, percent: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(places from `first` on, bounds) of points whose summed coordinate minima allow a link."""

        def passing(at, top, lo, hi):
            at = at[(lo[at] * percent <= size * 100) & (size * percent <= hi[at] * 100)]
            bound = np.minimum(top[at], point).sum(axis=1, dtype=np.int64)
            ok = bound >= enough(np.maximum(lo[at], -(-size * percent // 100)), size, percent)
            return at[ok], bound[ok]

        def below(at, count):
            at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
            return at[at < count]

        if len(self.sizes) <= 2 * self.fan:
            at = np.arange(first, len(self.sizes))
        else:
            nodes, _ = passing(np.arange(first // self.fan**2, len(self.node_lo)), self.node_top, self.node_lo, self.node_hi)
            leaves, _ = passing(below(nodes, len(self.leaf_lo)), self.leaf_top, self.leaf_lo, self.leaf_hi)
            at = below(leaves, len(self.sizes))
        return passing(at[at >= first], self.points, self.sizes, self.sizes)


def near_points(sizes: np.ndarray, packed: list[bytes], percent: int, side: np.ndarray, comp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, places j after i, bounds) of the points in order of size whose bound allows a link; only points of other components, and of the other side where there are two."""
    points = [point(x) for x in packed]
    groups = np.array([len(x) for x in points])
    two = side.any()
    for g in np.unique(groups):
        # Larger sets have as many groups or more, so a pair is judged at the number of groups of its smaller set.
        lo = int(np.searchsorted(groups, g))
        fine = np.vstack([folded(x[None], g) for x in points[lo:]])
        tree = CountRTree(folded(fine, 64) if g > 64 else fine, sizes[lo:])
        for i in range(lo, int(np.searchsorted(groups, g, "right"))):
            j, bound = tree.search(tree.points[i - lo], int(sizes[i]), percent, i - lo + 1)
            ok = comp[lo + j] != comp[i]
            if two:
                ok &= side[lo + j] != side[i]
            j, bound = j[ok], bound[ok]
            if len(j) and g > 64:
                bound = np.minimum(fine[j], fine[i - lo]).sum(axis=1, dtype=np.int64)
                ok = bound >= enough(sizes[lo + j], int(sizes[i]), percent)
                j, bound = j[ok], bound[ok]
            if len(j):
                yield i, lo + j, bound


def _ids(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False)


def _i64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _scan(size: int, percent: int, parts: int, most: int = 1 << 20):
    """Map side: keys by part, sorted by class so that a class is named once a part, one set of keys per class and flush; and the sketch rows with the points."""

    def flush(held):
        key, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        order, found, cuts = _pack.by_part(_pack.parts_of(key, parts))
        for part, a, b in zip(found, cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            head = np.flatnonzero(np.append(True, cls[at[1:]] != cls[at[:-1]]))
            run = np.diff(np.append(head, len(at)))
            yield int(part), KEYS, np.array([b - a, len(head)]).tobytes() + cls[at[head]].tobytes() + _pack.planes(run, False) + _pack.hashes(key[at], KEY_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen, turn = [], 0, set(), 0
        for batch in batches:
            for b in slices(batch):
                h, cuts = shingle_sets(b.column(1), size)
                n, cls = np.diff(cuts), set_class(h, cuts)
                keys, owner = group_keys(h, cuts, percent)
                fresh = np.zeros(len(n), dtype=bool)
                _, first = np.unique(cls, return_index=True)
                fresh[[i for i in first if int(cls[i]) not in seen]] = True
                seen.update(cls[fresh].tolist())
                on = np.flatnonzero(fresh[owner])
                on = on[np.argsort(owner[on], kind="stable")]
                held.append((keys[on], cls[owner[on]]))
                count += len(on)
                turn += 1
                points = [count_vector(h[x:y]) if k and y > x else b"" for x, y, k in zip(cuts[:-1], cuts[1:], fresh, strict=True)]
                lens = np.array([len(x) for x in points])
                sketch = np.int64(len(n)).tobytes() + _pack.planes(_ids(b.column(0))) + _pack.planes(n, False) + _pack.planes(lens, False) + cls.tobytes() + b"".join(points)
                out = [(turn % parts, SKETCH, sketch)]
                if count >= most:
                    out += flush(held)
                    held, count = [], 0
                yield _rows(out)
        if count:
            yield _rows(list(flush(held)))

    return run


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "data"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: (kind, a, b, c, point). Keys of several classes give (KEYS, name, class, 0); sketches give (SKETCH, id, class, size) and the point once a class and task."""

    def out(kind, a, b, c, points=None):
        points = pa.nulls(len(a), pa.binary()) if points is None else points
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c), points], ["kind", "a", "b", "c", "point"])

    def unpacked(view):
        n, classes = np.frombuffer(view, dtype=np.int64, count=2)
        cls = np.frombuffer(view, dtype=np.uint64, count=classes, offset=16)
        run, used = _pack.unplanes(view[16 + 8 * classes :], classes, False)
        return _pack.unhashes(view[16 + 8 * classes + used :], n, KEY_BYTES), np.repeat(cls, run)

    def settle(held):
        key, cls = (np.concatenate(x) for x in zip(*map(unpacked, held), strict=True))
        order = np.argsort(key)
        s = key[order]
        again = np.zeros(len(s), dtype=bool)
        again[1:] = s[1:] == s[:-1]
        again[:-1] |= again[1:].copy()
        order = order[again]
        order = order[np.lexsort((cls[order], key[order]))]
        k, c = key[order], cls[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c = k[new], c[new]
        if not len(k):
            return
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        lens = np.diff(np.append(starts, len(k)))
        name = mix(np.add.reduceat(mix(c + np.uint64(9)), starts) + mix(lens.astype(np.uint64)))
        _, first = np.unique(name, return_index=True)
        first = first[lens[first] > 1]
        if len(first):
            at = np.repeat(starts[first] - np.concatenate(([0], np.cumsum(lens[first])[:-1])), lens[first]) + np.arange(lens[first].sum())
            yield out(KEYS, _i64(np.repeat(name[first], lens[first])), _i64(c[at]), np.zeros(len(at), np.int64))

    def sketch(view):
        n = int(np.frombuffer(view, dtype=np.int64, count=1)[0])
        ids, at = _pack.unplanes(view[8:], n)
        size, more = _pack.unplanes(view[8 + at :], n, False)
        at += 8 + more
        lens, more = _pack.unplanes(view[at:], n, False)
        at += more
        cls = np.frombuffer(view, dtype=np.int64, count=n, offset=at)
        points = binaries(np.frombuffer(view, dtype=np.uint8, offset=at + 8 * n), np.concatenate(([0], np.cumsum(lens))))
        return out(SKETCH, ids, cls, size, points)

    held, now = [], None
    for b in batches:
        for part, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            view = memoryview(data.as_py())
            if kind == SKETCH:
                yield sketch(view)
                continue
            if part != now and held:
                yield from settle(held)
                held = []
            now = part
            held.append(view)
    if held:
        yield from settle(held)


def blocks(names: DataFrame) -> DataFrame:
    """(block, node) from (name, node): a name that lies for two thirds or more in the home (the largest name) of its members joins it. Every name is inside a block."""
    sized = names.join(names.groupBy("name").agg(F.count("*").alias("size")), "name")
    home = sized.groupBy("node").agg(F.max(F.struct("size", "name")).getField("name").alias("home"))
    votes = sized.join(home, "node").groupBy("name", "home").agg(F.count("*").alias("k"), F.max("size").alias("size"))
    best = votes.groupBy("name").agg(F.max(F.struct("k", "home")).alias("v"), F.max("size").alias("size"))
    to = best.select("name", F.when(F.col("v.k") * 3 >= F.col("size") * 2, F.col("v.home")).otherwise(F.col("name")).alias("block"))
    return names.join(to, "name").select("block", "node").distinct()


def chunked(members: DataFrame) -> DataFrame:
    """members (block, node, n, ...) with `part` and `side`: a block is one part; of a larger one every two chunks are, the second as side 1."""
    chunks = F.ceil(F.greatest(F.count("*") / MOST, F.sum("n") / LONG)).cast("int")
    load = members.groupBy("block").agg(chunks.alias("c")).where("c > 1")
    m = members.join(load, "block", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("c")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    part = F.least("own", "other") * F.col("c") + F.greatest("own", "other")
    return m.select("block", part.alias("part"), (F.col("own") > F.col("other")).alias("side"), *[x for x in members.columns if x != "block"])


class Part:
    """The points of one part of a block, in order of size, a node once."""

    def __init__(self, rows: list[list]):
        side, node, n, packed, *rest = zip(*rows, strict=True)
        order = np.lexsort((np.array(node), np.array(n)))
        order = order[np.append(True, np.diff(np.array(node)[order]) != 0)]
        self.side, self.node, self.n = (np.array(c)[order] for c in (side, node, n))
        self.packed = [packed[i] for i in order]
        self.text = [rest[0][i] for i in order] if rest else []

    def near(self, percent: int, comp: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return near_points(self.n, self.packed, percent, self.side, np.arange(len(self.n)) if comp is None else comp)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Part]]:
    """Parts of two points or more from rows sorted by (block, part)."""
    now, rows = None, []
    for b in batches:
        for block, part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (block, part) != now:
                if len(rows) > 1:
                    yield *now, Part(rows)
                now, rows = (block, part), []
            rows.append(row)
    if len(rows) > 1:
        yield *now, Part(rows)


def _having_near(percent: int):
    """(block, part, side, node) of the points that have a near one in their part."""

    def run(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["block", "part", "side", "node"]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64()]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for block, part, points in _parts(batches):
            has = np.zeros(len(points.n), dtype=bool)
            for i, j, _ in points.near(percent):
                has[i] = True
                has[j] = True
            out += [(block, part, side, node) for side, node in zip(points.side[has].tolist(), points.node[has].tolist(), strict=True)]
            if len(out) >= most:
                yield flush()
                out = []
        if out:
            yield flush()

    return run


def _connected(percent: int):
    """Edges (a, b) that connect what near pairs connect in a part: a star for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, points in _parts(batches):
            label = np.arange(len(points.n))
            for i, j, _ in points.near(percent):
                label[np.isin(label, label[j])] = label[i]
            yield _stars(points.node, label)

    return run


def _stars(node: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """(a, b): every node with the least one of its label."""
    order = np.lexsort((node, label))
    new = np.append(True, np.diff(label[order]) != 0)
    least = node[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return pa.RecordBatch.from_arrays([pa.array(least[~new]), pa.array(node[order][~new])], ["a", "b"])


def _with_coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("coarse", pa.array([coarse(x.as_py()) for x in b.column(2)], pa.binary()))


def _rep_name(ids: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return cls.view(np.uint64) ^ mix(ids.view(np.uint64))


def _texts(size: int, bits):
    """Scan: the texts of wanted representatives, once a task and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in slices(batch):
                h, cuts = shingle_sets(b.column(1), size)
                cls = set_class(h, cuts)
                rows = np.flatnonzero(_bloom.has(bits.value, _rep_name(_ids(b.column(0)), cls)) & (np.diff(cuts) > 0))
                rows = rows[np.sort(np.unique(cls[rows], return_index=True)[1])]
                rows = rows[[int(x) not in seen for x in cls[rows]]] if len(rows) else rows
                seen.update(cls[rows].tolist())
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(_i64(cls[rows])), b.column(1).take(pa.array(rows)).cast(pa.string())], ["node", "text"])

    return run


def full_shingles(text: str, size: int) -> set:
    """The distinct shingles themselves."""
    w = text.encode().lower().split()
    return set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else {tuple(w)} if w else set()


def linked(s: set, t: set, percent: int) -> bool:
    if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
        return False
    both = len(s & t)
    return both * 100 >= percent * (len(s) + len(t) - both)


def _join_near(size: int, percent: int):
    """Links (a, b) within parts: every near pair is verified unless links connect it already; the links of a component are a star."""

    def joined(points: Part) -> pa.RecordBatch:
        h, cuts = shingle_sets(pa.array(points.text, pa.large_string()), size)
        sets = [h[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        label = np.arange(len(sets))
        for i, near, bound in points.near(percent):
            full = None
            for j in near[np.argsort(-bound / (points.n[near] + points.n[i]), kind="stable")]:
                if label[i] == label[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                    full = full or full_shingles(points.text[i], size)
                    if linked(full, full_shingles(points.text[j], size), percent):
                        label[label == label[j]] = label[i]
        return _stars(points.node, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, points in _parts(batches):
            yield joined(points)

    return run


def _class_links(members: DataFrame, points: DataFrame, d: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect what the similarity connects, written. members: (block, node), points: (node, n, point, coarse)."""

    def dealt(rows: DataFrame, *data: str) -> DataFrame:
        rows = rows.select("block", "part", "side", "node", "n", *data)
        return rows.repartition(F.col("block"), F.col("part")).sortWithinPartitions("block", "part")

    rows = chunked(members.join(points.select("node", "n", "coarse"), "node"))
    having = written(dealt(rows, "coarse").mapInArrow(_having_near(percent), "block long, part int, side boolean, node long"), "having")
    rows = having.join(points.select("node", "n", "point"), "node")
    edges = written(dealt(rows, "point").mapInArrow(_connected(percent), "a long, b long").distinct(), "edges")
    groups = components(edges).select(F.col("label").alias("block"), "node")
    wanted = d.sparkSession.sparkContext.broadcast(_bloom.build(reps.join(groups.select(F.col("node").alias("cls")), "cls").select("doc_id", "cls"), _rep_name))
    texts = written(d.mapInArrow(_texts(size, wanted), "node long, text string"), "texts")
    rows = chunked(groups.join(points.select("node", "n", "point"), "node")).join(texts, "node")
    links = written(dealt(rows, "point", "text").mapInArrow(_join_near(size, percent), "a long, b long").distinct(), "links")
    drop(having, edges, texts)
    return links


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = d.mapInArrow(_scan(size, percent, shuffle), "part int, kind int, data binary").repartition(shuffle, "part").sortWithinPartitions("part")
    found = written(keyed.mapInArrow(_shared, "kind int, a long, b long, c long, point binary"), "shared")
    rows = found.where(f"kind = {SKETCH}").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), F.col("c").alias("n"), "point")
    sketch = rows.drop("point")
    names = written(found.where(f"kind = {KEYS}").select(F.col("a").alias("name"), F.col("b").alias("node")).distinct(), "names")
    members = written(blocks(names), "blocks")
    points = rows.where("length(point) > 0").join(members.select(F.col("node").alias("cls")).distinct(), "cls", "left_semi").select(F.col("cls").alias("node"), "n", "point").dropDuplicates(["node"])
    points = written(points.mapInArrow(_with_coarse, "node long, n long, point binary, coarse binary"), "points")
    reps = sketch.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    links = _class_links(members, points, d, reps, size, percent)
    label = written(reps.join(components(links).withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("label")), "classes")
    drop(names, members, points)
    least = label.groupBy("label").agg(F.min("doc_id").alias("least"))
    label = label.join(least, "label").select("cls", "least")
    out = sketch.where("n > 0").join(label, "cls").select("doc_id", "n", "least").unionByName(sketch.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("least")))
    null = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return out.select(null("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), null("least").alias("component_id"))
