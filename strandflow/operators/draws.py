"""Draws by hash, in arrays: permutations, shuffles and bootstrapped statistics without a row for each replicate and frame.

What a replicate draws at a place is HASH32 of `seed|replicate|place`, the same numbers as in the statements for the check. Spark deals the frames to blocks; a
task hashes its block's places for all replicates and sends on packed numbers: sums, and only what other tasks must order or look up. No task holds a whole
replicate's order or a whole run: permutations are cut at a threshold near which alone places are ordered (all places of one replicate, where it lies elsewhere), shuffles are
ordered in ranges of the hash and meet the series in tiles of two blocks, bootstrapped places go to the block that they pick. A run has one row for each frame.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.plans.op import Op
from strandflow.store import written

_MASK = 0xFFFFFFFF
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
#: Hashes made at a time, replicates that share a row, partitions of blocks, and the least and most frames of a block.
AT_ONCE, CHUNK, DEALT, LEAST, MOST = 32_768, 100, 192, 512, 16_384


class Hashes:
    """HASH32 of a prefix and each of some numbers from 0 on: MD5 over arrays, one block of 64 bytes a number."""

    def __init__(self, numbers: np.ndarray):
        self.n, self.held = len(numbers), {}
        digits = np.searchsorted(10 ** np.arange(1, 19), numbers, side="right") + 1
        self.groups = [(int(d), np.flatnonzero(digits == d), numbers[digits == d]) for d in np.unique(digits)]

    def _tail(self, at: int, d: int, numbers: np.ndarray) -> np.ndarray:
        if (at, d) not in self.held:
            if at + d > 55:
                raise ValueError("the text to hash is longer than 55 bytes")
            text = np.zeros((len(numbers), 64), np.uint8)
            for k in range(d):
                text[:, at + d - 1 - k] = numbers // 10**k % 10 + 48
            text[:, at + d] = 128
            text[:, 56:58] = (8 * (at + d)) & 255, 8 * (at + d) >> 8
            self.held[at, d] = np.ascontiguousarray(text.view("<u4").T)
        return self.held[at, d]

    def __call__(self, prefixes: list[bytes]) -> np.ndarray:
        """(prefixes) x (numbers), 32 bits each; prefixes of one length."""
        out, at = np.empty((len(prefixes), self.n), np.uint32), len(prefixes[0])
        head = np.frombuffer(b"".join(p.ljust(64, b"\0") for p in prefixes), "<u4").reshape(-1, 16)
        for d, where, numbers in self.groups:
            tail, words = self._tail(at, d, numbers), []
            for k in range(16):
                if k < at // 4:
                    words.append(head[:, k : k + 1])
                elif k <= (at + d) // 4:
                    words.append(tail[None, k] | head[:, k : k + 1])
                else:
                    words.append(int(tail[k, 0]))
            out[:, where] = self._first(words, (len(prefixes), len(where)))
        return out

    @staticmethod
    def _first(words: list, shape: tuple[int, int]) -> np.ndarray:
        """The first four bytes of the digest: the last three steps do not reach them."""
        a, b, c, d = (np.full(shape, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        t, u = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
        for i in range(61):
            if i < 16:
                np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
            elif i < 32:
                np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
            elif i < 48:
                np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
            else:
                np.invert(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
            t += a
            word, turn = words[_WORDS[i]], _TURNS[i // 16][i % 4]
            if isinstance(word, int):
                t += np.uint32((word + _SINES[i]) & _MASK)
            else:
                t += word
                t += np.uint32(_SINES[i])
            np.right_shift(t, np.uint32(32 - turn), out=u)
            np.left_shift(t, np.uint32(turn), out=t)
            t |= u
            t += b
            a, b, c, d, t = d, t, b, c, a
        b += np.uint32(0x67452301)
        return b.byteswap()


def _batches(reps: list[int], width: int) -> Iterator[tuple[slice, list[bytes]]]:
    """(places in reps, their digits) of runs of replicates with as many digits."""
    lo = 0
    for hi in range(1, len(reps) + 1):
        if hi == len(reps) or hi - lo == width or len(str(reps[hi])) != len(str(reps[lo])):
            yield slice(lo, hi), [str(r).encode() for r in reps[lo:hi]]
            lo = hi


def _hashed(seed: int, reps: list[int], hashes: list[Hashes]) -> Iterator[tuple[slice, list[np.ndarray]]]:
    for part, names in _batches(reps, max(1, AT_ONCE // max(1, hashes[0].n))):
        yield part, [h([f"{seed}|".encode() + r + b"|" for r in names]) for h in hashes]


def _chunks(reps: list[int]) -> list[list[int]]:
    return [reps[k : k + CHUNK] for k in range(0, len(reps), CHUNK)]


def _blocks(series: DataFrame, size: int | None) -> tuple[DataFrame, int, int, int]:
    """(rows (blk, place, run_id, v) by blk, number of frames, places, frames of a block); a place is a frame's distance to the first one."""
    lo, hi, n = series.agg(F.min("frame"), F.max("frame"), F.count_distinct("frame")).first()
    span = 0 if lo is None else hi - lo + 1
    if span + n > _MASK:
        raise ValueError("places must fit 32 bits")
    size = size or min(max(LEAST, -(-span // 96)), MOST)
    place = F.col("frame").cast("long") - F.lit(lo or 0).cast("long")
    rows = series.select(F.floor(place / size).cast("int").alias("blk"), place.alias("place"), F.col("run_id").cast("string").alias("run_id"), F.col("v").cast("double").alias("v"))
    return rows.repartition(DEALT, "blk"), n, span, size


def _runs(table: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, pa.ChunkedArray]:
    """(runs, places there, and for each row its run, its place's rank and its value)."""
    runs = sorted(set(table["run_id"].to_pylist()))
    code = {r: k for k, r in enumerate(runs)}
    places, rank = np.unique(table["place"].to_numpy(), return_inverse=True)
    return runs, places, np.array([code[r] for r in table["run_id"].to_pylist()], dtype=int), rank, table["v"]


def _columns(runs: int, frames: int, run: np.ndarray, rank: np.ndarray, v: pa.ChunkedArray) -> np.ndarray:
    """(frames) x (3 or 6, runs): finite values, whether known, whether there; and, if there are any, NaN, inf and -inf."""
    x, known = v.fill_null(0.0).to_numpy(), ~v.is_null().to_numpy()
    odd = ~np.isfinite(x)
    kinds = [np.where(odd, 0.0, x), known, np.ones(len(x))] + ([np.isnan(x), x == np.inf, x == -np.inf] if odd.any() else [])
    out = np.zeros((frames, len(kinds), runs))
    for k, what in enumerate(kinds):
        np.add.at(out, (rank, k, run), what.astype(float))
    return out


def _folded(sums: np.ndarray) -> np.ndarray:
    """(..., 3 or 6, runs) to (..., 3, runs): NaN and infinities enter the sums that they are in."""
    out = sums[..., :3, :].copy()
    with np.errstate(invalid="ignore"):
        for k, value in zip(range(3, sums.shape[-2]), (np.nan, np.inf, -np.inf), strict=False):
            out[..., 0, :] += np.where(sums[..., k, :] > 0, value, 0.0)
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)}, schema=schema)


def _kind(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _schema(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, sums) put together."""

    def run(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s) for s in table["sums"].to_pylist()], axis=0)
        return pa.table({**{k: table[k][:1] for k in keys}, "sums": pa.array([total.tobytes()], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(run, rows.select(*keys, "sums").schema)


def _least(c: np.ndarray, limit) -> np.ndarray:
    """c >= limit with NaN above all numbers, as the engines have it."""
    return (c >= limit) | np.isnan(c)


def _most(c: np.ndarray, limit) -> np.ndarray:
    return (c <= limit) | np.isnan(limit)


_PARTS = _schema(blk=pa.int32(), chunk=pa.int32(), sums=pa.binary(), below=pa.binary(), counts=pa.binary(), keys=pa.binary())
_CUTS = _schema(chunk=pa.int32(), cut=pa.binary(), found=pa.binary())
_DEALT = _schema(chunk=pa.int32(), run_id=pa.string(), sums=pa.binary())
_PAIRS = _schema(i=pa.string(), j=pa.string(), observed=pa.float64(), two=pa.int64(), greater=pa.int64(), less=pa.int64(), n=pa.int64())


def _dealt(rows: DataFrame, n: int, seed: int, chunks: list[list[int]], bounds: tuple[int, int]) -> tuple[DataFrame, list[int]]:
    """(rows (chunk, run_id, sums (replicate, side, sum / known / there)), replicates whose n-th place lies outside the bounds of the hash).

    Of the 2n places those with the n lowest (hash, place) are dealt. Below the bounds all are, so their values are added up at once; between them keys are kept
    (about sqrt(n) a replicate), the n-th place is found from the keys of all blocks, and blocks add what lies up to it.
    """

    def hashed(table: pa.Table) -> pa.Table:
        runs, places, run, rank, v = _runs(table)
        x = _columns(len(runs), len(places), run, rank, v)
        wide, sides, out = x.reshape(len(places), -1), [Hashes(places + side * n) for side in (0, 1)], []
        for chunk, reps in enumerate(chunks):
            sums, below, counts, keys = np.zeros((len(reps), 2, wide.shape[1])), np.zeros(len(reps), np.int64), np.zeros((len(reps), 2), np.int64), []
            for part, hs in _hashed(seed, reps, sides):
                kept = []
                for side, h in enumerate(hs):
                    low = h < bounds[0]
                    sums[part, side] = low.astype(float) @ wide
                    below[part] += low.sum(1)
                    rep, at = np.nonzero(~low & (h < bounds[1]))
                    counts[part, side] = np.bincount(rep, minlength=len(h))
                    kept.append(np.split((h[rep, at].astype(np.uint64) << np.uint64(32)) | (places[at] + side * n).astype(np.uint64), np.cumsum(np.bincount(rep, minlength=len(h)))[:-1]))
                keys += [k for both in zip(*kept, strict=True) for k in both]
            out.append((int(table["blk"][0].as_py()), chunk, sums.tobytes(), below.tobytes(), counts.tobytes(), np.concatenate(keys).tobytes()))
        return _table(out, _PARTS)

    def cut(table: pa.Table) -> pa.Table:
        held = [(np.frombuffer(r["counts"], np.int64).reshape(-1, 2).sum(1), np.frombuffer(r["keys"], np.uint64)) for r in table.to_pylist()]
        want = n - np.sum([np.frombuffer(b, np.int64) for b in table["below"].to_pylist()], axis=0)
        found, last = np.zeros(len(want), bool), np.zeros(len(want), np.uint64)
        ends = [np.concatenate(([0], np.cumsum(c))) for c, _ in held]
        for k, r in enumerate(want):
            own = np.concatenate([keys[e[k] : e[k + 1]] for (_, keys), e in zip(held, ends, strict=True)])
            found[k] = 0 <= r <= len(own)
            if found[k] and r:
                last[k] = np.partition(own, r - 1)[r - 1] + np.uint64(1)
        return _table([(table["chunk"][0].as_py(), last.tobytes(), found.tobytes())], _CUTS)

    def summed(table: pa.Table, parts: pa.Table) -> pa.Table:
        runs, places, run, rank, v = _runs(table)
        x = _columns(len(runs), len(places), run, rank, v)
        wide, out = x.reshape(len(places), -1), []
        for r in parts.to_pylist():
            counts, keys, last, found = np.frombuffer(r["counts"], np.int64), np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["cut"], np.uint64), np.frombuffer(r["found"], bool)
            sums = np.frombuffer(r["sums"]).reshape(len(counts), -1).copy()
            seat = np.repeat(np.arange(len(counts)), counts)
            kept = keys < last[seat // 2]
            seat, at = seat[kept], np.searchsorted(places, (keys[kept] & np.uint64(_MASK)).astype(np.int64) - n * (seat[kept] % 2))
            first = np.flatnonzero(np.diff(seat, prepend=-1))
            if len(seat):
                sums[seat[first]] += np.add.reduceat(wide[at], first, axis=0)
            sums = _folded(sums.reshape(len(found), 2, -1, len(runs)))
            sums[~found] = 0.0
            out += [(r["chunk"], name, np.ascontiguousarray(sums[..., k]).tobytes()) for k, name in enumerate(runs)]
        return _table(out, _DEALT)

    parts = written(rows.groupBy("blk").applyInArrow(hashed, _kind(_PARTS)), "dealt")
    cuts = written(parts.select("chunk", "below", "counts", "keys").groupBy("chunk").applyInArrow(cut, _kind(_CUTS)), "cuts")
    missed = [rep for r in cuts.select("chunk", "found").collect() for rep, ok in zip(chunks[r.chunk], np.frombuffer(r.found, bool), strict=True) if not ok]  # a byte for each replicate
    both = parts.drop("below").join(F.broadcast(cuts), "chunk").repartition(DEALT, "blk")  # a few bytes for each replicate
    return _added(rows.groupBy("blk").cogroup(both.groupBy("blk")).applyInArrow(summed, _kind(_DEALT)), "chunk", "run_id"), missed


def permutation(series: DataFrame, seed: int = 42, reps: int = 10000, size: int | None = None, reach: float = 6.0) -> DataFrame:
    """(i, j, observed, p_two, p_greater, p_less): the places below the n-th hash of 2n, which lies within `reach` standard errors of the middle; else all places of the replicate are ordered."""
    rows, n, _, _ = _blocks(series, size)
    near = reach * 0.5 / math.sqrt(2 * max(n, 1))
    bounds = max(0, int(2**32 * (0.5 - near))), min(2**32, math.ceil(2**32 * (0.5 + near)))
    sums, missed = _dealt(rows, n, seed, _chunks(list(range(1, reps + 1))), bounds)
    if missed:
        again, _ = _dealt(rows, n, seed, [[r] for r in missed], (0, 2**32))
        sums = sums.unionByName(again.withColumn("chunk", -1 - F.col("chunk")))
    whole = series.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.sum(F.col("v").cast("double")).alias("total"), F.count("*").alias("rows"))

    def pairs(table: pa.Table) -> pa.Table:
        held, out = sorted(table.to_pylist(), key=lambda r: r["run_id"]), []
        sides = [np.frombuffer(r["sums"]).reshape(-1, 2, 3) for r in held]
        for k, x in enumerate(held):
            for y, b in zip(held[k + 1 :], (s[:, 1] for s in sides[k + 1 :]), strict=True):
                a, none = sides[k][:, 0], x["total"] is None or y["total"] is None
                there = (a[:, 2] > 0) & (b[:, 2] > 0)
                if none:
                    out.append((x["run_id"], y["run_id"], None, 0, 0, 0, int(there.sum())))
                    continue
                known = there & (a[:, 1] > 0) & (b[:, 1] > 0)
                with np.errstate(invalid="ignore"):
                    observed = np.float64(x["total"] - y["total"]) / x["rows"]
                    c = (2 * (a[:, 0] + b[:, 0]) - x["total"] - y["total"])[known] / x["rows"]
                    found = _least(np.abs(c), abs(observed) - 1e-9), _least(c, observed - 1e-9), _most(c, observed + 1e-9)
                out.append((x["run_id"], y["run_id"], float(observed), *(int(f.sum()) for f in found), int(there.sum())))
        return _table(out, _PAIRS)

    counted = sums.join(whole, "run_id").groupBy("chunk").applyInArrow(pairs, _kind(_PAIRS)).groupBy("i", "j")
    total = counted.agg(F.max("observed").alias("observed"), *[F.sum(c).alias(c) for c in ("two", "greater", "less", "n")])
    return total.where("n > 0").selectExpr("i", "j", "observed", "two / n AS p_two", "greater / n AS p_greater", "less / n AS p_less")


#: Places of a replicate that are ordered together; least and most frames of a tile's side.
SPAN, TILE = 16_384, (1024, 65_536)
_ORDERED = _schema(chunk=pa.int32(), part=pa.int32(), counts=pa.binary(), keys=pa.binary())
_TILES = _schema(a=pa.int32(), b=pa.int32(), chunk=pa.int32(), counts=pa.binary(), first=pa.binary(), later=pa.binary())
_STAT = _schema(rep=pa.int32(), run_id=pa.string(), c=pa.float64())
_OWN = Op(
    "own_lag_one",
    """
    SELECT x.run_id, sum((x.v - m.m) * (y.v - m.m)) / max(m.ss) AS c
    FROM {series} x JOIN {series} y ON y.run_id = x.run_id AND y.frame = x.frame + 1 JOIN {centre} m ON m.run_id = x.run_id GROUP BY x.run_id""",
)
_SHARES = Op(
    "null_shares",
    """
    SELECT s.run_id AS g, max(o.c) AS observed, avg(s.c) AS null_mean, avg(CASE WHEN abs(s.c) >= abs(o.c) - 1E-9 THEN 1.0E0 ELSE 0.0E0 END) AS p_two, avg(CASE WHEN s.c >= o.c - 1E-9 THEN 1.0E0 ELSE 0.0E0 END) AS p_greater,
        avg(CASE WHEN s.c <= o.c + 1E-9 THEN 1.0E0 ELSE 0.0E0 END) AS p_less, avg(CASE WHEN abs(s.c) >= abs(o.c) - 1E-9 THEN 1.0E0 ELSE 0.0E0 END) < 0.05 AS significant
    FROM {stat} s JOIN {own} o ON o.run_id = s.run_id GROUP BY s.run_id""",
)


def _followers(rows: DataFrame, n: int, seed: int, chunks: list[list[int]], span: int, tile: int) -> DataFrame:
    """(a, b, chunk, counts, first, later): for each replicate of a chunk, who follows whom in the order of (hash, place), by the tile of their blocks of `tile` frames.

    Places are dealt by ranges of the hash and ordered there; the last one of a range meets the first one of the next that has any.
    """
    ranges = max(1, -(-n // span))
    bounds = np.array([(k << 32) // ranges << 32 for k in range(1, ranges)], np.uint64)

    def hashed(table: pa.Table) -> pa.Table:
        places, out = np.unique(table["place"].to_numpy()), []
        hashes = [Hashes(places)]
        for chunk, reps in enumerate(chunks):
            keys = np.concatenate([(h.astype(np.uint64) << np.uint64(32)) | places.astype(np.uint64) for _, (h,) in _hashed(seed, reps, hashes)])
            keys.sort(axis=1)
            cuts = np.column_stack([np.zeros(len(reps), int), *[(keys < b).sum(1) for b in bounds], np.full(len(reps), len(places))])
            out += [(chunk, k, (cuts[:, k + 1] - cuts[:, k]).tobytes(), np.concatenate([own[x:y] for own, x, y in zip(keys, cuts[:, k], cuts[:, k + 1], strict=True)]).tobytes()) for k in range(ranges)]
        return _table(out, _ORDERED)

    def tiled(chunk: int, rep: np.ndarray, first: np.ndarray, later: np.ndarray) -> list[tuple]:
        a, b = first // tile, later // tile
        order = np.lexsort((rep, b, a))
        a, b, rep, first, later = a[order], b[order], rep[order], first[order] % tile, later[order] % tile
        cuts = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        counts = lambda x, y: np.bincount(rep[x:y], minlength=len(chunks[chunk])).tobytes()
        return [(int(a[x]), int(b[x]), chunk, counts(x, y), first[x:y].astype(np.uint16).tobytes(), later[x:y].astype(np.uint16).tobytes()) for x, y in zip(cuts, [*cuts[1:], len(a)][: len(cuts)], strict=True)]

    def ordered(table: pa.Table) -> pa.Table:
        chunk, part = table["chunk"][0].as_py(), table["part"][0].as_py()
        held = [(np.concatenate(([0], np.cumsum(np.frombuffer(r["counts"], np.int64)))), np.frombuffer(r["keys"], np.uint64)) for r in table.to_pylist()]
        ends, runs = np.full((2, len(chunks[chunk])), -1, np.int64), []
        for k in range(len(chunks[chunk])):
            own = np.sort(np.concatenate([keys[e[k] : e[k + 1]] for e, keys in held]))
            runs.append((own & np.uint64(_MASK)).astype(np.int64))
            if len(own):
                ends[:, k] = runs[-1][0], runs[-1][-1]
        rep = np.repeat(np.arange(len(runs)), [max(len(r) - 1, 0) for r in runs])
        return _table([(-1, part, chunk, b"", ends[0].tobytes(), ends[1].tobytes()), *tiled(chunk, rep, np.concatenate([r[:-1] for r in runs]), np.concatenate([r[1:] for r in runs]))], _TILES)

    def linked(table: pa.Table) -> pa.Table:
        held = sorted(table.to_pylist(), key=lambda r: r["b"])
        first, last = (np.stack([np.frombuffer(r[c], np.int64) for r in held]).T for c in ("first", "later"))
        there = [np.flatnonzero(f >= 0) for f in first]
        rep = np.repeat(np.arange(len(first)), [max(len(t) - 1, 0) for t in there])
        return _table(tiled(held[0]["chunk"], rep, np.concatenate([x[t[:-1]] for x, t in zip(last, there, strict=True)]), np.concatenate([x[t[1:]] for x, t in zip(first, there, strict=True)])), _TILES)

    parts = rows.select("blk", "place").groupBy("blk").applyInArrow(hashed, _kind(_ORDERED))
    made = written(parts.repartition(DEALT, "chunk", "part").groupBy("chunk", "part").applyInArrow(ordered, _kind(_TILES)), "followers")
    return made.where("a >= 0").unionByName(made.where("a < 0").groupBy("chunk").applyInArrow(linked, _kind(_TILES)))


def _tile_sides(values: DataFrame, tile: int, count: int) -> DataFrame:
    """(a, b, later, runs, vs, flags) of values (place, run_id, v): a block of `tile` frames as one matrix, for each tile that it is a side of; flags: there, known."""

    def packed(table: pa.Table) -> pa.Table:
        names = sorted(set(table["run_id"].to_pylist()))
        code = {r: k for k, r in enumerate(names)}
        at = table["place"].to_numpy() % tile, np.array([code[r] for r in table["run_id"].to_pylist()], dtype=int)
        vs, flags = np.zeros((tile, len(names))), np.zeros((tile, len(names)), np.uint8)
        vs[at], flags[at] = table["v"].fill_null(0.0).to_numpy(), 1 + 2 * ~table["v"].is_null().to_numpy()
        return pa.table({"blk": table["blk"][:1], "runs": pa.array([names], pa.list_(pa.string())), "vs": pa.array([vs.tobytes()], pa.binary()), "flags": pa.array([flags.tobytes()], pa.binary())})

    blocks = values.withColumn("blk", F.floor(F.col("place") / tile).cast("int")).groupBy("blk").applyInArrow(packed, "blk int, runs array<string>, vs binary, flags binary")
    held, others = written(blocks, "tile_sides"), F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = held.select(F.col("blk").alias("a"), others.alias("b"), F.lit(False).alias("later"), "runs", "vs", "flags")
    return own.unionByName(held.select(others.alias("a"), F.col("blk").alias("b"), F.lit(True).alias("later"), "runs", "vs", "flags"))


def null_p_value(series: DataFrame, seed: int = 42, reps: int = 1000, size: int | None = None, span: int = SPAN, tile: int | None = None) -> DataFrame:
    """(g, observed, null_mean, p_two, p_greater, p_less, significant): who follows whom in a shuffle goes, as two numbers, to the tile that holds the values of both."""
    rows, n, places, _ = _blocks(series, size)
    chunks, tile = _chunks(list(range(1, reps + 1))), tile or min(max(TILE[0], -(-places // 8)), TILE[1])
    series = series.select(F.col("run_id").cast("string").alias("run_id"), "frame", F.col("v").cast("double").alias("v"))
    centre = written(series.groupBy("run_id").agg(F.avg("v").alias("m"), (F.var_pop("v") * F.count("*") + 1e-300).alias("ss")), "centre")
    values = rows.join(F.broadcast(centre), "run_id").select("place", "run_id", (F.col("v") - F.col("m")).alias("v"))  # a row for each run

    def met(sides: pa.Table, pairs: pa.Table) -> pa.Table:
        held = {r["later"]: r for r in sides.to_pylist()}
        if len(held) < 2 or not pairs.num_rows:
            return _table([], _DEALT)
        names = sorted(set(held[False]["runs"]) & set(held[True]["runs"]))
        x, y = ([np.frombuffer(r[c], k).reshape(tile, -1)[:, [r["runs"].index(g) for g in names]] for c, k in (("vs", float), ("flags", np.uint8))] for r in (held[False], held[True]))
        total = {}
        for r in pairs.to_pylist():
            counts, i, j = np.frombuffer(r["counts"], np.int64), np.frombuffer(r["first"], np.uint16), np.frombuffer(r["later"], np.uint16)
            sums = total.setdefault(r["chunk"], np.zeros((len(counts), 3, len(names))))
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            starts, flags = (np.cumsum(counts) - counts)[some], x[1][i] & y[1][j]
            with np.errstate(invalid="ignore", over="ignore"):
                kinds = np.where(flags >= 3, x[0][i] * y[0][j], 0.0), flags >= 3, flags & 1
                for k, what in enumerate(kinds):
                    sums[some, k] += np.add.reduceat(what.astype(float), starts, axis=0)
        return _table([(chunk, g, np.ascontiguousarray(s[..., k]).tobytes()) for chunk, s in total.items() for k, g in enumerate(names)], _DEALT)

    def stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sums = np.frombuffer(r["sums"]).reshape(-1, 3)
                out += [(rep, r["run_id"], float(s / r["ss"]) if known else None) for rep, (s, known, there) in zip(chunks[r["chunk"]], sums, strict=True) if there]
            yield from _table(out, _STAT).to_batches()

    keys = ("a", "b")
    pairs = _followers(rows, n, seed, chunks, span, tile).repartition(DEALT, *keys)
    sides = _tile_sides(values, tile, max(1, -(-places // tile))).repartition(DEALT, *keys)
    sums = _added(sides.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(met, _kind(_DEALT)), "chunk", "run_id")
    stats = sums.join(centre, "run_id").select("chunk", "run_id", "sums", "ss").mapInArrow(stat, _kind(_STAT))
    return _SHARES(stat=stats, own=_OWN(series=series, centre=centre))


_PICKED = _schema(blk=pa.int32(), chunk=pa.int32(), counts=pa.binary(), picks=pa.binary())
#: What a block knows of a run in a chunk of replicates, a row each of `sums`; `below`: draws of values under the run's bounds, between which distinct values and how often each is drawn are kept.
_SUMS = ("w", "known", "s", "ss", "least", "most", "nans", "high", "low", "below")
_BLOCK = _schema(run_id=pa.string(), chunk=pa.int32(), sums=pa.binary(), vals=pa.binary(), times=pa.binary())
_REPLICATE = _schema(rep=pa.int32(), run_id=pa.string(), mean=pa.float64(), var=pa.float64(), most=pa.float64(), least_=pa.float64(), median=pa.float64(), missed=pa.bool_())


def _of_run(w: np.ndarray, own: np.ndarray, v: np.ndarray, bounds: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, values, times) of one run in a block: w has the draws (replicates) x (rows), `own` the known rows in the order of their values v."""
    drawn = w[:, own]
    nan, x = np.isnan(v), np.where(np.isfinite(v), v, 0.0)
    out = dict.fromkeys(_SUMS, np.zeros(len(w))) | {"w": w.sum(1), "least": np.full(len(w), np.inf), "most": np.full(len(w), -np.inf)}
    out |= dict(zip(("known", "s", "ss"), (drawn @ np.column_stack([np.ones(len(v)), x, x * x])).T, strict=True))
    for name, odd in (("nans", nan), ("high", v == np.inf), ("low", v == -np.inf)):
        if odd.any():
            out[name] = drawn[:, odd].sum(1)
    numbers = drawn[:, ~nan] > 0 if nan.any() else drawn > 0
    if numbers.shape[1]:
        some = numbers.any(1)
        out["least"] = np.where(some, v[numbers.argmax(1)], np.inf)
        out["most"] = np.where(some, v[numbers.shape[1] - 1 - numbers[:, ::-1].argmax(1)], -np.inf)
    lo, hi = (0, len(v)) if bounds[0] is None else (np.searchsorted(v, bounds[0]), np.searchsorted(v, bounds[1], side="right"))
    out["below"] = drawn[:, :lo].sum(1)
    vals, first = np.unique(v[lo:hi], return_index=True)
    times = np.add.reduceat(drawn[:, lo:hi], first, axis=1) if len(vals) else np.zeros((len(w), 0))
    return np.stack([out[k] for k in _SUMS]), vals, times


def _replicates(rows: DataFrame, bounds: DataFrame, n: int, places: int, size: int, seed: int, chunks: list[list[int]]) -> DataFrame:
    """(rep, run_id, mean, var, most, least_, median, missed): a place's pick goes to the block of the frame that it picks, as two bytes, and is counted and joined with the values there; missed: the median lies outside the run's bounds."""
    blocks = max(1, -(-places // size))

    def hashed(table: pa.Table) -> pa.Table:
        hashes, out = [Hashes(np.unique(table["place"].to_numpy()))], []
        for chunk, reps in enumerate(chunks):
            picks = np.concatenate([h for _, (h,) in _hashed(seed, reps, hashes)]).astype(np.int64) % n
            to, rep = (picks // size).ravel(), np.repeat(np.arange(len(reps)), hashes[0].n)
            local, counts = (picks % size).ravel()[np.argsort(to.astype(np.uint32), kind="stable")].astype(np.uint16), np.bincount(to * len(reps) + rep, minlength=blocks * len(reps)).reshape(blocks, -1)
            ends = np.concatenate(([0], np.cumsum(counts.sum(1))))
            out += [(b, chunk, counts[b].tobytes(), local[ends[b] : ends[b + 1]].tobytes()) for b in range(blocks) if ends[b + 1] > ends[b]]
        return _table(out, _PICKED)

    def drawn(table: pa.Table, picks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _BLOCK)
        runs, where, run, rank, v = _runs(table)
        x, known = v.fill_null(0.0).to_numpy(), ~v.is_null().to_numpy()
        limits, at, out = list(zip(table["lo"].to_pylist(), table["hi"].to_pylist(), strict=True)), where % size, []
        held = {-1: np.ones((1, len(where)))}
        found = {}
        for r in picks.to_pylist():
            found.setdefault(r["chunk"], []).append((np.frombuffer(r["counts"], np.int64), np.frombuffer(r["picks"], np.uint16)))
        for chunk in [-1, *found]:
            if chunk >= 0:
                reps = len(chunks[chunk])
                codes = np.concatenate([np.repeat(np.arange(reps) * size, counts) + local for counts, local in found[chunk]])
                held = {chunk: np.bincount(codes, minlength=reps * size).reshape(reps, size)[:, at].astype(float)}
            for k, name in enumerate(runs):
                mine = np.flatnonzero(run == k)
                own = np.flatnonzero(known[mine])
                own = own[np.argsort(x[mine[own]], kind="stable")]
                sums, vals, times = _of_run(held[chunk][:, rank[mine]], own, x[mine[own]], limits[mine[0]])
                out.append((name, chunk, sums.tobytes(), vals.tobytes(), times.astype(np.uint32).tobytes()))
        return _table(out, _BLOCK)

    def together(table: pa.Table) -> pa.Table:
        chunk, name, held = table["chunk"][0].as_py(), table["run_id"][0].as_py(), table.select(["sums", "vals", "times"]).to_pylist()
        reps = chunks[chunk] if chunk >= 0 else [0]
        sums = [dict(zip(_SUMS, np.frombuffer(r["sums"]).reshape(len(_SUMS), -1), strict=True)) for r in held]
        add = {k: np.sum([s[k] for s in sums], axis=0) for k in _SUMS}
        w, known, nans, n_known = add["w"], add["known"] > 0, add["nans"] > 0, add["known"]
        vals, times = np.concatenate([np.frombuffer(r["vals"]) for r in held]), np.concatenate([np.frombuffer(r["times"], np.uint32).reshape(len(reps), -1) for r in held], axis=1)
        order = np.argsort(vals, kind="stable")
        upto, middle, missed = add["below"][:, None] + np.cumsum(times[:, order], axis=1), np.zeros(len(reps)), np.zeros(len(reps), bool)
        with np.errstate(invalid="ignore", divide="ignore"):
            for rank in (np.floor((w + 1) / 2), np.floor(w / 2) + 1):
                there = upto >= rank[:, None]
                middle += np.where(there.any(1), vals[order][there.argmax(1)], np.nan) / 2 if len(vals) else np.nan
                missed |= (rank <= n_known) & ((rank <= add["below"]) | ~there.any(1))
            s = add["s"] + np.where(add["high"] > 0, np.inf, 0.0) + np.where(add["low"] > 0, -np.inf, 0.0) + np.where(nans, np.nan, 0.0)
            ss = add["ss"] + np.where(add["high"] + add["low"] > 0, np.inf, 0.0) + np.where(nans, np.nan, 0.0)
            mean, var = s / w, np.maximum(ss / w - (s / w) ** 2, 0.0)
            least = np.where(add["nans"] == n_known, np.nan, np.min([s["least"] for s in sums], axis=0))
            most = np.where(nans, np.nan, np.max([s["most"] for s in sums], axis=0))
        none = np.floor(w / 2) + 1 > n_known
        out = [(rep, name, float(mean[k]) if known[k] else None, float(var[k]) if known[k] else 0.0, float(most[k]) if known[k] else None, float(least[k]) if known[k] else None, None if none[k] else float(middle[k]), bool(missed[k])) for k, rep in enumerate(reps) if w[k] > 0]
        return _table(out, _REPLICATE)

    picked = rows.select("blk", "place").groupBy("blk").applyInArrow(hashed, _kind(_PICKED)).repartition(DEALT, "blk")
    held = rows.join(F.broadcast(bounds), "run_id").repartition(DEALT, "blk")  # a row for each run
    made = held.groupBy("blk").cogroup(picked.groupBy("blk")).applyInArrow(drawn, _kind(_BLOCK)).repartition(DEALT, "run_id", "chunk")
    return made.groupBy("run_id", "chunk").applyInArrow(together, _kind(_REPLICATE))


def bootstrapped(series: DataFrame, seed: int = 42, reps: int = 1000, size: int | None = None, reach: float = 8.0) -> DataFrame:
    """(rep, run_id, mean, var, most, least_, median), replicate 0 the data: medians are sought within `reach` standard errors of the run's own, and among all values where they are not there."""
    rows, n, places, size = _blocks(series, size)
    if size > 1 << 16:
        raise ValueError("a block has at most 65,536 frames")
    fewest = series.groupBy("run_id").count().agg(F.min("count")).first()[0] or 1
    near = reach * 0.5 / math.sqrt(fewest) + reach / 8000
    cut = F.percentile_approx(F.col("v").cast("double"), [max(0.0, 0.5 - near), min(1.0, 0.5 + near)], 10000)
    bounds = series.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(cut.alias("cut")).selectExpr("run_id", "cut[0] AS lo", "cut[1] AS hi")
    made = written(_replicates(rows, bounds, n, places, size, seed, _chunks(list(range(1, reps + 1)))), "replicates")
    missed = made.where("missed")
    again = sorted(r.rep for r in missed.select("rep").distinct().collect())
    if again:
        drawn = [r for r in again if r > 0]
        chunks = [drawn[k : k + CHUNK // 10] for k in range(0, len(drawn), CHUNK // 10)]
        all_ = bounds.selectExpr("run_id", "CAST(NULL AS DOUBLE) AS lo", "CAST(NULL AS DOUBLE) AS hi")
        second = _replicates(rows, all_, n, places, size, seed, chunks)
        made = made.where("NOT missed").unionByName(second.join(missed.select("rep", "run_id"), ["rep", "run_id"], "left_semi"))
    return made.drop("missed")
