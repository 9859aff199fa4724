"""Benchmark decontamination by latent semantic retrieval.

Passages of documents are TF-IDF vectors over hashed words. One distributed pass gives Z = A'A Omega for a seeded Gaussian Omega
(randomised subspace iteration on the passages' matrix A), and Nystroem's formula turns Omega and Z into right singular
vectors and values of A. A passage's latent vector is its TF-IDF vector times V / S, so that directions in
which all passages vary count no more than others. Benchmark items, the stated query set, are compared with passages of
their length by cosine. Candidates are verified by the longest common subsequence of words and by the item's answer, its last
words.

Which passages the search looks at: a match has at least `least` of the item's L words in order, so of any L - least + 2 of
its words two at least are there. The item's rarest words (by the corpus) serve as these, and passages without two of them for
any item of their length are left out before the cosine. The cosine alone would lose copies (a whitened vector of few
directions ranks some low, short items above all), so passages with two rare words of the same item are candidates of that
item in any case: no passage that satisfies the verification is lost, and a test holds the result against all passages.

Passages: sums over blocks of `stride` words; for an item of L words, all runs of ceil(L / stride) + 1 blocks (rounded up to
an even number), one of which holds any copy whole; at a text's end they end with it. Documents are never cut.
Before the subsequence is computed, the passage's words that the item has at all must be enough for it.

Bounds: words hash into TERMS dimensions, so document frequencies, Omega, Z and V have a fixed size. Items travel to the
tasks in parts of about PART items, one scan a part, so neither the driver nor a task holds the whole benchmark.

Defined results: null or empty texts and items match nothing; items without an id are items, with a null item_id; a short
item has its all words as answer; repeated rows are judged each; of several passages that match an item the best one is
returned; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm._text import Words, slices, words

TERMS = 1 << 13
RANK = 48
#: Items that one scan of the documents looks for.
PART = 20_000
_LOOK = 20


@dataclass
class Space:
    """Frozen statistics: each hashed term's latent vector, its IDF built in, and how many documents have the term."""

    latent: np.ndarray
    stride: int
    df: np.ndarray


@dataclass
class Items:
    """Queries. rare: the words that prove a candidate, sorted; the items of rare[x] are owners[cuts[x]:cuts[x + 1]]."""

    ids: list[int | None]
    hashes: list[np.ndarray]
    vectors: np.ndarray
    blocks: np.ndarray
    least: np.ndarray
    rare: np.ndarray
    cuts: np.ndarray
    owners: np.ndarray


def _terms(w: Words) -> np.ndarray:
    return (w.hashes >> np.uint64(13)).astype(np.int64) % TERMS


def _doc_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many documents hold each hashed term; term -1 counts documents."""
    df, n = np.zeros(TERMS, dtype=np.int64), 0
    for batch in batches:
        for b in slices(batch):
            w = words(b.column(0), lower=True)
            for a in range(0, b.num_rows, 4096):
                lo, hi = w.first[a], w.first[min(a + 4096, b.num_rows)]
                seen = np.zeros((min(4096, b.num_rows - a), TERMS), dtype=bool)
                seen[w.owner()[lo:hi] - a, _terms(w)[lo:hi]] = True
                df += seen.sum(axis=0)
            n += b.num_rows
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["term", "n"])


def _range(idf: np.ndarray, omega: np.ndarray, passage: int, most: int = 2048):
    """Per task: its part of A'A Omega, A's rows being passages of `passage` words scaled to length 1."""
    table = np.vstack([omega * idf[:, None], np.zeros((1, omega.shape[1]))]).astype(np.float32)
    weight = np.append(idf, 0.0)

    def add(w: Words, z: np.ndarray) -> None:
        per = -(-w.counts // passage)
        first = np.concatenate(([0], np.cumsum(per)))
        of = np.repeat(first[:-1], w.counts) + (np.arange(len(w.hashes)) - np.repeat(w.first[:-1], w.counts)) // passage
        t = _terms(w)
        rows = np.full((first[-1], passage), TERMS, dtype=np.int64)
        rows[of, (np.arange(len(t)) - np.repeat(w.first[:-1], w.counts)) % passage] = t
        y = table[rows[:, 0]]
        for k in range(1, passage):
            y += table[rows[:, k]]
        # A term that occurs c times weighs c * idf: squares are taken of runs of equal terms.
        rows.sort(axis=1)
        flat = rows.ravel()
        head = np.flatnonzero(np.append(True, (np.diff(flat) != 0) | (np.arange(1, len(flat)) % passage == 0)))
        square = (np.diff(np.append(head, len(flat))) * weight[flat[head]]) ** 2
        y /= np.maximum(np.bincount(head // passage, weights=square, minlength=len(rows)), 1e-9)[:, None]
        order = np.argsort(t, kind="stable")
        t, of = t[order], of[order]
        for a in range(0, len(t), most):
            head = np.flatnonzero(np.diff(t[a : a + most], prepend=-1))
            z[t[a : a + most][head]] += np.add.reduceat(y[of[a : a + most]], head, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((TERMS, omega.shape[1]))
        for batch in batches:
            for b in slices(batch, most=1 << 20):
                w = words(b.column(0), lower=True)
                if len(w.hashes):
                    add(w, z)
        z *= idf[:, None]
        at = np.flatnonzero(np.abs(z).sum(axis=1))
        if len(at):
            cols = [pa.array(z[at, k].astype(np.float32)) for k in range(z.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *cols], ["term", *(f"z{k}" for k in range(z.shape[1]))])

    return run


def fit(docs: DataFrame, text: str = "text", rank: int = RANK, over: int = 8, stride: int = 4, passage: int = 64, seed: int = 7) -> Space:
    """The latent space of all documents: two passes, each reduced to TERMS rows."""
    t = docs.select(F.col(text).alias("text"))
    df = t.mapInArrow(_doc_terms, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = df["term"].to_numpy(), df["n"].to_numpy()
    total = max(1, int(n[term == -1].sum()))
    count = np.zeros(TERMS)
    count[term[term >= 0]] = n[term >= 0]
    idf = np.log((total + 1) / (count + 1)) + 1e-3
    omega = np.random.default_rng(seed).standard_normal((TERMS, rank + over))
    names = [f"z{k}" for k in range(rank + over)]
    part = t.mapInArrow(_range(idf, omega, passage), "term int, " + ", ".join(f"{k} float" for k in names))
    rows = part.groupBy("term").agg(*[F.sum(k).alias(k) for k in names]).toArrow()
    z = np.zeros((TERMS, rank + over))
    z[rows["term"].to_numpy()] = np.column_stack([rows[k].to_numpy() for k in names]) if rows.num_rows else 0
    small = omega.T @ z
    val, vec = np.linalg.eigh((small + small.T) / 2)
    good = val > max(1e-9, val.max() * 1e-9) if len(val) else val > 0
    if not good.any():
        return Space(np.zeros((TERMS, 1), np.float32), stride, count)
    f = z @ (vec[:, good] / np.sqrt(val[good]))
    u, s, _ = np.linalg.svd(f, full_matrices=False)
    u, s = u[:, :rank], s[:rank]
    keep = s > s.max() * 1e-6
    return Space((u[:, keep] / s[keep] * idf[:, None]).astype(np.float32), stride, count)


def prepare(items: list[tuple[int | None, str]], space: Space, lcs: float = 0.8, answer_lcs: float = 0.7) -> Items:
    """The query side: latent vectors, word hashes, passage lengths in blocks, and each item's rarest words."""
    ids, hashes, vectors, blocks, least, rare, owner = [], [], [], [], [], [], []
    for i, text in items:
        w = words(pa.array([text], pa.large_string()), lower=True)
        n = len(w.hashes)
        if not n:
            continue
        v = space.latent[_terms(w)].sum(axis=0)
        need = max(1, int(np.ceil(min(lcs, answer_lcs) * n - 1e-9)))
        order = np.lexsort((w.hashes, space.df[_terms(w)]))
        proof = np.unique(w.hashes[order[: n - need + min(2, need)]])
        rare.append(proof)
        owner.append(np.full(len(proof), len(ids)))
        ids.append(i)
        hashes.append(w.hashes)
        vectors.append(v / max(float(np.linalg.norm(v)), 1e-12))
        blocks.append(2 * -(-(-(-n // space.stride) + 1) // 2))
        least.append(need)
    rare, owner = np.concatenate([np.zeros(0, np.uint64), *rare]), np.concatenate([np.zeros(0, np.int64), *owner])
    order = np.argsort(rare, kind="stable")
    names, cuts = np.unique(rare[order], return_index=True)
    vectors = np.array(vectors, dtype=np.float32).reshape(len(ids), space.latent.shape[1])
    return Items(ids, hashes, vectors, np.array(blocks, dtype=np.int64), np.array(least, dtype=np.int64), names, np.append(cuts, len(rare)), owner[order])


def longest_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit by bit in parallel over a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = v & at.get(x, 0)
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


def _runs(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): start[i], start[i] + 1, ... count[i] values each."""
    which = np.repeat(np.arange(len(count)), count)
    return which, start[which] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _search(space: Space, items: Items, cosine: float, lcs: float, answer_words: int, answer_lcs: float):
    stride = space.stride
    table = np.vstack([space.latent, np.zeros((1, space.latent.shape[1]), np.float32)])
    groups = {int(k): np.flatnonzero(items.blocks == k) for k in np.unique(items.blocks)}
    look = np.zeros(1 << _LOOK, dtype=bool)
    look[(items.rare >> np.uint64(64 - _LOOK)).astype(np.int64)] = True
    own = [frozenset(h.tolist()) for h in items.hashes]

    def hits(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, text, item) of every rare word, in order of words."""
        at = np.flatnonzero(look[(w.hashes >> np.uint64(64 - _LOOK)).astype(np.int64)])
        x = np.minimum(np.searchsorted(items.rare, w.hashes[at]), len(items.rare) - 1)
        ok = items.rare[x] == w.hashes[at]
        at, x = at[ok], x[ok]
        which, slot = _runs(items.cuts[x], items.cuts[x + 1] - items.cuts[x])
        return at[which], np.searchsorted(w.first, at[which], "right") - 1, items.owners[slot]

    def passages(w: Words, first: np.ndarray, word: np.ndarray, text: np.ndarray, same: np.ndarray, need: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hit, block) of passages of k blocks that hold a hit and, where two are needed, the next one of the same kind too; blocks are counted over all texts."""
        nxt = np.where(need > 1, np.append(word[1:], 0), word)
        ok = (need == 1) | np.append((same[1:] == same[:-1]) & (text[1:] == text[:-1]), np.zeros(min(len(word), 1), dtype=bool))
        lo = np.maximum((nxt - w.first[text]) // stride - k + 1, 0)
        hi = (word - w.first[text]) // stride
        count = np.where(ok, np.maximum(hi - lo + 1, 0), 0)
        which, block = _runs(lo, count)
        return which, first[text[which]] + block

    def candidates(w: Words) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first word, last word + 1, cosine)."""
        per = -(-w.counts // stride)
        first = np.concatenate(([0], np.cumsum(per)))
        word, text, item = hits(w)
        need = np.minimum(items.least, 2)
        terms = None
        for k, which in groups.items():
            mine = np.flatnonzero(items.blocks[item] == k)
            if not len(mine):
                continue
            x, d, j = word[mine], text[mine], item[mine]
            new = np.append(True, x[1:] != x[:-1])
            _, block = passages(w, first, x[new], d[new], d[new], np.full(new.sum(), need[which].min()), k)
            block = np.unique(block)
            order = np.lexsort((x, j))
            hit, exact = passages(w, first, x[order], d[order], j[order], need[j[order]], k)
            if not len(block):
                continue
            terms = _terms(w) if terms is None else terms
            d = np.searchsorted(first, block, "right") - 1
            begin = w.first[d] + (block - first[d]) * stride
            end = np.minimum(begin + k * stride, w.first[d + 1])
            found = [np.searchsorted(block, exact) * len(items.ids) + j[order][hit]]
            cos = np.zeros((0, len(which)), np.float32)
            for lo in range(0, len(block), 1024):
                b, e = begin[lo : lo + 1024, None], end[lo : lo + 1024, None]
                v = np.zeros((len(b), table.shape[1]), np.float32)
                for r in range(k * stride):
                    at = b[:, 0] + r
                    v += table[np.where(at < e[:, 0], terms[np.minimum(at, len(terms) - 1)], TERMS)]
                v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
                near = v @ items.vectors[which].T
                i, c = np.nonzero(near >= cosine)
                found.append((lo + i) * len(items.ids) + which[c])
                cos = np.concatenate([cos, near]) if len(which) * len(block) < 1 << 22 else cos
            pair = np.unique(np.concatenate(found))
            at, j = pair // len(items.ids), pair % len(items.ids)
            place = np.searchsorted(which, j)
            for x, y, z in zip(at.tolist(), j.tolist(), place.tolist(), strict=True):
                if sum(map(own[y].__contains__, w.hashes[begin[x] : end[x]].tolist())) < items.least[y]:
                    continue
                if len(cos):
                    near = float(cos[x, z])
                else:
                    v = table[terms[begin[x] : end[x]]].sum(axis=0)
                    near = float(v @ items.vectors[y] / max(float(np.linalg.norm(v)), 1e-12))
                yield int(d[x]), y, int(begin[x]), int(end[x]), near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=1 << 20):
                w = words(b.column(1), lower=True)
                if not len(w.hashes) or not items.ids:
                    continue
                best: dict[tuple[int, int], tuple[float, float, bool]] = {}
                for d, j, a, e, cos in candidates(w):
                    item = items.hashes[j]
                    part = longest_common(item, w.hashes[a:e]) / len(item)
                    answer = item[-answer_words:]
                    found = longest_common(answer, w.hashes[a:e]) == len(answer)
                    if part >= lcs or (found and part >= answer_lcs):
                        best[d, j] = max(best.get((d, j), (0.0, -2.0, False)), (part, cos, found))
                keys = list(best)
                ids = b.column(0).cast(pa.int64()).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in keys], pa.int64()), pa.array([items.ids[j] for _, j in keys], pa.int64()), pa.array([best[k][1] for k in keys], pa.float64()), pa.array([best[k][0] for k in keys], pa.float64()), pa.array([best[k][2] for k in keys], pa.bool_())], ["doc_id", "item_id", "cosine", "lcs", "answer"])

    return run


def _leaks_of(d: DataFrame, items: list[tuple[int | None, str]], space: Space, cosine: float, lcs: float, answer_words: int, answer_lcs: float) -> DataFrame:
    held = d.sparkSession.sparkContext.broadcast((space, prepare(items, space, lcs, answer_lcs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search(*held.value, cosine, lcs, answer_words, answer_lcs)(batches)

    return d.mapInArrow(run, "doc_id long, item_id long, cosine double, lcs double, answer boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", cosine: float = 0.45, lcs: float = 0.8, answer_words: int = 5, answer_lcs: float = 0.7, part: int = PART, **options) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) for every document and item that match."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    parts = max(1, -(-items.count() // part))
    space = fit(docs, text, **options)
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        found = _leaks_of(d, sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r)), space, cosine, lcs, answer_words, answer_lcs)
        out = found if out is None else out.unionByName(found)
    return out
