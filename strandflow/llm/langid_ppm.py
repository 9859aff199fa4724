"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order, up to ORDER. Statistics are counted on a bounded sample of labelled
documents and then frozen: the code length of a byte after the longest context that the tree holds is -log2 of its share there
(method C: occurrences over occurrences plus distinct symbols); a byte that the context lacks costs an escape (distinct
symbols over the same) and is coded after the next shorter context, at last as 8 bits. A text's code length is the exact
sum over its bytes. The language with the shortest code wins; its score is its posterior under equal priors.

A tree is two sparse tables, (context, byte) -> bits and context -> escape bits, found by hashing: its size follows what was
seen and not the alphabet. Long contexts (three bytes and more) are kept where they were seen with a byte twice.

Bounds: the sample takes at most `per_language` documents of each language, those with the smallest hashes of their keys; only the
trees made of them reach the driver and the tasks, twelve bytes a node.

Defined results: null text, or text without any letter, is `und` with score 0; without labelled rows every text is
`und`; ties go to the first language by name; rows without a language or text teach nothing; repeated rows are scored each; an
empty table gives no rows; other columns are passed on, and lang_pred and score replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm._text import buffers, mix, slices

PER_LANGUAGE = 2000
ORDER = 4
PAD = 32
_LEAST = {3: 2, 4: 2}


def _grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one number whose low bytes are the last ones; texts begin after blanks."""
    key = data.astype(np.uint64)
    row = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    for k in range(1, ORDER + 1):
        before = np.full(len(data), PAD, dtype=np.uint64)
        before[k:] = data[:-k] if len(data) > k else before[k:]
        key |= np.where(row >= k, before, np.uint64(PAD)) << np.uint64(8 * k)
    return key


def _low(key: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes, marked with their number so that keys of all lengths differ."""
    return (key & np.uint64((1 << (8 * n)) - 1)) | np.uint64((n + 1) << 56)


class Table:
    """A frozen map from keys to floats: open addressing, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.float32)
        at, left, self.reach = self._home(keys), np.arange(len(keys)), 0
        while len(left):
            # Of the keys that want a free place the last one gets it; the others move on.
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (size - 1)
            self.reach += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN for keys that are not there."""
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.float32(np.nan))
        left = np.flatnonzero((held != keys) & (held != 0))
        for _ in range(1, self.reach):
            if not len(left):
                break
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held != 0)]
        return out


@dataclass
class Tree:
    """One language: bits of a byte in its context, and of leaving a context."""

    own: Table
    escape: Table

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The code length of every byte, given with its context."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            key = grams[left]
            own = self.own.get(_low(key, k + 1))
            found = ~np.isnan(own)
            out[left[found]] += own[found]
            left, key = left[~found], key[~found]
            if not len(left):
                return out
            away = self.escape.get(_low(key >> np.uint64(8), k))
            out[left] += np.nan_to_num(away)
        out[left] += 8
        return out


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]


def tree(counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Tree:
    """The frozen tree of counts: order -> (keys of order + 1 bytes, occurrences)."""
    own_keys, own_bits, keys, bits = [], [], [], []
    for k, (key, n) in counts.items():
        context, at = np.unique(key >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(at, weights=n, minlength=len(context)), np.bincount(at, minlength=len(context))
        own_keys.append(_low(key, k + 1))
        own_bits.append(-np.log2(n / (total + kinds)[at]))
        keys.append(_low(context, k))
        bits.append(-np.log2(kinds / (total + kinds)))
    join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
    return Tree(Table(join(own_keys, np.uint64), join(own_bits, np.float64)), Table(join(keys, np.uint64), join(bits, np.float64)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of bytes with their longest contexts, summed over the task."""
    held: dict[str, list] = {}
    for batch in batches:
        for b in slices(batch):
            langs = b.column(0).to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs)):
                data, off = buffers(b.filter(pa.array(langs == lang)).column(1))
                if len(data):
                    held.setdefault(lang, []).append(np.unique(_grams(data, off), return_counts=True))
    for lang, parts in held.items():
        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "key", "n"])


def sample(labelled: DataFrame, key: str, per_language: int = PER_LANGUAGE, buckets: int = 64) -> DataFrame:
    """(lang, text) of at most per_language documents of each language, those with the smallest hashes of their keys.

    The smallest of each hash bucket first and then of these, so no task sees all documents of a language.
    """
    d = labelled.where("lang is not null and text is not null").select("lang", F.col(key).alias("key_"), F.md5(F.col(key).cast("string")).alias("order_")).distinct()
    first = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("order_", "key_"))
    d = d.withColumn("part_", F.pmod(F.xxhash64("key_"), F.lit(buckets))).withColumn("at_", first("part_")).where(F.col("at_") <= per_language)
    d = d.withColumn("at_", first()).where(F.col("at_") <= per_language)
    ids = F.broadcast(d.select(F.col("lang").alias("lang_"), "key_"))  # at most per_language rows a language
    both = labelled.select(F.col(key).alias("id_"), "lang", "text").join(ids, (F.col("id_") == F.col("key_")) & (F.col("lang") == F.col("lang_")))
    return both.select("lang", "text")


def train(labelled: DataFrame, key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Counts of all orders on the executors; the frozen tables are made on the driver of the nodes that stay."""
    longest = sample(labelled, key, per_language).mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("key").bitwiseAND(F.lit((1 << (8 * k + 8)) - 1)).alias("key")) for k in range(ORDER + 1)]))
    nodes = longest.select("lang", "n", orders.alias("x")).groupBy("lang", "x.k", "x.key").agg(F.sum("n").alias("n"))
    keep = F.lit(True)
    for k, least in _LEAST.items():
        keep &= (F.col("k") != k) | (F.col("n") >= least)
    counts = nodes.where(keep).select("lang", "k", "key", "n").toArrow()  # as columns: rows would take many times the memory
    lang = counts.column("lang").combine_chunks().dictionary_encode()
    order, key, n = (counts.column(c).to_numpy() for c in ("k", "key", "n"))
    found = lang.dictionary.to_pylist()
    own, trees = lang.indices.to_numpy(), []
    languages = sorted(found)
    for name in languages:
        mine = own == found.index(name)
        trees.append(tree({int(k): (key[mine & (order == k)].astype(np.uint64), n[mine & (order == k)].astype(np.float64)) for k in np.unique(order[mine])}))
    return Model(languages, trees)


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def code_lengths(texts: pa.Array, model: Model) -> np.ndarray:
    """Bits of each text (rows) under each language (columns)."""
    data, off = buffers(texts)
    out = np.zeros((len(off) - 1, len(model.languages)))
    rows = np.flatnonzero(np.diff(off) > 0)
    if len(rows):
        grams, at = np.unique(_grams(data, off), return_inverse=True)
        for k, t in enumerate(model.trees):
            out[rows, k] = np.add.reduceat(t.bits(grams)[at], off[:-1][rows])
    return out


def score_texts(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    data, off = buffers(texts)
    n = len(off) - 1
    names, score = ["und"] * n, np.zeros(n)
    if not model.languages:
        return names, score
    total = code_lengths(texts, model)
    raw = data.tobytes()
    for i in range(n):
        if off[i + 1] > off[i] and _has_letter(raw[off[i] : off[i + 1]]):
            best = int(total[i].argmin())
            names[i] = model.languages[best]
            score[i] = 1 / np.exp2(np.maximum(total[i, best] - total[i], -1000)).sum()
    return names, score


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score as last columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop("lang_pred", "score")
    d = own.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text):
                names, score = score_texts(b.column(b.schema.get_field_index(text)), held.value)
                b = b.set_column(b.num_columns - 2, "lang_pred", pa.array(names))
                yield b.set_column(b.num_columns - 1, "score", pa.array(score))

    return d.mapInArrow(run, d.schema)
