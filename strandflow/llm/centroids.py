"""Exact integer k-means by Hamerly's bounds.

A vector's row keeps an upper bound of the distance to its centroid and one lower bound of the distance to the second nearest;
both are persisted with the vector each round and loosened by the drift of the centroids. Where the upper bound stays under the
lower one, or under half the distance from its centroid to the next one, no distance is computed. Else the distance to the own centroid is
computed, and what is still ambiguous gets a full scan in 64-bit integers. Bounds are floating numbers widened by more than their
rounding, and a vector is only left alone where the bounds differ strictly, so ties go to the smaller number as in a plain scan.

A round is one pass: each task reads its vectors, writes them with their new bounds and, beside them, what moved as sums by
cluster (new members less those that left). The sums are folded by Spark; k centroids are all that comes to the driver. A round
in which nothing moves is a fixed point: later rounds would repeat it and are left out. A round's table is removed when the next is written.

Defined results: vectors of another length, and those with null or non-finite components, are not kept; nor those with a component
beyond 2^27 after scaling, whose squared distances would not fit into 64 bits. Rows that repeat a vec_id, or have none, are
vectors of their own; with fewer vectors than k there are as many centroids as vectors; equal hashes are ordered by components; an
empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm._store import drop, written

SLACK, LIMIT = 1e-9, 1 << 27
SCHEMA = "vec_id long, vector binary, cluster int, upper double, lower double, distance long, gained long, sums array<long>"
_TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, ints): kept vectors as integers floor(scale * x)."""
    v = F.col(vector).cast("array<double>")
    kept = table.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == size)
    kept = kept.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return kept.where(F.forall("v", lambda x: F.abs(F.floor(x * scale)) <= LIMIT)).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("ints"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows of x) x (rows of c) as 64-bit integers."""
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        d = x - row
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def _scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, upper, lower) by exact distances; without a second centroid the lower bound is infinite."""
    d = squared(x, c)
    near = d.argmin(axis=1)
    rows = np.arange(len(x))
    best = d[rows, near]
    d[rows, near] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1)) * (1 - SLACK) if len(c) > 1 else np.full(len(x), np.inf)
    return near.astype(np.int32), np.sqrt(best) * (1 + SLACK), lower


def step(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, full scans) after the centroids went from old to new."""
    drift = np.sqrt(np.diag(squared(old, new)).astype(float)) * (1 + SLACK)
    order = np.argsort(drift)
    most = np.full(len(new), drift[order[-1]])
    most[order[-1]] = drift[order[-2]] if len(new) > 1 else 0.0
    upper = upper + drift[cluster]
    upper *= 1 + SLACK
    lower = (lower - most[cluster]) - SLACK * np.abs(np.where(np.isinf(lower), 0, lower))
    apart = squared(new, new).astype(float)
    np.fill_diagonal(apart, np.inf)
    bound = np.maximum(lower, (np.sqrt(apart.min(axis=1)) / 2 * (1 - SLACK))[cluster])
    cluster = cluster.copy()
    doubt = np.flatnonzero(upper >= bound)
    if len(doubt):
        own = x[doubt] - new[cluster[doubt]]
        upper[doubt] = np.sqrt(np.einsum("ij,ij->i", own, own)) * (1 + SLACK)
        doubt = doubt[upper[doubt] >= bound[doubt]]
    if len(doubt):
        cluster[doubt], upper[doubt], lower[doubt] = _scan(x[doubt], new)
    return cluster, upper, lower, len(doubt)


def _moved(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, sums) that clusters gained, less what they lost."""
    count, sums = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
    rows = np.arange(len(x)) if before is None else np.flatnonzero(before != after)
    np.add.at(count, after[rows], 1)
    np.add.at(sums, after[rows], x[rows])
    if before is not None:
        np.subtract.at(count, before[rows], 1)
        np.subtract.at(sums, before[rows], x[rows])
    return count, sums


def _batch(*columns: object) -> pa.RecordBatch:
    """Columns by SCHEMA; a number stands for so many nulls."""
    made = [pa.nulls(c, t) if isinstance(c, int) else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(made, [x.split()[0] for x in SCHEMA.split(", ")])


def assign(rows: DataFrame, old: np.ndarray | None, new: np.ndarray, distances: bool = False) -> DataFrame:
    """The written rows with their state after the centroids went from old (None: no state yet) to new.

    Beside them, with vector null, one row a task and changed cluster: members gained (less those lost) and the sums of their components.
    distances: exact squared distances to the own centroid, too."""
    k, size = new.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gained, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32).reshape(n, size).astype(np.int64)
            before = None
            if old is None:
                cluster, upper, lower = _scan(x, new)
            else:
                before = b.column(2).to_numpy(zero_copy_only=False)
                cluster, upper, lower, _ = step(x, before, *(b.column(c).to_numpy(zero_copy_only=False) for c in (3, 4)), old, new)
            c, s = _moved(x, before, cluster, k)
            gained, sums = gained + c, sums + s
            own = x - new[cluster]
            yield _batch(b.column(0), b.column(1), cluster, upper, lower, np.einsum("ij,ij->i", own, own) if distances else n, n, n)
        changed = np.flatnonzero((gained != 0) | (sums != 0).any(axis=1))
        m = len(changed)
        yield _batch(m, m, changed, m, m, m, gained[changed], sums[changed].tolist())

    return written(rows.select("vec_id", "vector", *[c for c in ("cluster", "upper", "lower") if c in rows.columns]).mapInArrow(run, SCHEMA), "clusters")


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of salt and id: a top-k, k rows come to the driver."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(digest, "ints").limit(k).collect()
    return np.array([r.ints for r in first], np.int64)


def _packed(kept: DataFrame) -> DataFrame:
    """(vec_id, vector): components as 32-bit binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            rows = flat.reshape(b.num_rows, -1) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "vector"])

    return kept.mapInArrow(run, "vec_id long, vector binary")


def cluster(kept: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, vector, cluster, upper, lower, distance), centroids) of vectors by `vectors`: k-means of so many rounds, assigned once more."""
    new = first_centroids(kept, k, salt)
    if not len(new):
        return _packed(kept).selectExpr("*", "0 AS cluster", "0D AS upper", "0D AS lower", "0L AS distance"), new
    k, size = new.shape
    state, old = _packed(kept), None
    count, sums = [0] * k, [[0] * size for _ in range(k)]
    for r in range(rounds):
        before, state = state, assign(state, old, new)
        if r:
            drop(before)
        total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
        changes = state.where("vector is null").groupBy("cluster").agg(F.sum("gained").alias("gained"), *total).collect()
        for j, gained, *moved in changes:
            count[j] += gained
            sums[j] = [a + int(b) for a, b in zip(sums[j], moved, strict=True)]
        state = state.where("vector is not null")
        old, new = new, np.array([[s // n for s in row] if n else kept_.tolist() for row, n, kept_ in zip(sums, count, new, strict=True)], np.int64)
        if not changes:
            break
    before, state = state, assign(state, old, new, distances=True)
    if rounds:
        drop(before)
    return state.where("vector is not null").drop("gained", "sums"), new


def clustered(table: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, salt: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    rows, centroids = cluster(vectors(table, key, vector, size, scale), k, rounds, salt)
    spark = table.sparkSession
    digest = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    inertia = {j: int(d) for j, d in per}
    facts = spark.createDataFrame([(j, inertia.get(j, 0), sum(inertia.values()), d) for j, d in digest], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
