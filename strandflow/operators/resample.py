"""Resampled correlations by weight vectors: rows shuffled do not depend on the number of replicates.

A replicate weighs each frame by a Poisson number of mean 1, a hash of replicate and frame (the bootstrap for data in parts: frames are weighed
apart from each other, so nothing is drawn across tasks). A task makes the weights of its frames as a matrix and folds
weighted sums of all replicates by products of matrices; one row a task and pair goes on, and these add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.store import written

#: The Poisson distribution function of mean 1 at 0, 1, 2...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974022, 0.9999998885745217)
GROUPS = 64
_MASK = np.uint64(0xFFFFFFFF)


def weights(reps: int, frames: np.ndarray, seed: int) -> np.ndarray:
    """(frames) x (replicates 0 to reps): weights; replicate 0 is the data themselves."""
    h = (np.arange(reps + 1, dtype=np.uint64)[None, :] * np.uint64(2654435761) + frames.astype(np.uint64)[:, None] * np.uint64(2246822519) + np.uint64(seed)) & _MASK
    for shift, factor in ((15, 2246822519), (13, 3266489917), (16, 1)):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & _MASK
    out = np.searchsorted(np.array(POISSON), h / 4294967296.0, side="right").astype(float)
    out[:, 0] = 1.0
    return out


def _sums(wide: DataFrame, left: list[str], right: list[str], reps: int, seed: int) -> DataFrame:
    """(i, j, sums): a row a task for each pair (sum of products) and each group i of `left` (j null: weight, sum and sum of squares)."""
    pairs = [(i, j) for i in left for j in right if i < j]
    names = sorted({*left, *right})
    place = {g: k for k, g in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros((3, len(left), reps + 1)), np.zeros((len(pairs), reps + 1))
        a, b = (np.array([place[p[k]] for p in pairs], dtype=int) for k in (0, 1))
        own = np.array([place[g] for g in left], dtype=int)
        for batch in batches:
            frames = batch.column(0).to_numpy()
            held = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(names))]) if batch.num_rows else np.zeros((0, len(names)))
            for lo in range(0, len(frames), 512):
                w, x = weights(reps, frames[lo : lo + 512], seed).T, held[lo : lo + 512]
                there = ~np.isnan(x)
                x = np.where(there, x, 0.0)
                for k, m in enumerate((there.astype(float), x, x * x)):
                    one[k] += (w @ m[:, own]).T
                two += (w @ (x[:, a] * x[:, b])).T
        rows = [(g, None, one[:, k].tobytes()) for k, g in enumerate(left)] + [(i, j, two[k].tobytes()) for k, (i, j) in enumerate(pairs)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["i", "j", "sums"])

    return wide.select("frame", *[F.col(f"`{g}`").cast("double") for g in names]).mapInArrow(run, "i string, j string, sums binary")


def bootstrap_correlation(series: DataFrame, seed: int = 42, reps: int = 1000) -> DataFrame:
    """(i, j, estimate, lo, hi, bias, se): percentile intervals of the correlation of every pair of groups of (run_id, frame, v)."""
    groups = sorted(r.run_id for r in series.select("run_id").distinct().collect())  # their pairs are the result
    wide = written(series.groupBy("frame").pivot("run_id", groups).agg(F.max("v")), "wide")
    blocks = [groups[k : k + GROUPS] for k in range(0, len(groups), GROUPS)]
    parts = None
    for k, a in enumerate(blocks):
        for b in blocks[k:]:
            found = _sums(wide, a, b, reps, seed)
            found = found if b is a else found.where("j is not null")
            parts = found if parts is None else parts.unionByName(found)
    kind = "i string, j string, sums binary"

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0)
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "j": [pdf["j"].iloc[0]], "sums": [total.tobytes()]})

    if parts is None:
        return series.sparkSession.createDataFrame([], "i string, j string, estimate double, lo double, hi double, bias double, se double")
    total = written(parts.groupBy("i", "j").applyInPandas(added, kind), "sums")
    one = total.where("j is null")
    pairs = total.where("j is not null").join(one.select("i", F.col("sums").alias("a")), "i").join(one.select(F.col("i").alias("j"), F.col("sums").alias("b")), "j")

    def statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                xy, (wa, sa, qa), (wb, sb, qb) = np.frombuffer(r.sums), np.frombuffer(r.a).reshape(3, -1), np.frombuffer(r.b).reshape(3, -1)
                with np.errstate(all="ignore"):
                    va, vb = qa / wa - (sa / wa) ** 2, qb / wb - (sb / wb) ** 2
                    c = np.where((va > 1e-20) & (vb > 1e-20), (xy / wa - sa / wa * sb / wb) / np.sqrt(np.where(va * vb > 0, va * vb, 1)), np.nan)
                drawn = c[1:][~np.isnan(c[1:])]
                lo, hi = np.percentile(drawn, [2.5, 97.5]) if len(drawn) else (None, None)
                out.append((r.i, r.j, None if np.isnan(c[0]) else c[0], lo, hi, None if np.isnan(c[0]) or not len(drawn) else drawn.mean() - c[0], drawn.std() if len(drawn) else None))
            yield pd.DataFrame(out, columns=["i", "j", "estimate", "lo", "hi", "bias", "se"])

    return pairs.select("i", "j", "sums", "a", "b").mapInPandas(statistics, "i string, j string, estimate double, lo double, hi double, bias double, se double")


def _steps() -> str:
    """The weights in plain SQL: the same hash and the same steps."""
    h = "(CAST(r.rep AS UBIGINT) * 2654435761 + CAST(f.frame AS UBIGINT) * 2246822519 + <seed>) % 4294967296"
    for shift, factor in ((15, 2246822519), (13, 3266489917), (16, 1)):
        h = f"list_transform([{h}], lambda h: (xor(CAST(h AS UBIGINT), CAST(h AS UBIGINT) >> {shift}) * CAST({factor} AS UBIGINT)) % 4294967296)[1]"
    steps = " + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in POISSON)
    return f"SELECT rep, frame, CASE WHEN rep = 0 THEN 1 ELSE {steps} END AS times FROM (SELECT r.rep, f.frame, ({h}) / 4294967296.0 AS u FROM (SELECT unnest(range(0, <reps> + 1)) AS rep) r CROSS JOIN (SELECT DISTINCT frame FROM {{series}}) f) w"


PLAIN = f"""
    WITH draws AS ({_steps()}),
    one AS (SELECT rep, run_id, sum(times) AS w, sum(times * v) AS s, sum(times * v * v) AS ss FROM draws JOIN {{series}} USING (frame) GROUP BY rep, run_id),
    two AS (SELECT d.rep, x.run_id AS i, y.run_id AS j, sum(d.times * x.v * y.v) AS xy FROM draws d JOIN {{series}} x ON x.frame = d.frame JOIN {{series}} y ON y.frame = d.frame AND x.run_id < y.run_id GROUP BY d.rep, x.run_id, y.run_id),
    corr AS (
        SELECT t.rep, t.i, t.j, CASE WHEN a.ss / a.w - power(a.s / a.w, 2) > 1E-20 AND b.ss / b.w - power(b.s / b.w, 2) > 1E-20
            THEN (t.xy / a.w - a.s / a.w * b.s / b.w) / sqrt((a.ss / a.w - power(a.s / a.w, 2)) * (b.ss / b.w - power(b.s / b.w, 2))) END AS c
        FROM two t JOIN one a ON a.rep = t.rep AND a.run_id = t.i JOIN one b ON b.rep = t.rep AND b.run_id = t.j)
    SELECT i, j, max(CASE WHEN rep = 0 THEN c END) AS estimate, quantile_cont(CASE WHEN rep > 0 THEN c END, 0.025) AS lo, quantile_cont(CASE WHEN rep > 0 THEN c END, 0.975) AS hi,
        avg(CASE WHEN rep > 0 THEN c END) - max(CASE WHEN rep = 0 THEN c END) AS bias, stddev_pop(CASE WHEN rep > 0 THEN c END) AS se
    FROM corr GROUP BY i, j"""
