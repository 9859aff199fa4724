"""Operators that go along a run in order, in blocks of frames: no task sees a run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.plans.op import Op, halo_blocks

BLOCK = 100_000


def _kept(frames: np.ndarray, at: int, distance: int) -> list[int]:
    """Places kept from the first frame at or after `at`, each next one `distance` after the last at least."""
    out, k = [], int(np.searchsorted(frames, at))
    while k < len(frames):
        out.append(k)
        k = int(np.searchsorted(frames, frames[k] + distance))
    return out


def left_to_right(candidates: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """(run_id, frame, v): candidates kept from left to right, each at least `distance` after the last one kept.

    What a block does depends on how far into it the last peak before still reaches, `distance` cases at most. Every block tells where
    it leaves off for each case; these small tables are followed block after block, and then each block is thinned from its own start.
    """
    size = max(block, distance)
    c = candidates.select("run_id", F.col("frame").cast("long").alias("frame"), "v").withColumn("part", F.floor(F.col("frame") / size))

    def cases(pdf: pd.DataFrame) -> pd.DataFrame:
        frames, part = np.sort(pdf["frame"].to_numpy()), int(pdf["part"].iloc[0])
        start, out = part * size, []
        # a case per first candidate that a start in [start, start + distance] can meet
        upto, k = [], 0
        while k < len(frames) and (not upto or upto[-1] < start + distance):
            last = frames[_kept(frames, frames[k], distance)[-1]]
            upto.append(int(frames[k]))
            out.append(int(max(0, last + distance - start - size)))
            k += 1
        return pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]], "part": [part], "upto": [upto], "reach": [out]})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, before, reach = pdf.sort_values("part"), [], None, 0
        for part, upto, out in zip(pdf["part"], pdf["upto"], pdf["reach"], strict=True):
            reach = reach if before is not None and part == before + 1 else 0
            at.append(part * size + reach)
            k = int(np.searchsorted(upto, at[-1]))
            reach, before = (int(out[k]) if k < len(upto) else 0), part
        return pd.DataFrame({"run_id": pdf["run_id"], "part": pdf["part"], "at": at})

    tables = c.groupBy("run_id", "part").applyInPandas(cases, "run_id string, part long, upto array<long>, reach array<long>")
    starts = tables.groupBy("run_id").applyInPandas(follow, "run_id string, part long, at long")

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        return pdf.iloc[_kept(pdf["frame"].to_numpy(), int(pdf["at"].iloc[0]), distance)][["run_id", "frame", "v"]]

    return c.join(starts, ["run_id", "part"]).groupBy("run_id", "part").applyInPandas(thin, "run_id string, frame int, v double")


def box_fractal(series: DataFrame, window: int = 50, scales: tuple[int, int] = (2, 10), block: int = 20_000) -> DataFrame:
    """(run_id, frame, fd) of the window [-w, w], cut at the run's ends: minus the ratio of the sums of log crossings and log box sizes, 1 to 3.

    The crossings of a box size are the changes of box from one frame to the next, and one for the start."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        v, own = pdf["v"].to_numpy(), np.flatnonzero(pdf["own"].to_numpy())
        padded = np.concatenate([np.full(window, np.nan), v, np.full(window, np.nan)])
        out = np.ones(len(own))
        for lo in range(0, len(own), 2048):
            x = np.lib.stride_tricks.sliding_window_view(padded, 2 * window + 1)[own[lo : lo + 2048]]
            there = ~np.isnan(x)
            low, size = np.nanmin(x, axis=1), there.sum(axis=1)
            span = np.nanmax(x, axis=1) - low
            counts, lengths, used = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), int)
            for s in range(scales[0], scales[1] + 1):
                eps = np.where(span > 0, span, 1) / s
                box = np.floor((np.where(there, x, low[:, None]) - low[:, None]) / eps[:, None] + 1e-9)
                crossings = 1 + ((box[:, 1:] != box[:, :-1]) & there[:, 1:] & there[:, :-1]).sum(axis=1)
                use = s < size
                counts, lengths, used = counts + np.where(use, np.log(crossings), 0), lengths + np.where(use, np.log(eps), 0), used + use
            fit = (size >= 3) & (span >= 1e-10) & (used > 1) & (lengths != 0)
            out[lo : lo + 2048] = np.where(fit, np.clip(-counts / np.where(fit, lengths, 1), 1, 3), 1)
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[own], "frame": pdf["frame"].iloc[own], "fd": out})

    return halo_blocks(series, window, block=block).groupBy("run_id", "blk").applyInPandas(run, "run_id string, frame int, fd double")


def _swept(text: str, terms: list[str], k: str, keep: str) -> tuple[str, list[str]]:
    """A SELECT that takes the term k out of the products of all others, by one step of elimination."""
    rest = [t for t in terms if t != k]
    product = lambda a, b: f"g_{min(a, b)}_{max(a, b)}"
    less = ", ".join(f"{product(a, b)} - CASE WHEN {product(k, k)} > 1E-10 THEN {product(a, k)} * {product(b, k)} / {product(k, k)} ELSE 0 END AS {product(a, b)}" for i, a in enumerate(rest) for b in rest[i:])
    return f"SELECT i, j, n, {keep}{less} FROM ({text}) {k}_", rest


def lagged(order: int) -> Op:
    """(run_id, frame, v0, v1..): a value and those `order` frames before, where all exist."""
    past = ", ".join(f"lag(v, {k}) OVER w AS v{k}" for k in range(1, order + 1))
    return Op(f"lagged_{order}", f"SELECT run_id, frame, {', '.join(f'v{k}' for k in range(order + 1))} FROM (SELECT run_id, frame, own, v AS v0, {past} FROM {{series}} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame)) l WHERE own AND v{order} IS NOT NULL", halo=("series", str(order)))


def granger(order: int) -> Op:
    """(i, j, f): how much i's past adds to j's own past in predicting j, as an F statistic without intercept.

    Pairs are joined on frames and folded at once into sums of products; both regressions are then eliminations on these few sums."""
    own, other = [f"y{k}" for k in range(1, order + 1)], [f"x{k}" for k in range(1, order + 1)]
    terms = sorted(["y0", *own, *other])
    column = lambda t: f"{t[0]}.v{t[1:]}"
    text = f"SELECT x.run_id AS i, y.run_id AS j, count(*) AS n, {', '.join(f'sum({column(a)} * {column(b)}) AS g_{a}_{b}' for i, a in enumerate(terms) for b in terms[i:])} FROM {{lagged}} y JOIN {{lagged}} x ON x.frame = y.frame AND x.run_id <> y.run_id GROUP BY x.run_id, y.run_id"
    for k in own:
        text, terms = _swept(text, terms, k, "")
    for i, k in enumerate(other):
        text, terms = _swept(text, terms, k, "own, " if i else "g_y0_y0 AS own, ")
    return Op(f"granger_{order}", f"SELECT i, j, CASE WHEN n > {2 * order} AND g_y0_y0 > 1E-12 THEN (own - g_y0_y0) / {order} / (g_y0_y0 / (n - {2 * order})) ELSE 0 END AS f FROM ({text}) e")
