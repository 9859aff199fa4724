"""Operators that are sequential or spectral by nature: a group's ordered rows in one pandas call, groups in parallel.

Candidates are thinned in SQL first, so a call sees a run's peaks rather than its frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick_peaks(frames: np.ndarray, values: np.ndarray, distance: int) -> np.ndarray:
    """Positions of the peaks that stay when the highest goes first and removes all closer than `distance` (ties: the earlier)."""
    keep = np.ones(len(frames), dtype=bool)
    for i in np.lexsort((frames, -values)):
        if keep[i]:
            near = (np.abs(frames - frames[i]) < distance) & (np.arange(len(frames)) != i)
            keep[near] = False
    return np.flatnonzero(keep)


def peaks(candidates: DataFrame, least_distance: int = 50) -> DataFrame:
    """(run_id, frame, strength) from candidates (run_id, frame, v, high, low, n); without a high peak, low ones at half the distance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        distance = max(least_distance, int(pdf["n"].iloc[0]) // 30)
        tall = pdf[pdf["v"] >= pdf["high"]]
        if tall.empty:
            tall, distance = pdf, distance // 2
        at = pick_peaks(tall["frame"].to_numpy(), tall["v"].to_numpy(), distance)
        return tall.iloc[at][["run_id", "frame", "v"]].rename(columns={"v": "strength"})

    return candidates.groupBy("run_id").applyInPandas(run, "run_id string, frame int, strength double")


def greedy_clusters(points: DataFrame, least: int = 12, most: int = 14) -> DataFrame:
    """(run_id, atom_id, group_id) of one frame's points (run_id, atom_id, x, y, z): each cluster grows from the first free atom to its nearest ones; a last cluster below `least` joins the nearest centres."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("atom_id")
        xyz, group = pdf[["x", "y", "z"]].to_numpy(), np.full(len(pdf), -1)
        k = 0
        while (free := np.flatnonzero(group < 0)).size >= least or (k == 0 and free.size):
            d = np.linalg.norm(xyz[free] - xyz[free[0]], axis=1)
            group[free[np.lexsort((free, d))[:most]]] = k
            k += 1
        centres = np.array([xyz[group == g].mean(axis=0) for g in range(k)])
        for i in np.flatnonzero(group < 0):
            group[i] = int(np.argmin(np.linalg.norm(centres - xyz[i], axis=1)))
        return pd.DataFrame({"run_id": pdf["run_id"], "atom_id": pdf["atom_id"], "group_id": group.astype("int32")})

    return points.groupBy("run_id").applyInPandas(run, "run_id string, atom_id int, group_id int")


def strongest_path(links: DataFrame, start: str, hops: int = 4) -> DataFrame:
    """(hop, from_id, to_id, strength): from `start`, the strongest link to a node not yet on the path, one join a hop."""
    spark = links.sparkSession
    path = spark.createDataFrame([(0, None, start, None, [start])], "hop int, from_id string, to_id string, strength double, seen array<string>")
    steps = [path]
    for hop in range(1, hops + 1):
        near = path.select(F.col("to_id").alias("at"), "seen").join(links.select("from_id", F.col("to_id").alias("next"), "strength"), F.col("at") == F.col("from_id"))
        near = near.where(~F.array_contains("seen", F.col("next"))).orderBy(F.desc(F.round("strength", 9)), "next").limit(1)
        path = near.select(F.lit(hop).alias("hop"), "from_id", F.col("next").alias("to_id"), "strength", F.array_append("seen", F.col("next")).alias("seen"))
        steps.append(path)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out.where("hop > 0").drop("seen")
