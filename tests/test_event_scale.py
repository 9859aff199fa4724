"""Boundaries and events meet frames by equality, and no run is sorted by one task."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pytest

from strandflow.operators import detect, events, impact, network

N = 260


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    g, at = np.random.default_rng(5), tmp_path_factory.mktemp("event_scale")
    f = np.arange(N, dtype="int32")
    made = {
        "score": pd.DataFrame({"run_id": "r", "frame": f, "score": g.uniform(0, 1, N)}),
        "bounds": pd.DataFrame({"run_id": "r", "frame": np.int32([0, 7, 90, 130, 259]), "strength": 1.0}),
        "z": pd.DataFrame({"frame": np.tile(f[1:], 3), "atom_id": np.repeat(np.arange(3, dtype="int32"), N - 1), "step": g.uniform(0, 1, 3 * (N - 1)), "z": 0.0}),
        "events": pd.DataFrame({"run_id": "r", "event_id": np.int32([0, 1, 2, 3]), "start_frame": np.int32([0, 35, 80, 255]), "end_frame": np.int32([0, 44, 80, 259])}),
        "flow": pd.DataFrame({"run_id": "r", "frame": f, "lf_mag": g.uniform(0, 1, N)}),
        "tension": pd.DataFrame({"run_id": "r", "frame": f, "rho_t": g.uniform(0, 1, N)}),
        "synchrony": pd.DataFrame({"run_id": "r", "frame": f, "sigma_s": g.uniform(0, 1, N)}),
    }
    made["patterns"] = made["events"].assign(pattern="cascade", n_bonds=2)
    for k, v in made.items():
        spark.createDataFrame(v).write.parquet(f"{at}/{k}")
    return {k: spark.read.parquet(f"{at}/{k}") for k in made}, made


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def joins_by_frame(df) -> bool:
    text = plan_of(df)
    return any("frame" in k for k in re.findall(r"(?:SortMergeJoin|HashJoin) \[(.*?)\],", text)) and "NestedLoop" not in text and not re.search(r"Join.*(frame#\d+ >|>= \(?frame|frame#\d+ <)", text)


def test_boundaries_reach_frames_by_equality(world):
    made, held = world
    df = detect.LOCAL_SCORE(boundary_score=made["score"], boundaries=made["bounds"])
    assert joins_by_frame(df)
    got = df.toPandas().sort_values("frame")
    x, b = held["score"], held["bounds"].frame.to_numpy()
    off = x.frame.to_numpy()[:, None] - b[None]
    want = x.score + np.where((off >= -50) & (off < 50), np.exp(-(off**2) / 800.0), 0).sum(1)
    assert len(got) == N and np.allclose(got.score, want)


def test_evidence_meets_steps_by_equality_and_blocks_change_nothing(world):
    made, held = world
    assert joins_by_frame(impact.EVIDENCE(events=made["events"], z=made["z"]))
    step = held["z"].pivot(index="frame", columns="atom_id", values="step")
    gain = step.diff().abs().fillna(0)
    want = {e.event_id: (step.loc[e.start_frame : e.end_frame].max().max(), gain.loc[e.start_frame : e.end_frame].max().max()) for e in held["events"].itertuples() if e.end_frame > 0}
    for block in (None, 40):
        got = {r.event_id: (r.max_velocity, r.max_acceleration) for r in impact.EVIDENCE(events=made["events"], z=made["z"], block=block).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_event_anomaly_sorts_blocks_and_not_runs(world):
    made, held = world
    given = {k: made[k] for k in ("patterns", "flow", "tension", "synchrony")}
    assert "blk" in "".join(re.findall(r"Window \[.*", plan_of(impact.EVENT_ANOMALY(**given))))
    v = held["flow"].lf_mag.to_numpy()
    want = {e.event_id: (abs(v[e.start_frame] - v[max(e.start_frame - 1, 0)]), abs(v[e.start_frame] - v.mean()) / v.std()) for e in held["events"].itertuples()}
    for block in (None, 40):
        got = {r.event_id: (r.jump, r.z) for r in impact.EVENT_ANOMALY(**given, block=block).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_bootstrap_statistics_read_the_draws_once(spark, world):
    made, held = world
    series = made["flow"].selectExpr("run_id", "cast(frame as int) AS frame", "lf_mag AS v")
    df = network.BOOTSTRAP_STATISTICS(series=series, reps=3)
    assert plan_of(df).count("md5(") <= 2  # a projection, and the filter that Spark infers for the join
    v, n = held["flow"].lf_mag.to_numpy(), N
    picks = [np.array([int(hashlib.md5(f"42|{rep}|{k}".encode()).hexdigest()[:8], 16) % n for k in range(n)]) for rep in (1, 2, 3)]
    got = {r.stat: (r.estimate, r.lo, r.hi, r.se) for r in df.collect()}
    for stat, f in {"mean": np.mean, "var": np.var, "std": np.std, "median": np.median, "max": np.max, "min": np.min}.items():
        x = np.array([f(v[p]) for p in picks])
        assert np.allclose(got[stat], (f(v), *np.percentile(x, [2.5, 97.5]), x.std()))


def test_peaks_shuffle_an_event_once_and_nulls_are_no_peaks(spark, tmp_path):
    g = np.random.default_rng(9)
    rows = [(e, k, t, 60, None if (e, t % 9) == (1, 4) else float(g.integers(0, 5) + (t == 30) * 9 * (e < 2))) for e in range(3) for k in "ab" for t in range(60)]
    rows += [(7, "a", t, 12, [None, 2.0, 2.0][min(t, 2)]) for t in range(12)]
    spark.createDataFrame(rows, "event_id int, g string, t int, n int, v double").write.parquet(f"{tmp_path}/inside")
    inside = spark.read.parquet(f"{tmp_path}/inside")
    df = events.PEAKS(inside=inside)
    assert plan_of(df).count("Scan parquet") == 1
    got = {(r.event_id, r.g, r.place): (r.delay, r.peak) for r in df.collect()}
    want = {}
    for e, k in {(r[0], r[1]) for r in rows}:
        x = {t: v for a, b, t, _, v in rows if (a, b) == (e, k) and v is not None}
        line = np.mean(list(x.values())) + np.std(list(x.values()))
        kept = []
        for t in sorted((t for t in x if t - 1 in x and t + 1 in x and x[t] > max(x[t - 1], x[t + 1]) and x[t] >= line), key=lambda t: (-x[t], t)):
            if all(abs(t - o) >= 5 for o in kept):
                kept.append(t)
        for n, t in enumerate(sorted(kept)[:5] or [min(x, key=lambda t: (-x[t], t))]):
            want[e, k, n + 1] = (t, x[t])
    assert got == want and (7, "a", 1) in want
