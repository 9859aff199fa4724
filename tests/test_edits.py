"""Stress edited by events against a loop over the events."""

from __future__ import annotations

import numpy as np
import pandas as pd

from strandflow.operators import edits as o

EVENTS = [(0, 5, 9, "plastic_deformation"), (1, 5, 40, "dislocation_nucleation"), (2, 30, 30, "crack_initiation"), (3, 35, 70, "fatigue"), (4, 60, 180, "crack"), (5, 90, 95, "fatigue"), (6, 100, 100, "elastic"), (7, 195, 260, "plastic"), (8, 300, 310, "crack")]


def loop(v):
    v = v.copy()
    for _, start, last, kind in sorted(EVENTS, key=lambda e: (e[1], e[0])):
        if start >= len(v):
            continue
        end = min(last + 1, len(v))
        if "crack" in kind:
            v[start:] *= 1 - min(0.5, (end - start) / 100)
        elif "plastic" in kind:
            v[start:end] *= 1 + 0.02 * 0.2
        elif "dislocation" in kind:
            v[start:end] += 0.001 * 210.0 * 2.87 / max(1, end - start)
        elif "fatigue" in kind and v[start:end].mean() > 0.7:
            v[start:] *= max(0.3, 1 - 0.1 * (end - start) / len(v))
    return v


def test_later_edits_go_over_earlier_ones(spark):
    g = np.random.default_rng(1)
    runs = {"a": g.uniform(0.5, 2, 200), "b": g.uniform(0.1, 0.9, 120), "alone": g.uniform(0, 1, 30)}
    stress = spark.createDataFrame(pd.concat([pd.DataFrame({"run_id": r, "frame": np.arange(len(v), dtype="int32"), "v": v}) for r, v in runs.items()])).repartition(4)
    events = spark.createDataFrame([(r, *e) for r in ("a", "b", "no_series") for e in EVENTS], "run_id string, event_id int, start_frame int, end_frame int, kind string")
    got = o.edited(stress, events).toPandas()
    for run, v in runs.items():
        mine = got[got.run_id == run].sort_values("frame")
        assert mine.frame.tolist() == list(range(len(v)))
        assert np.allclose(mine.v, loop(v) if run != "alone" else v), run
    assert set(got.run_id) == set(runs)


def test_failure_by_events(spark):
    series = spark.createDataFrame([(r, f, 0.0) for r in ("a", "b", "c", "d") for f in range(50)], "run_id string, frame int, v double")
    rows = [("a", 0, 10, 12, "crack"), ("a", 1, 5, 6, "plastic"), *(("b", k, k, k, "plastic") for k in range(6)), ("c", 0, 1, 2, "fatigue")]
    events = spark.createDataFrame(rows, "run_id string, event_id int, start_frame int, end_frame int, kind string")
    got = {r.run_id: (r.mode, r.time_to_failure) for r in o.FAILURE_MODE(series=series, events=events).collect()}
    assert got == {"a": ("brittle_fracture", 20.0), "b": ("ductile_fracture", None), "c": ("fatigue_failure", None), "d": ("elastic_deformation", None)}
