"""Resampling by weight vectors: the weights' law, and blocks of groups against one block."""

from __future__ import annotations

import numpy as np
import pandas as pd

from strandflow.operators import resample


def test_weights_are_poisson_and_repeat():
    w = resample.weights(500, np.arange(2000), 42)
    assert (w == resample.weights(500, np.arange(2000), 42)).all() and (w[:, 0] == 1).all()
    assert abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.08 and abs(np.corrcoef(w[0, 1:], w[1, 1:])[0, 1]) < 0.15


def test_blocks_of_groups_change_nothing(spark, monkeypatch):
    g = np.random.default_rng(3)
    rows = pd.concat([pd.DataFrame({"run_id": f"g{k}", "frame": np.arange(90, dtype="int32"), "v": g.normal(size=90)}) for k in range(5)])
    rows = rows[~((rows.run_id == "g3") & (rows.frame > 70))]
    series = spark.createDataFrame(rows).repartition(3)
    want = resample.bootstrap_correlation(series, reps=50).toPandas().sort_values(["i", "j"]).reset_index(drop=True)
    monkeypatch.setattr(resample, "GROUPS", 2)
    got = resample.bootstrap_correlation(series, reps=50).toPandas().sort_values(["i", "j"]).reset_index(drop=True)
    assert len(want) == 10
    pd.testing.assert_frame_equal(got, want)
    held = {k: x.set_index("frame").v for k, x in rows.groupby("run_id")}
    for r in want.itertuples():
        if "g3" not in (r.i, r.j):
            assert np.isclose(r.estimate, np.corrcoef(held[r.i], held[r.j])[0, 1])
            assert r.lo < r.hi and abs(r.se - 0.1) < 0.05


def test_resampling_of_nothing(spark):
    assert resample.bootstrap_correlation(spark.createDataFrame([], "run_id string, frame int, v double")).count() == 0
