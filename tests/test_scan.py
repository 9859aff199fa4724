"""Saturating recurrences by blocks against the fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from strandflow.operators import scan


def fold(d, recovery, fatigue):
    out, x = [], 0.0
    for k, v in enumerate(d):
        x = v * fatigue if k == 0 else min(1.0, x * (1 - recovery) + v * fatigue)
        out.append(x)
    return np.array(out)


@pytest.mark.parametrize(("n", "block"), [(1, 512), (700, 16), (5000, 7), (300_000, 512)])
def test_damage_is_the_fold(spark, n, block):
    g = np.random.default_rng(n)
    d = np.where(g.random(n) < 0.02, g.random(n), 0.0)
    rows = pd.DataFrame({"run_id": "r", "frame": np.arange(3, n + 3, dtype="int32"), "cluster_id": 0, "d": d})
    other = rows.iloc[::2].assign(cluster_id=1)
    got = scan.cumulative_damage(spark.createDataFrame(pd.concat([rows, other])).repartition(4), recovery=0.01, fatigue=1.7, block=block).toPandas()
    for c, own in ((0, rows), (1, other)):
        mine = got[got.cluster_id == c].sort_values("frame")
        assert mine.frame.tolist() == own.frame.tolist()
        assert np.allclose(mine.damage, fold(own.d.to_numpy(), 0.01, 1.7))


def test_damage_of_nothing(spark):
    assert scan.cumulative_damage(spark.createDataFrame([], "run_id string, frame int, cluster_id int, d double")).count() == 0
