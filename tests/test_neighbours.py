"""Neighbours by tiles against all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandflow.operators import neighbours as nb


def table(spark, x, run="r"):
    return pd.DataFrame({"run_id": run, "frame": np.arange(len(x), dtype="int32"), "x": x.tolist()})


def brute(x, k):
    """Of each point the k nearest others: mean distance, and the first nearest."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, axis=1)[:, :k]
    return np.where(np.isfinite(near), near, 0).sum(axis=1) / np.isfinite(near).sum(axis=1), np.lexsort((np.arange(len(x))[None].repeat(len(x), 0), np.round(d, 12)))[:, 0], d


@pytest.fixture(scope="module")
def clouds():
    g = np.random.default_rng(2)
    return {
        "even": g.normal(size=(900, 3)),
        "copies": np.concatenate([np.zeros((300, 3)), g.normal(size=(200, 3)), np.repeat(g.normal(size=(40, 3)), 6, axis=0)]),
        "line": np.column_stack([np.zeros(400), np.zeros(400), g.normal(size=400)]),
        "far": np.concatenate([g.normal(size=(300, 3)), g.normal(size=(8, 3)) + 1e3]),
        "two": g.normal(size=(2, 3)),
        "grid": np.stack(np.meshgrid(*[np.arange(6.0)] * 3), axis=-1).reshape(-1, 3),
    }


@pytest.mark.parametrize(("k", "cell"), [(20, 1024), (3, 16), (1, 8)])
def test_means_of_the_k_nearest(spark, clouds, k, cell):
    rows = pd.concat([table(spark, x, run) for run, x in clouds.items()])
    points = spark.createDataFrame(rows, "run_id string, frame int, x array<double>").select("run_id", "frame", *[F.col("x")[i].alias(c) for i, c in enumerate("abc")]).repartition(4)
    got = nb.knn_mean(points, k, cell).toPandas()
    for run, x in clouds.items():
        own = got[got.run_id == run].sort_values("frame")
        assert own.frame.tolist() == list(range(len(x)))
        assert np.allclose(own.mean_distance, brute(x, k)[0]), run


@pytest.mark.parametrize("cell", [1024, 16])
def test_pairs_within_a_radius(spark, clouds, cell):
    rows = pd.concat([table(spark, x, run) for run, x in clouds.items() if run != "copies"] + [table(spark, clouds["copies"][250:], "copies")])
    points = spark.createDataFrame(rows, "run_id string, frame int, x array<double>").select("run_id", "frame", *[F.col("x")[i].alias(c) for i, c in enumerate("abc")])
    got = nb.within(points, 0.3, cell).toPandas()
    for run, x in (clouds | {"copies": clouds["copies"][250:]}).items():
        own = got[got.run_id == run]
        assert sorted(zip(own.i, own.j, strict=True)) == sorted(map(tuple, np.argwhere(brute(x, 1)[2] < 0.3).tolist())), run


@pytest.mark.parametrize("cell", [1024, 16])
def test_shares_of_false_neighbours(spark, cell):
    g = np.random.default_rng(6)
    runs = {"sine": np.sin(np.arange(220) / 5) + g.normal(0, 0.01, 220), "noise": g.normal(size=150), "steps": np.round(g.normal(size=180), 1)}
    taus = {"sine": 4, "noise": 1, "steps": 2}
    series = spark.createDataFrame(pd.concat([pd.DataFrame({"run_id": r, "frame": np.arange(len(v), dtype="int32"), "v": v}) for r, v in runs.items()]))
    delays = spark.createDataFrame(list(taus.items()), "run_id string, tau int")
    got = {(r.run_id, r.m): (r.n, r.share) for r in nb.false_shares(series, delays, 5, cell=cell).collect()}
    for run, v in runs.items():
        for m in range(1, 6):
            tau = taus[run]
            n = len(v) - (m - 1) * tau
            x = np.column_stack([v[k * tau : k * tau + n] for k in range(m)])
            _, first, d = brute(x, 1)
            false = sum(1 for i, j in enumerate(first) if d[i, j] > 1e-10 and max(i, j) + m * tau < len(v) and abs(v[i + m * tau] - v[j + m * tau]) > 10 * d[i, j])
            assert got[run, m][0] == n
            assert np.isclose(got[run, m][1], false / n), (run, m)


def test_no_pairs_are_joined(spark, clouds):
    points = spark.createDataFrame(table(spark, clouds["even"]), "run_id string, frame int, x array<double>").select("run_id", "frame", *[F.col("x")[i].alias(c) for i, c in enumerate("abc")])
    plan = nb.knn_mean(points)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "run_id string, frame int, a double, b double, c double")
    assert nb.knn_mean(none).count() == 0 and nb.within(none).count() == 0
    one = spark.createDataFrame([("r", 0, 1.0, 2.0, 3.0)], "run_id string, frame int, a double, b double, c double")
    assert nb.knn_mean(one).count() == 0 and nb.within(one).count() == 0
