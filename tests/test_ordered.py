"""Operators along a run in blocks against plain loops over the run."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from strandflow.operators import ordered as o
from strandflow.operators import sequential


def frame(spark, v, run="r"):
    return spark.createDataFrame(pd.DataFrame({"run_id": run, "frame": np.arange(len(v), dtype="int32"), "v": np.asarray(v, dtype=float)}), "run_id string, frame int, v double")


@pytest.mark.parametrize(("distance", "block"), [(5, 100_000), (5, 5), (13, 20), (50, 64)])
def test_peaks_from_left_to_right(spark, distance, block):
    v = np.random.default_rng(3).normal(size=3000)
    v[1000:1400] = 0
    rises = [i for i in range(1, len(v) - 1) if v[i] > 0.4 and v[i] > v[i - 1] and v[i] > v[i + 1]]
    want = []
    for i in rises:
        if not want or i - want[-1] >= distance:
            want.append(i)
    c = spark.createDataFrame([("r", i, float(v[i])) for i in rises] + [("s", 7, 1.0), ("s", 8, 2.0)], "run_id string, frame int, v double").repartition(3)
    got = o.left_to_right(c, distance, block).toPandas()
    assert sorted(got[got.run_id == "r"].frame) == want
    assert got[got.run_id == "s"].frame.tolist() == [7]


def box(v, i, w):
    x = v[max(0, i - w) : i + w + 1]
    span = x.max() - x.min()
    if len(x) < 3 or span < 1e-10:
        return 1.0
    n = e = 0.0
    for s in range(2, 11):
        if s < len(x):
            ids = np.floor((x - x.min()) / (span / s) + 1e-9)
            n += np.log(1 + (ids[1:] != ids[:-1]).sum())
            e += np.log(span / s)
    return min(3.0, max(1.0, -n / e))


@pytest.mark.parametrize("block", [20_000, 64])
def test_box_fractal_of_every_window(spark, block):
    g = np.random.default_rng(9)
    runs = {"noise": g.normal(size=300) * 0.1, "flat": np.full(60, 2.0), "short": np.array([1.0, 3.0, 2.0]), "steps": np.repeat(g.normal(size=40), 5)}
    series = None
    for run, v in runs.items():
        series = frame(spark, v, run) if series is None else series.unionByName(frame(spark, v, run))
    got = o.box_fractal(series, 20, block=block).toPandas()
    for run, v in runs.items():
        own = got[got.run_id == run].sort_values("frame")
        assert own.frame.tolist() == list(range(len(v)))
        assert np.allclose(own.fd, [box(v, i, 20) for i in range(len(v))])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_granger_is_that_of_least_squares(spark, order):
    r = np.random.default_rng(4)
    x = r.normal(size=400)
    y = np.concatenate(([0], x[:-1])) + 0.1 * r.normal(size=400)
    runs = {"x": x, "y": y, "z": r.normal(size=350) + 3, "same": np.zeros(400)}
    series = None
    for run, v in runs.items():
        series = frame(spark, v, run) if series is None else series.unionByName(frame(spark, v, run))
    lag = o.lagged(order)
    got = o.granger(order)(lagged=lag(series=series)).toPandas()
    assert np.allclose(got.sort_values(["i", "j"]).f, o.granger(order)(lagged=lag(series=series, block=40)).toPandas().sort_values(["i", "j"]).f)
    mine = {(a.i, a.j): a.f for a in got.itertuples()}
    assert len(mine) == 12
    for (i, j), f in mine.items():
        n = min(len(runs[i]), len(runs[j]))
        a, b = runs[i][:n], runs[j][:n]
        own = np.column_stack([b[order - k : n - k] for k in range(1, order + 1)])
        both = np.column_stack([own, *(a[order - k : n - k] for k in range(1, order + 1))])
        rss = [float(((b[order:] - m @ np.linalg.lstsq(m, b[order:], rcond=None)[0]) ** 2).sum()) for m in (own, both)]
        want = (rss[0] - rss[1]) / order / (rss[1] / (n - order - 2 * order)) if rss[1] > 1e-12 else 0.0
        assert np.isclose(f, want, rtol=1e-6, atol=1e-6), (i, j)
    assert mine["x", "y"] > 100 > mine["y", "x"]


def test_greedy_clusters_take_the_nearest(spark):
    g = np.random.default_rng(1)
    xyz = g.normal(size=(30, 3)) * 5
    points = spark.createDataFrame([("r", i, *map(float, p)) for i, p in enumerate(xyz)], "run_id string, atom_id int, x double, y double, z double")
    got = sequential.greedy_clusters(points, least=4, most=6).toPandas().sort_values("atom_id").group_id.to_numpy()
    free, want, k = list(range(30)), np.full(30, -1), 0
    while len(free) >= 4:
        near = sorted(free, key=lambda i: (np.linalg.norm(xyz[i] - xyz[free[0]]), i))[:6]
        want[near] = k
        free = [i for i in free if want[i] < 0]
        k += 1
    assert (got[want >= 0] == want[want >= 0]).all() and (got >= 0).all()


def test_the_strongest_path_never_returns(spark):
    links = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 1.0), ("b", "c", 0.5), ("b", "d", 0.4), ("c", "d", 0.3), ("a", "d", 0.2)], "from_id string, to_id string, strength double")
    got = [tuple(r) for r in sequential.strongest_path(links, "a").orderBy("hop").collect()]
    assert got == [(1, "a", "b", 0.9), (2, "b", "c", 0.5), (3, "c", "d", 0.3)]
