"""Sliding windows and filters by arrays: no window is visited row by row, and nulls, blocks and short runs change nothing."""

from __future__ import annotations

import numpy as np
import pytest

from strandflow.operators import detect, flow, network, series, windows

N = 130
RNG = np.random.default_rng(17)


@pytest.fixture(scope="module")
def held(spark):
    v = RNG.normal(3, 1, N)
    v[40:70] = 7.0
    gone = {5, 6, *range(90, 125)}
    rows = [("a", f, None if f in gone else float(v[f]), float(f % 7), 1.0) for f in range(N)] + [("b", f, 2.0, 1.0, 1.0) for f in range(3)]
    return spark.createDataFrame(rows, "run_id string, frame int, v double, y double, z double"), np.array([np.nan if f in gone else v[f] for f in range(N)])


def of_run(df, name):
    return [r[name] for r in df.where("run_id = 'a'").orderBy("frame").collect()]


def alike(got, want):
    return len(got) == len(want) and all((g is None and np.isnan(w)) or (g is not None and np.isclose(g, w)) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("block", [None, 33])
def test_moments_against_a_loop(held, block):
    df, v = held
    part = lambda i, b, a: v[max(0, i - b) : i + a + 1][~np.isnan(v[max(0, i - b) : i + a + 1])]
    seen = [part(i, 8, 8) for i in range(N)]
    mean, std = (np.array([f(p) if len(p) else np.nan for p in seen]) for f in (np.mean, np.std))
    rolled = series.ROLLING(series=df, w=8, block=block)
    assert alike(of_run(rolled, "mean"), mean) and alike(of_run(rolled, "std"), std) and np.isnan(mean).any()
    z = np.where(std > 1e-10, abs(v - mean) / np.where(std > 1e-10, std, 1), 0)
    assert alike(of_run(series.LOCAL_Z(series=df, w=8, block=block), "z"), np.where(std > 1e-10, z, 0))
    late = [part(i, 8, 7) for i in range(N)]
    z = [abs(v[i] - p.mean()) / p.std() if 8 <= i < N - 8 and len(p) and p.std() > 1e-10 else 0 for i, p in enumerate(late)]
    assert alike(of_run(detect.CENTRED_Z(series=df, w=8, w1=7, block=block), "z"), z)
    path = df.withColumnRenamed("v", "x")
    other = np.arange(N) % 7
    want = [std[i] ** 2 + other[max(0, i - 8) : i + 9].var() for i in range(N)]
    assert alike(of_run(flow.TENSION(path=path, w=8, block=block), "rho_t"), want)
    grouped = path.selectExpr("run_id", "'k' AS kind", "3 AS group_id", "frame", "x", "y", "z")
    assert alike(of_run(flow.GROUP_TENSION(centres=grouped, h=8, block=block), "rho_t"), want)


@pytest.mark.parametrize("block", [None, 33])
def test_a_filter_leaves_nulls_out_as_its_statement_does(held, block):
    df, v = held
    k = np.arange(-12, 13)
    w = np.exp(-(k**2) / 18.0)
    x = np.pad(v, 12, mode="symmetric")
    want = [np.nansum(w * x[i : i + 25]) / w.sum() if not np.isnan(x[i : i + 25]).all() else np.nan for i in range(N)]
    assert alike(of_run(series.GAUSSIAN_FILTER(series=df, sigma=3.0, reach=12, block=block), "v"), want) and np.isnan(want).any()


def test_no_sliding_window_of_the_engine(held):
    df = held[0]
    path = df.withColumnRenamed("v", "x")
    for made in (series.ROLLING(series=df), series.LOCAL_Z(series=df), series.GAUSSIAN_FILTER(series=df), detect.CENTRED_Z(series=df), flow.TENSION(path=path)):
        assert "Window [" not in made._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("block", [None, 33])
def test_synchrony_leaves_out_rows_with_a_null(held, block):
    df, v = held
    pair = df.selectExpr("run_id", "frame", "v AS rmsd", "CASE WHEN frame <> 20 THEN y END AS rg")
    other = np.where(np.arange(N) == 20, np.nan, np.arange(N) % 7)
    want = []
    for i in range(N):
        a, b = v[max(0, i - 8) : i + 9], other[max(0, i - 8) : i + 9]
        both = ~np.isnan(a) & ~np.isnan(b)
        if np.isnan(a).all():
            want.append(0.0)
        else:
            c = ((a[both] - a[both].mean()) * (b[both] - b[both].mean())).mean()
            want.append(abs(c / (np.nanstd(a) * np.nanstd(b))) if np.nanstd(a) > 1e-10 else 0.0)
    assert alike(of_run(flow.SYNCHRONY(pair=pair, w=8, block=block), "sigma_s"), want)


@pytest.mark.parametrize("block", [None, 71])
def test_lag_profile_with_gaps_nulls_and_constants_makes_no_row_for_each_lag(spark, held, block, tmp_path):
    g = np.random.default_rng(4)
    a, b, c = g.normal(size=N), g.normal(size=N), np.full(N, 0.3)
    a[11], b[100] = np.nan, np.nan
    c[115:] = g.normal(size=15)
    frames = {"a": range(N), "b": [f for f in range(N) if f not in (50, 51)], "c": range(N)}
    values = {"a": a, "b": b, "c": c}
    rows = [(k, f, None if np.isnan(values[k][f]) else float(values[k][f])) for k, fs in frames.items() for f in fs]
    spark.createDataFrame(rows, "run_id string, frame int, v double").write.parquet(f"{tmp_path}/s")
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "i string, j string, distance double")
    df = network.LAG_PROFILE(series=spark.read.parquet(f"{tmp_path}/s"), pairs=pairs, lags=8, step=5, block=block)
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.i, r.j, r.lag): (r.corr, r.n) for r in df.collect()}
    want = {}
    for i, j in (("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")):
        for lag in range(0, 40, 5):
            at = [f for f in frames[i] if f + lag in frames[j]]
            x, y = values[i][at], values[j][[f + lag for f in at]]
            both = ~np.isnan(x) & ~np.isnan(y)
            sd = np.nanstd(x - x[~np.isnan(x)][0]), np.nanstd(y - y[~np.isnan(y)][0])
            cov = ((x[both] - x[both].mean()) * (y[both] - y[both].mean())).mean()
            want[i, j, lag] = (cov / (sd[0] * sd[1]) if min(sd) > 1e-10 else 0.0, len(at))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert got["c", "b", 15][0] == 0.0 and got["c", "b", 0][0] != 0.0


def test_means_round_as_sums_in_the_order_of_rows():
    x = np.round(np.random.default_rng(2).uniform(0, 100, 60), 2)
    _, mean, _ = windows.moments(x, np.ones(60, dtype=bool), 12, 12)
    assert mean.tolist() == [_in_order(x[max(0, i - 12) : i + 13]) for i in range(60)]


def _in_order(x) -> float:
    total = 0.0
    for v in x.tolist():
        total += v
    return total / len(x)
