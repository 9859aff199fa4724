"""Operators against numpy, blocks against whole runs, and the edge cases of short runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from strandflow.operators import detect, features, flow, network, sequential, series, spectrum
from strandflow.plans.op import Plan, Source
from strandflow.sources import files


def frame(spark, v, run="r"):
    return spark.createDataFrame(pd.DataFrame({"run_id": run, "frame": np.arange(len(v), dtype="int32"), "v": np.asarray(v, dtype=float)}), "run_id string, frame int, v double")


def path(spark, xyz):
    return spark.createDataFrame(pd.DataFrame({"run_id": "r", "frame": np.arange(len(xyz), dtype="int32"), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}), "run_id string, frame int, x double, y double, z double")


@pytest.fixture(scope="module")
def walk():
    return np.cumsum(np.random.default_rng(1).normal(size=(300, 3)), axis=0)


def column(df, name):
    return df.toPandas().sort_values("frame")[name].to_numpy()


def test_tension_is_the_trace_of_the_windowed_covariance(spark, walk):
    got = column(flow.TENSION(path=path(spark, walk), w=20), "rho_t")
    want = [walk[max(0, i - 20) : i + 21].var(axis=0).sum() for i in range(300)]
    assert np.allclose(got, want)


@pytest.mark.parametrize("block", [41, 64, 100])
def test_blocks_change_nothing(spark, walk, block):
    p = path(spark, walk)
    for op, col, given in ((flow.TENSION, "rho_t", {"path": p, "w": 20}), (flow.FLOW, "lf_mag", {"path": p})):
        assert np.allclose(column(op(**given), col), column(op(**given, block=block), col))
    v = frame(spark, walk[:, 0])
    for op, col in ((series.LOCAL_Z, "z"), (series.GRADIENT, "g"), (detect.EXTREMA, "extremum"), (detect.FRACTAL, "fd"), (detect.PEAK_CANDIDATES, "high")):
        assert np.allclose(column(op(series=v), col), column(op(series=v, block=block), col)), op.name


def test_coherence_by_algebra_equals_the_mean_cosine(spark, walk):
    step = np.diff(walk, axis=0)
    got = column(flow.COHERENCE(flow=flow.FLOW(path=path(spark, walk)), w=20, w1=19), "coherence")
    for i in (20, 100, 250):
        local = step[i - 20 : i + 20]
        unit = local / np.linalg.norm(local, axis=1, keepdims=True)
        mean = local.mean(axis=0)
        assert np.isclose(got[i], (unit @ (mean / np.linalg.norm(mean))).mean())
    assert got[0] == 0


def test_gradient_and_filters(spark):
    v = np.random.default_rng(2).normal(size=200)
    assert np.allclose(column(series.GRADIENT(series=frame(spark, v)), "g"), np.gradient(v))
    reach = series.gaussian_reach(3.0)
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / 18.0)
    want = np.convolve(np.pad(v, reach, mode="symmetric"), k / k.sum(), mode="valid")
    assert np.allclose(column(series.GAUSSIAN_FILTER(series=frame(spark, v), sigma=3.0, reach=reach), "v"), want)


def test_constant_series_have_no_score(spark):
    v = frame(spark, np.full(120, 3.0))
    assert set(column(series.LOCAL_Z(series=v), "z")) == {0.0}
    assert detect.CRITICAL_EVENTS(series=v).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9])
def test_short_runs(spark, n):
    xyz = np.arange(3.0 * n).reshape(n, 3)
    assert flow.FLOW(path=path(spark, xyz)).count() == max(0, n - 1)
    assert flow.TENSION(path=path(spark, xyz)).count() == n
    assert flow.ROTATION(flow=flow.FLOW(path=path(spark, xyz))).count() == max(0, n - 1)


def test_events_are_runs_above_the_threshold(spark):
    v = np.zeros(200)
    v[50:55], v[120] = 10, 9
    got = detect.CRITICAL_EVENTS(series=frame(spark, v)).toPandas().sort_values("start_frame")
    assert got[["start_frame", "end_frame"]].to_numpy().tolist() == [[50, 54], [120, 120]]


def test_lagged_copy_is_found(spark):
    v = np.random.default_rng(3).normal(size=300)
    both = frame(spark, v, "a").unionByName(frame(spark, np.roll(v, 20), "b"))
    pairs = spark.createDataFrame([("a", "b", 3.0)], "i string, j string, distance double")
    links = network.CAUSAL_LINKS(profile=network.LAG_PROFILE(series=both, pairs=pairs), pairs=pairs).toPandas()
    assert links[["from_id", "to_id", "lag", "distance"]].to_numpy().tolist() == [["a", "b", 20, 3.0]]
    back = spark.createDataFrame([("b", "c", 1.0)], "i string, j string, distance double")
    late = frame(spark, np.roll(v, 10), "b").unionByName(frame(spark, v, "c"))
    links = network.CAUSAL_LINKS(profile=network.LAG_PROFILE(series=late, pairs=back), pairs=back).toPandas()
    assert links[["from_id", "to_id", "lag"]].to_numpy().tolist() == [["c", "b", 10]]


@pytest.mark.parametrize("n", [199, 200])
def test_bootstrap_errors_are_those_of_theory(spark, n):
    r = np.random.default_rng(8)
    x = r.normal(size=n)
    y = 0.6 * x + 0.8 * r.normal(size=n)
    both = frame(spark, x, "x").unionByName(frame(spark, y, "y"))
    got = network.BOOTSTRAP_STATISTICS(series=both, reps=400).toPandas().set_index(["g", "stat"])
    assert np.isclose(got["se"]["x", "mean"], x.std() / np.sqrt(n), rtol=0.15) and abs(got["bias"]["x", "mean"]) < 0.2 * x.std() / np.sqrt(n)
    want = {"mean": x.mean(), "var": x.var(), "std": x.std(), "median": np.median(x), "max": x.max(), "min": x.min()}
    assert all(np.isclose(got["estimate"]["x", k], v) for k, v in want.items())
    c = network.BOOTSTRAP_CORRELATION(series=both, reps=400).toPandas().iloc[0]
    rho = np.corrcoef(x, y)[0, 1]
    assert np.isclose(c["estimate"], rho) and c["lo"] < rho < c["hi"] and np.isclose(c["se"], (1 - rho**2) / np.sqrt(n), rtol=0.25)


def test_permutation_and_null_p_values(spark):
    r = np.random.default_rng(9)
    x, y, z = r.normal(size=60), r.normal(size=60), r.normal(size=60) + 1
    got = network.PERMUTATION(series=frame(spark, x, "x").unionByName(frame(spark, y, "y")).unionByName(frame(spark, z, "z")), reps=500).toPandas().set_index(["i", "j"])
    assert np.isclose(got["observed"]["x", "z"], x.mean() - z.mean()) and got["p_two"]["x", "z"] < 0.01 and got["p_less"]["x", "z"] < 0.01 < got["p_greater"]["x", "z"]
    both = np.concatenate((x, y))
    own = np.array([(lambda p: both[p[:60]].mean() - both[p[60:]].mean())(r.permutation(120)) for _ in range(4000)])
    assert abs(got["p_two"]["x", "y"] - (abs(own) >= abs(x.mean() - y.mean())).mean()) < 0.08
    smooth = np.convolve(r.normal(size=204), np.ones(5) / 5, mode="valid")
    p = network.NULL_P_VALUE(series=frame(spark, smooth, "s").unionByName(frame(spark, r.normal(size=200), "w")), reps=300).toPandas().set_index("g")
    assert p["significant"]["s"] and np.isclose(p["observed"]["s"], ((smooth - smooth.mean())[1:] * (smooth - smooth.mean())[:-1]).sum() / (smooth.var() * 200))


def test_areas_under_curves(spark):
    r = np.random.default_rng(10)
    v, truth = np.round(r.normal(size=80), 1), r.random(80) < 0.3
    got = network.ROC(scored=spark.createDataFrame(pd.DataFrame({"run_id": "r", "v": v, "truth": truth}))).toPandas().iloc[0]
    pos, neg = v[truth][:, None], v[~truth][None]
    assert np.isclose(got["roc_auc"], ((pos > neg) + 0.5 * (pos == neg)).mean()) and np.isclose(got["fpr"], (v[~truth] > 2).mean())
    levels = np.unique(v)[::-1]
    precision, recall = [1.0], [0.0]
    for t in levels:
        precision.append(truth[v >= t].mean())
        recall.append((truth & (v >= t)).sum() / truth.sum())
    assert np.isclose(got["pr_auc"], np.trapezoid(precision, recall))


def test_short_events_follow_the_transition_rules(spark):
    rows = []
    for event, series_ in {0: {"a": [0, 1], "b": [0, 2], "c": [0, -2]}, 1: {"a": [0, 1, 0], "b": [0, 0.2, 0.5], "c": [1, 1, 1]}, 2: {"a": [0, 0, 0, 1, 1, 1], "b": [1, 1, 1, 0, 0, 0.3], "c": [0] * 6}}.items():
        rows += [(event, g, t, len(v), float(x)) for g, v in series_.items() for t, x in enumerate(v)]
    inside = spark.createDataFrame(rows, "event_id int, g string, t int, n int, v double")
    pairs = spark.createDataFrame([(i, j, 5.0) for i, j in (("a", "b"), ("a", "c"), ("b", "c"))], "i string, j string, distance double")
    got = {(r.event_id, r.from_id, r.to_id, r.kind, r.lag, r.strong, round(r.strength, 6)) for r in network.TRANSITION_LINKS(inside=inside, pairs=pairs).collect()}
    assert got == {(0, "a", "b", "tunneling", 0, True, round(2**0.5, 6)), (1, "a", "b", "jump", 1, True, 1.0), (2, "a", "b", "causal", 3, True, 1.0)}


def test_shared_steps_are_written_once(spark):
    from strandflow.plans.op import Op

    one = Plan(Op("one", "SELECT run_id, frame, v + 1 AS v FROM {x} WHERE v > 0"), {"x": Source("s", lambda spark, _: frame(spark, [1.0, 2.0]), "")})
    thin = Plan(Op("thin", "SELECT run_id, frame, v FROM {x}", light=True), {"x": one})
    both = Plan(Op("both", "SELECT a.frame, a.v + b.v + c.v AS v FROM {a} a JOIN {b} b ON b.frame = a.frame JOIN {a} c ON c.frame = a.frame"), {"a": thin, "b": one})
    assert both.readers()[id(one)] == 3
    out = both.spark(spark, "")
    assert len(out.inputFiles()) > 0 and sorted(r.v for r in out.collect()) == [6.0, 9.0]


def test_peaks_keep_their_distance(spark):
    v = np.zeros(400)
    v[[50, 70, 200, 320]] = [5, 9, 7, 8]
    got = sequential.peaks(detect.PEAK_CANDIDATES(series=frame(spark, v))).toPandas()
    assert sorted(got["frame"]) == [70, 200, 320]


def test_spectrum_finds_a_sine(spark):
    got = spectrum.periodicity(frame(spark, np.sin(2 * np.pi * 12 * np.arange(600) / 600) + 0.01 * np.random.default_rng(5).normal(size=600))).toPandas()
    assert 12 in got.sort_values("amplitude")["frequency"].tolist()[-1:]


def test_npy_round_trip(spark, tmp_path):
    a = np.random.default_rng(6).normal(size=(7, 4, 3))
    np.save(tmp_path / "one.npy", a)
    got = files.read_npy(spark, str(tmp_path / "*.npy")).toPandas().sort_values(["frame", "atom_id"])
    assert np.allclose(got[["x", "y", "z"]].to_numpy().reshape(7, 4, 3), a) and set(got["run_id"]) == {"one"}
    rmsd = column(features.RMSD(traj=files.read_npy(spark, str(tmp_path / "*.npy"))), "rmsd")
    assert np.allclose(rmsd, np.sqrt(((a - a[0]) ** 2).mean(axis=(1, 2))))


def test_groups_and_sinks(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"0": [0, 1], "7": [2]}')
    groups = files.read_groups(spark, str(tmp_path / "g.json"), "cluster")
    assert sorted(map(tuple, groups.collect())) == [("cluster", 0, 0), ("cluster", 0, 1), ("cluster", 7, 2)]
    files.write_series(groups, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_plans_write_themselves_as_one_statement():
    from strandflow.plans.queries_detect import BREAKS

    text = BREAKS.statement()
    assert text.startswith("WITH RECURSIVE") and "{" not in text and "<w>" not in text and isinstance(BREAKS, Plan)


def test_rolling_stream_equals_batch(spark, tmp_path):
    from strandflow.streaming.windows import rolling_z

    v = np.random.default_rng(7).normal(size=60)
    for k in range(3):
        frame(spark, v).where(f"frame >= {20 * k} and frame < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, frame int, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rolling_z(stream, 10).writeStream.format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("rolled").toPandas().sort_values("frame")
    held = v[20:30]
    assert len(got) == 60 and np.isclose(got["z"].iloc[30], abs(v[30] - held.mean()) / held.std())
