"""Fluctuations, nuclei and load cycles against numpy loops, on atoms that loosen one after another."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest

from strandflow.operators import lifetime as o
from strandflow.operators.material import MATERIAL_TABLE

LIMIT, LATTICE = 0.1 * 2.87, 2.87


def _positions(frames: int, atoms: int = 60) -> np.ndarray:
    g = np.random.default_rng(frames)
    t, a = np.arange(frames)[:, None, None] / frames, np.arange(atoms)[None, :, None]
    loose = np.clip(3 * t - a / 20, 0, 1) ** 3
    return g.normal(0, 1, (frames, atoms, 3)) * (0.05 + 0.4 * loose) + 4.0 * a


def _table(spark, runs: dict[str, np.ndarray]):
    rows = [pd.DataFrame({"run_id": r, "frame": np.repeat(np.arange(x.shape[0], dtype="int32"), x.shape[1]), "atom_id": np.tile(np.arange(x.shape[1], dtype="int32"), x.shape[0]), **dict(zip("xyz", x.reshape(-1, 3).T, strict=True))}) for r, x in runs.items()]
    return spark.createDataFrame(pd.concat(rows)).repartition(5)


def _field(x: np.ndarray) -> tuple[np.ndarray, int]:
    width = min(100, len(x) // 10)
    stride = max(1, width // 2)
    return np.array([np.sqrt(x[s : s + width].var(0).sum(1)) for s in range(0, len(x) - width + 1, stride)]), stride


def _largest(row: np.ndarray, gap: int = 10) -> int:
    at = np.flatnonzero(row > LIMIT)
    return max((len(p) for p in np.split(at, np.flatnonzero(np.diff(at) > gap) + 1)), default=0)


@pytest.fixture(scope="module")
def made(spark):
    runs = {"a": _positions(437), "b": _positions(1250), "still": _positions(300) * 0 + 1.0, "short": _positions(9)}
    traj = _table(spark, runs)
    materials = MATERIAL_TABLE.read(spark, "")
    span = o.SPAN(traj=traj)
    field = o.FIELD(traj=traj, span=span).persist()
    return runs, traj, materials, span, field


def test_windows_are_those_of_a_loop(made):
    runs, _, _, _, field = made
    got = field.toPandas()
    assert set(got.run_id) == {"a", "b", "still"}
    for r in ("a", "b", "still"):
        want, _ = _field(runs[r])
        mine = got[got.run_id == r].pivot(index="window_", columns="atom_id", values="rmsf").to_numpy()
        assert mine.shape == want.shape
        assert np.allclose(mine, want, atol=1e-7)


def test_divergence_and_nuclei(spark, made):
    runs, _, materials, span, field = made
    critical = o.CRITICAL(most=o.MOST(field=field), materials=materials)
    got = o.DIVERGENCE(field=field, critical=critical, span=span, materials=materials).toPandas().set_index("run_id")
    stress = spark.createDataFrame([(2.0,), (-4.0,)], "stress double")
    growth = o.GROWTH(nuclei=o.NUCLEI(field=field, materials=materials), span=span, stress=stress).toPandas().set_index("run_id")
    assert got.loc["still", "n_critical"] == 0
    assert pd.isna(got.loc["still", "divergence_time"])
    assert "still" not in growth.index
    for r in ("a", "b"):
        f, stride = _field(runs[r])
        bad = np.flatnonzero(f.max(0) > LIMIT)
        g = np.gradient(f[:, bad[0]])
        over = np.flatnonzero(g > g.mean() + 2 * g.std())
        assert got.loc[r, "n_critical"] == len(bad)
        assert got.loc[r, "divergence_time"] == over[0] * stride
        assert np.isclose(got.loc[r, "divergence_rate"], g.max())
        sizes = [s for s in map(_largest, f) if s]
        mean = np.diff(sizes).mean()
        assert growth.loc[r, "largest"] == max(sizes)
        assert np.isclose(growth.loc[r, "mean_growth"], mean)
        assert np.isclose(growth.loc[r, "critical_nm"], 4.0 / 3)
        left = 0.3 * f.shape[1] - sizes[-1]
        assert (pd.isna(growth.loc[r, "coalescence"]) and left <= 0) or np.isclose(growth.loc[r, "coalescence"], left / mean)


def test_critical_atoms_over_the_limit(spark, made):
    _, _, materials, _, _ = made
    most = spark.createDataFrame([("r", i, 0.2 + 0.1 * ((i * 7) % 10)) for i in range(10)], "run_id string, atom_id int, most double")
    rows = o.CRITICAL(most=most, materials=materials, limit=3).orderBy("place").collect()
    assert [r.most for r in rows] == pytest.approx([0.9, 1.0, 1.1])
    assert [r.atom_id for r in o.CRITICAL(most=most, materials=materials).orderBy("place").collect()] == list(range(1, 10))


def test_cycles_are_those_of_a_loop(spark, made):
    runs, _, materials, span, field = made
    cycles = [(0, 90, True), (90, 130, False), (130, 190, True), (190, 195, False), (195, 240, False), (240, 300, True), (300, 320, False), (120, 180, True), (9000, 9100, False)]
    table = spark.createDataFrame([(r, k, *c) for r in ("a", "still") for k, c in enumerate(cycles, 1)], "run_id string, cycle int, start_ int, end_ int, loading boolean")
    melted = o.MELTED(cycles=table, field=field, materials=materials)
    fatigue = o.FATIGUE(cycles=table, melted=melted)
    got = fatigue.orderBy("run_id", "cycle").toPandas()
    life = o.LIFE(fatigue=fatigue, span=span).toPandas().set_index("run_id")
    f, _ = _field(runs["a"])
    last, total, sums, hot = None, 0, [], np.zeros(f.shape[1])
    for a, b, loading in cycles:
        part = f[a // 10 : b // 10]
        if loading:
            last = np.flatnonzero(part.mean(0) > LIMIT) if len(part) else np.array([], int)
            hot[last] += 0.1
        else:
            total += int(0.1 * len(last)) if last is not None else 0
        sums.append(total)
    mine = got[got.run_id == "a"]
    assert total > 0
    assert mine.defects.tolist() == sums
    assert np.isclose(life.loc["a", "rate"], np.gradient(sums).mean())
    assert np.isclose(life.loc["a", "cycles_left"], (0.1 * 60 - total) / np.gradient(sums).mean())
    assert pd.isna(life.loc["still", "cycles_left"])
    spots = {r.atom_id: r.concentration for r in o.STRESSED(melted=melted).collect()}
    assert spots == pytest.approx({int(k): hot[k] for k in np.flatnonzero(hot)})


def test_general_causality(spark):
    g = np.random.default_rng(2)
    base = g.normal(0, 1, 400)
    v = {"x": base, "y": np.roll(base, 7) + g.normal(0, 0.3, 400), "z": g.normal(0, 1, 400), "flat": np.ones(400)}
    series = spark.createDataFrame([(k, i, float(a)) for k, s in v.items() for i, a in enumerate(s)], "run_id string, frame int, v double")
    pairs = spark.createDataFrame([("x", "y"), ("x", "z"), ("flat", "x")], "i string, j string")
    rows = {(r.i, r.j): r for r in o.GENERAL_CAUSALITY(series=series, pairs=pairs, least=0.3).collect()}
    assert set(rows) == {("x", "y")}
    assert rows["x", "y"].lag == 7
    assert np.isclose(rows["x", "y"].strength, abs(np.corrcoef(v["x"][:-7], v["y"][7:])[0, 1]))


@pytest.mark.parametrize("block", [None, 199])
def test_general_causality_joins_no_frames_and_blocks_change_nothing(spark, tmp_path, block):
    g = np.random.default_rng(4)
    n = 451
    v = {k: g.normal(0, 1, n) for k in "xyz"}
    v["y"][50:] += v["x"][:-50]
    gone = {("x", 30), ("y", 31)}
    spark.createDataFrame([(k, i, None if (k, i) == ("z", 9) else float(a)) for k, s in v.items() for i, a in enumerate(s) if (k, i) not in gone], "run_id string, frame int, v double").write.parquet(f"{tmp_path}/series")
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "z")], "i string, j string")
    df = o.GENERAL_CAUSALITY(series=spark.read.parquet(f"{tmp_path}/series"), pairs=pairs, least=0.0, block=block)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    keys = re.findall(r"(?:SortMergeJoin|HashJoin|NestedLoopJoin) \[(.*?)\],", plan)
    assert "frame_blk" in "".join(keys) and not re.search(r"\bframe#", "".join(keys)), keys
    v["z"][9] = np.nan
    for k, i in gone:
        v[k][i] = np.nan

    def strongest(a, b):
        best = []
        for lag in range(1, 100):
            x, y = a[:-lag], b[lag:]
            known = ~np.isnan(x) & ~np.isnan(y)
            best.append((-round(abs(np.cov(x[known], y[known], ddof=0)[0, 1] / (x[known].std() * y[known].std())), 9), lag))
        return min(best)

    got = {(r.i, r.j): (r.strength, r.lag) for r in df.collect()}
    for a, b in (("x", "y"), ("y", "x")):
        strength, lag = strongest(v[a], v[b])
        assert np.isclose(got[a, b][0], -strength, atol=1e-8) and got[a, b][1] == lag
    assert got["x", "y"][1] == 50 and ("x", "z") in got
