"""Shifted frames meet by equality: no step looks at all pairs of a run's frames."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest

from strandflow.operators import composite, events, network, series
from strandflow.plans.op import Function, Plan, Source

RNG = np.random.default_rng(21)
N = 300


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Written tables, as between the steps of a plan: a projection of all their columns is no step of its own."""
    at, n = tmp_path_factory.mktemp("shifts"), np.arange(N, dtype="int32")
    e = {f"e{i}{j}": RNG.normal(size=4 * N) for i in range(3) for j in range(i, 3)}
    made = {
        "series": {"run_id": np.repeat([str(k) for k in range(4)], N), "frame": np.tile(n, 4), "v": RNG.normal(1, 0.5, 4 * N)},
        "pairs": {"i": ["0", "0", "1"], "j": ["1", "2", "3"], "distance": [1.0, 2.0, 3.0]},
        "inside": {"event_id": np.repeat(np.int32(0), 4 * N), "g": np.repeat([str(k) for k in range(4)], N), "t": np.tile(n, 4), "n": np.repeat(np.int32(N), 4 * N), "v": RNG.normal(1, 0.5, 4 * N)},
        "near": {"event_id": np.int32([0, 0]), "i": ["0", "1"], "j": ["1", "3"], "n": np.int32([N, N]), "distance": [1.0, 2.0]},
        "strain": {"group_id": np.repeat(np.arange(4, dtype="int32"), N), "frame": np.tile(n, 4), "strain": RNG.uniform(1, 2, 4 * N), **e},
        "coordination": {"group_id": np.repeat(np.arange(4, dtype="int32"), N), "frame": np.tile(n, 4), "coord": RNG.uniform(2, 9, 4 * N)},
    }
    for k, v in made.items():
        spark.createDataFrame(pd.DataFrame(v)).write.parquet(f"{at}/{k}")
    return {k: spark.read.parquet(f"{at}/{k}") for k in made}, {k: pd.DataFrame(v) for k, v in made.items()}


def join_keys(df) -> list[str]:
    return re.findall(r"(?:SortMergeJoin|HashJoin) \[(.*?)\],", df._jdf.queryExecution().sparkPlan().toString())


@pytest.mark.parametrize(
    ("op", "places", "key"),
    [
        (network.EVENT_CAUSALITY, {"series": "series"}, "frame"),
        (network.LAG_PROFILE, {"series": "series", "pairs": "pairs"}, "frame"),
        (events.LAG_PROFILE, {"inside": "inside", "pairs": "near"}, "later"),
        (composite.TENSOR_CAUSALITY, {"strain": "strain"}, "frame"),
        (composite.DISLOCATION_CAUSALITY, {"coordination": "coordination"}, "frame"),
    ],
)
def test_a_lag_is_part_of_the_join_key(stored, op, places, key):
    keys = join_keys(op(**{k: stored[0][t] for k, t in places.items()}))
    assert any(key in k for k in keys), keys


def test_event_causality_against_a_loop(stored):
    x = stored[1]["series"]["v"].to_numpy().reshape(4, N) > 1
    got = {(r.i, r.j, r.lag): r.p for r in network.EVENT_CAUSALITY(series=stored[0]["series"]).collect()}
    want = {(str(i), str(j), lag): x[j, lag:][x[i, :-lag]].mean() for i in range(4) for j in range(4) if i != j for lag in range(1, 11)}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_gaussian_filter_joins_no_frames_and_blocks_change_nothing(stored):
    run = stored[0]["series"].selectExpr("*", "7 AS n")
    whole = series.GAUSSIAN_FILTER(series=run, sigma=3.0, reach=12)
    assert all("frame" not in k for k in join_keys(whole)) and len(join_keys(whole)) == 1
    v = stored[1]["series"]["v"].to_numpy().reshape(4, N)
    k = np.exp(-(np.arange(-12, 13) ** 2) / 18.0)
    want = np.stack([np.convolve(np.pad(x, 12, mode="symmetric"), k / k.sum(), mode="valid") for x in v])
    for df in (whole, series.GAUSSIAN_FILTER(series=run, sigma=3.0, reach=12, block=40)):
        assert np.allclose(df.toPandas().sort_values(["run_id", "frame"])["v"].to_numpy().reshape(4, N), want)


def test_lag_profile_against_a_loop_and_in_blocks(stored):
    x = stored[1]["series"]["v"].to_numpy().reshape(4, N)
    ways = [(int(i), int(j)) for a, b in zip(stored[1]["pairs"]["i"], stored[1]["pairs"]["j"], strict=True) for i, j in ((a, b), (b, a))]
    want = {(str(i), str(j), lag): (np.corrcoef(x[i, : N - lag], x[j, lag:])[0, 1], N - lag) for i, j in ways for lag in range(0, N // 2, 10)}
    for block in (None, 381):
        got = {(r.i, r.j, r.lag): (r.corr, r.n) for r in network.LAG_PROFILE(series=stored[0]["series"], pairs=stored[0]["pairs"], block=block).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_links_under_a_recursion_are_written_once(spark):
    made = []
    links = Source("links", lambda s, _: s.createDataFrame([("a", "b", 0.5), ("b", "c", 0.4)], "from_id string, to_id string, strength double"), "")
    step = Function("kept_links", "SELECT * FROM {x}", run=lambda x: made.append(x) or x)
    plan = Plan(network.PATHS, {"links": Plan(step, {"x": links})})
    assert plan.readers()[id(plan.inputs["links"])] > 1
    assert {r.path for r in plan.spark(spark, "").collect()} == {"/a/b/", "/b/c/", "/a/b/c/"} and len(made) == 1
