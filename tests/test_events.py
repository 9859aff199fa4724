"""Networks inside events against loops over each event in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from strandflow.operators import events as o
from strandflow.operators import network

EVENTS = [("r", 0, 5, 44), ("r", 1, 60, 69), ("r", 2, 80, 88), ("r", 3, 100, 219)]
GROUPS = 6


@pytest.fixture(scope="module")
def world(spark):
    g = np.random.default_rng(8)
    v = g.normal(1, 0.5, (240, GROUPS))
    v[110:, 1] = v[100:-10, 0] + g.normal(0, 0.1, 130)
    v[:-20, 4] = v[20:, 3] * 0.9
    centre = g.uniform(0, 12, (GROUPS, 3))[None] + g.normal(0, 1, (240, GROUPS, 3))
    series = spark.createDataFrame(pd.DataFrame({"run_id": np.repeat([str(k) for k in range(GROUPS)], 240), "frame": np.tile(np.arange(240, dtype="int32"), GROUPS), "v": v.T.ravel()}))
    d = np.linalg.norm(centre[:, :, None] - centre[:, None], axis=3)
    rows = [(f, i, j, float(d[f, i, j])) for f in range(240) for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    distances = spark.createDataFrame(rows, "frame int, i int, j int, d double")
    events = spark.createDataFrame(EVENTS, "run_id string, event_id int, start_frame int, end_frame int")
    return v, d, series, distances, events


def links_of(v, d, most):
    n, out = len(v), {}
    at = [int(k * (n - 1) / 9) for k in range(10)]
    corr = lambda a, b: np.corrcoef(a, b)[0, 1]
    for i in range(GROUPS):
        for j in range(i + 1, GROUPS):
            near = d[at, i, j].mean()
            if near >= most:
                continue
            top, lag = 0.0, 0
            for k in range(0, min(200, n // 2), 10):
                for a, b, sign in ((i, j, 1), (j, i, -1))[: 2 if k else 1]:
                    c = corr(v[: n - k, a], v[k:, b])
                    if abs(c) > abs(top) + 1e-9:
                        top, lag = c, sign * k
            if abs(top) >= 0.2:
                a, b = (i, j) if lag >= 0 else (j, i)
                out[str(a), str(b)] = (abs(top), abs(lag), near, corr(v[:, i], v[:, j]))
    return out


def peaks_of(v):
    out = {}
    for g in range(GROUPS):
        x = v[:, g]
        rises = [t for t in range(1, len(x) - 1) if x[t] > x[t - 1] and x[t] > x[t + 1] and x[t] >= x.mean() + x.std()]
        kept = []
        for t in sorted(rises, key=lambda t: -x[t]):
            if all(abs(t - k) >= 5 for k in kept):
                kept.append(t)
        out[str(g)] = sorted(kept)[:5] or [int(x.argmax())]
    return out


def starts_of(peaks, links):
    delay = [(t, g) for g in sorted(peaks) for t in peaks[g]]
    t = np.array([x for x, _ in delay], dtype=float)
    line = max(10, t.mean() - 2 * t.std() if t.std() > 0 else np.percentile(t, 25))
    early = [g for x, g in delay if x < line]
    out = set(early)
    if len(early) < 3:
        degree = {}
        for a, _ in links:
            degree[a] = degree.get(a, 0) + 1
        out |= {g for g, n in sorted(degree.items(), key=lambda x: (-x[1], x[0]))[:3] if n >= 3}
    return out or {g for _, g in sorted(delay)[:3]}


def paths_of(starts, links):
    graph, out = {}, set()
    for a, b in links:
        graph.setdefault(a, []).append(b)

    def walk(path):
        if len(path) == 6 or path[-1] not in graph:
            out.add(tuple(path))
            return
        for b in graph[path[-1]]:
            if b not in path:
                walk([*path, b])

    for g in starts:
        walk([g])
    return sorted((p for p in out if len(p) > 1), key=lambda p: (-len(p), f"/{'/'.join(p)}/"))[:5]


def test_networks_of_events_are_those_of_a_loop(spark, world):
    v, d, series, distances, events = world
    inside = network.EVENT_SERIES(events=events, series=series).cache()
    assert inside.count() == sum(b - a + 1 for *_, a, b in EVENTS) * GROUPS
    most = float(np.median(d))
    pairs = o.NEAR_PAIRS(events=events, distances=distances, most=most)
    profile = o.LAG_PROFILE(inside=inside, pairs=pairs).cache()
    links, peaks = o.LINKS(profile=profile).cache(), o.PEAKS(inside=inside).cache()
    starts = o.INITIATORS(peaks=peaks, links=links).cache()
    paths = o.PATHS(initiators=starts, links=links)
    got, top, first, ways = links.toPandas(), peaks.toPandas(), starts.toPandas(), paths.toPandas()
    assert (got.sort_values("strength", ascending=False).iloc[0][["event_id", "from_id", "to_id", "lag"]].tolist()) in ([3, "0", "1", 10], [3, "4", "3", 20])
    for _, e, a, b in EVENTS:
        own = v[a : b + 1]
        want = links_of(own, d[a : b + 1], most) if b - a >= 9 else {}
        mine = {(r.from_id, r.to_id): (r.strength, r.lag, r.distance, r.sync_rate) for r in got[got.event_id == e].itertuples()}
        assert mine.keys() == want.keys()
        assert all(np.allclose(mine[k], want[k]) for k in want)
        rises = peaks_of(own)
        assert {g: x.sort_values("place").delay.tolist() for g, x in top[top.event_id == e].groupby("g")} == rises
        begin = starts_of(rises, want)
        assert set(first[first.event_id == e].g) == begin
        assert [tuple(p.strip("/").split("/")) for p in ways[ways.event_id == e].sort_values("place").path] == paths_of(begin, want)


def test_hubs_fill_in_and_the_fastest_stand_in(spark):
    peaks = spark.createDataFrame([(0, str(g), 20 + g) for g in range(6)] + [(1, str(g), 30 + g) for g in range(6)], "event_id int, g string, delay int")
    links = spark.createDataFrame([(0, "4", str(t)) for t in (0, 1, 2)] + [(0, "5", "1"), (1, "0", "1")], "event_id int, from_id string, to_id string")
    got = {(r.event_id, r.g, r.reason) for r in o.INITIATORS(peaks=peaks, links=links).collect()}
    assert got == {(0, "4", "hub"), (1, "0", "fastest"), (1, "1", "fastest"), (1, "2", "fastest")}


def test_events_of_nothing(spark, world):
    _, _, series, distances, events = world
    inside = network.EVENT_SERIES(events=events.limit(0), series=series)
    pairs = o.NEAR_PAIRS(events=events.limit(0), distances=distances)
    links = o.LINKS(profile=o.LAG_PROFILE(inside=inside, pairs=pairs))
    starts = o.INITIATORS(peaks=o.PEAKS(inside=inside), links=links)
    assert links.count() == 0 and starts.count() == 0 and o.PATHS(initiators=starts, links=links).count() == 0
