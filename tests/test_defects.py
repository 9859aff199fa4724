"""Defect networks against the rules applied pair by pair in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from strandflow.operators import defects as o

EVENTS = [("r", 0, 0, 0), ("r", 1, 3, 4), ("r", 2, 10, 13), ("r", 3, 20, 49)]


@pytest.fixture(scope="module")
def world(spark):
    """60 atoms in a box of 20, a third of them slow, a third quick."""
    g = np.random.default_rng(4)
    home = g.uniform(0, 20, (60, 3))
    home[40:50] = home[0] + g.normal(0, 0.1, (10, 3))
    pace = np.array([0.03, 0.2, 0.8])[np.arange(60) % 3][None, :, None]
    xyz = home + np.cumsum(g.normal(0, 1, (50, 60, 3)) * pace / np.sqrt(3), axis=0) * 0.4 + g.normal(0, 1, (50, 60, 3)) * pace * 0.4
    rows = pd.DataFrame({"run_id": "r", "frame": np.repeat(np.arange(50, dtype="int32"), 60), "atom_id": np.tile(np.arange(60, dtype="int32"), 50), **{k: xyz[:, :, i].ravel() for i, k in enumerate("xyz")}})
    traj = spark.createDataFrame(rows).repartition(5)
    events = spark.createDataFrame(EVENTS, "run_id string, event_id int, start_frame int, end_frame int")
    atoms = spark.createDataFrame([(a,) for a in range(58)], "atom_id int")
    kinds = spark.createDataFrame([("r", a, "Fe" if a < 30 else "C" if a < 40 else "Cr") for a in range(60)], "run_id string, atom_id int, atom_type string")
    member = spark.createDataFrame([(a // 10, a) for a in range(55)], "group_id int, atom_id int")
    return xyz, traj, events, atoms, kinds, member


def links_of(xyz, start, end, reach):
    """{(i, j, type): (strength, lag, stress)} by the rules, pair by pair."""
    p = xyz[start : end + 1, :58]
    n, out, kind, window = len(p), {}, {}, {}
    for a in range(58):
        way = np.linalg.norm(np.diff(p[:, a], axis=0), axis=1).sum()
        kind[a] = "dislocation" if way > 0.5 * n else "plastic" if way > 0.2 * n else "elastic"
        window[a] = min(n, {"dislocation": 5, "plastic": 10, "elastic": 20}[kind[a]])
    corr = lambda a, b: np.corrcoef(a, b)[0, 1] if len(a) > 1 and a.std() > 1e-10 and b.std() > 1e-10 else 0.0
    r = np.linalg.norm(p, axis=2)
    for i in range(58):
        for j in range(i + 1, 58):
            d = np.linalg.norm(p[0, i] - p[0, j])
            if n == 1:
                if d < min(4, reach):
                    both = {"Fe" if a < 30 else "C" if a < 40 else "Cr" for a in (i, j)}
                    out[i, j, "elastic"] = (1 / (1 + d), 0, (1.2 if both == {"Fe"} else 1.5 if "C" in both else 1.0) / (1 + d))
                continue
            if d >= reach:
                continue
            w, apart = min(window[i], window[j]), np.linalg.norm(p[:, i] - p[:, j], axis=1).mean()
            near = 1 / (1 + apart) if apart < 6 else 0.0
            sync = abs(corr(r[:w, i], r[:w, j]))
            if kind[i] == kind[j] == "elastic" and sync > 0.7:
                out[i, j, "elastic"] = (sync, 0, near)
            if "plastic" in (kind[i], kind[j]):
                top, lag = 0.0, 0
                for k in range(1, min(4, w)):
                    c = abs(corr(r[:-k, i], r[k:, j]))
                    top, lag = (c, k) if c > top + 1e-9 else (top, lag)
                if top > 0.5:
                    out[i, j, "plastic"] = (top, lag, near)
            if "dislocation" in (kind[i], kind[j]) and near > 0.5:
                out[i, j, "fracture"] = (near, 0, near * 210)
    return out


@pytest.mark.parametrize("reach", [6.0, 100.0])
def test_links_are_those_of_the_rules(spark, world, reach):
    xyz, traj, events, atoms, kinds, member = world
    paths = o.PATHS(frames=o.EVENT_FRAMES(events=events), traj=traj, atoms=atoms).cache()
    pairs, types = o.CELL_PAIRS(paths=paths, reach=reach).cache(), o.TYPES(paths=paths)
    stats = o.PAIR_STATS(paths=paths, pairs=pairs, types=types)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") >= 1 and "Join Inner, (" in plan
    links = o.LINKS(stats=stats, pairs=pairs, kinds=kinds, owner=o.OWNER(member=member)).cache()
    got = links.toPandas()
    for _, e, start, end in EVENTS:
        want = links_of(xyz, start, end, reach)
        mine = {(r.i, r.j, r.link_type): (r.strength, r.lag, r.stress_transfer) for r in got[got.event_id == e].itertuples()}
        assert mine.keys() == want.keys()
        assert all(np.allclose(mine[k], want[k]) for k in want)
    assert set(got.link_type) == {"elastic", "plastic", "fracture"}
    assert ((got.gi == -1) == (got.i >= 55)).all()
    tips = o.TIPS(strongest=o.STRONGEST(links=links)).toPandas()
    for e in set(tips.event_id):
        top = got[(got.event_id == e) & (got.link_type == "fracture")].sort_values(["stress_transfer", "i", "j"], ascending=[False, True, True])[:5]
        assert tips[tips.event_id == e].sort_values("place").atom_id.tolist() == sorted({*top.i, *top.j})[:5]


def test_defect_networks_of_nothing(spark, world):
    _, traj, events, atoms, kinds, member = world
    paths = o.PATHS(frames=o.EVENT_FRAMES(events=events), traj=traj, atoms=atoms.limit(0))
    pairs = o.CELL_PAIRS(paths=paths)
    links = o.LINKS(stats=o.PAIR_STATS(paths=paths, pairs=pairs, types=o.TYPES(paths=paths)), pairs=pairs, kinds=kinds, owner=o.OWNER(member=member))
    assert links.count() == 0
    assert {r.pattern for r in o.PATTERN(links=links, events=events).collect()} == {"elastic", "elastic_deformation"}
