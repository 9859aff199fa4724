"""Queries on what single events show."""

from __future__ import annotations

from strandflow.operators import evidence as o
from strandflow.plans import queries_defects as f
from strandflow.plans import queries_events as e
from strandflow.plans import queries_material as q
from strandflow.plans.op import Op, Plan
from strandflow.plans.query import Query, tables
from strandflow.sources.adapters import CLUSTERS

KINDS = Plan(Op("event_kinds_by_length", "SELECT run_id, event_id, start_frame, end_frame, CASE WHEN start_frame = end_frame THEN 'plastic' WHEN end_frame - start_frame < 20 THEN 'dislocation' ELSE 'crack' END AS kind FROM {x}"), {"x": e.BROAD})
TRACES = Plan(o.TRACES, {"events": KINDS, "traj": f.SCALED, "member": CLUSTERS, "field": f.FIELD}, {"sigmas": 1.2})
STRESS = Plan(Op("stress_and_strain", "SELECT s.run_id, s.frame, s.group_id, s.strain, v.stress FROM {s} s JOIN {v} v ON v.frame = s.frame AND v.group_id = s.group_id"), {"s": q.STRAIN, "v": Plan(q.m.VON_MISES, {"strain": q.STRAIN})})

_OWN = f"""WITH ev AS MATERIALIZED (SELECT *, end_frame - start_frame AS n FROM ({e.BROAD.statement()})),
p AS MATERIALIZED (SELECT vec_id AS f, a, list_transform([embedding[3 * a + 1]::DOUBLE, embedding[3 * a + 2]::DOUBLE, embedding[3 * a + 3]::DOUBLE], lambda x: x * 40 * {f.UNIT}) AS x FROM embeddings, range(21) g(a)),
d AS MATERIALIZED (SELECT n.f, n.a, list_transform([1, 2, 3], lambda k: n.x[k] - o.x[k]) AS v FROM p n JOIN p o ON o.f = n.f - 1 AND o.a = n.a),
s AS (SELECT event_id, max(list_distance(n.v, [0.0, 0, 0])) / 100 AS velocity, max(list_distance(n.v, o.v)) / 10000 AS acceleration FROM ev JOIN d n ON n.f = start_frame LEFT JOIN d o ON o.f = start_frame - 1 AND o.a = n.a GROUP BY event_id),
fl AS (SELECT event_id, f, flatten(list(v ORDER BY a)) AS v FROM ev JOIN d ON f BETWEEN greatest(1, start_frame) AND least(start_frame + 9, end_frame) WHERE n > 1 GROUP BY ALL),
c AS (SELECT event_id, max(abs(r)) AS correlation FROM (SELECT event_id, x, y, corr(u, w) AS r FROM (SELECT a.event_id, a.f AS x, b.f AS y, unnest(a.v) AS u, unnest(b.v) AS w FROM fl a JOIN fl b ON a.event_id = b.event_id AND a.f < b.f) GROUP BY ALL) GROUP BY event_id),
b AS (SELECT event_id, count(*) FILTER (list_distance(l.x, r.x) < 0.8 OR list_distance(l.x, r.x) > 2.0) AS bond_anomalies FROM ev JOIN p l ON l.f = start_frame JOIN p r ON r.f = l.f AND r.a = l.a + 1 GROUP BY event_id)
SELECT event_id, coalesce(velocity, 0) AS velocity, coalesce(acceleration, 0) AS acceleration, coalesce(correlation, 0) AS correlation, bond_anomalies FROM ev LEFT JOIN s USING (event_id) LEFT JOIN c USING (event_id) LEFT JOIN b USING (event_id)"""

QUERIES_ = {
    "grp7_event_importance": Query(Plan(o.IMPORTANCE, {"peaks": e.PEAKS, "windows": Plan(o.EVENT_WINDOWS, {"inside": e.LONG})}), "g ~score place"),
    "atm7_defect_traces": Query(TRACES, "event_id group_id atom_id ~z ~confidence ~stress signature"),
    "atm8_plastic_zones": Query(Plan(o.ZONES, {"traces": TRACES, "events": e.BROAD, "stress": STRESS}), "event_id group_id n_atoms ~most_stress ~zone ~k_ic", digits=3),
    "asm3_atomic_evidence": Query(Plan(o.EVIDENCE, {"events": e.BROAD, "traj": f.SCALED}), "event_id ~velocity ~acceleration ~correlation #bond_anomalies", sql=_OWN),
}

QUERIES, ORACLES = tables(QUERIES_)
