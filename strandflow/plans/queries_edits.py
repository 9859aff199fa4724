"""Queries on what events do to stress, scores and strain."""

from __future__ import annotations

from strandflow.operators import edits as o
from strandflow.operators import material as m
from strandflow.operators import series as s
from strandflow.plans import queries_detect as d
from strandflow.plans import queries_material as q
from strandflow.plans.op import Op, Plan
from strandflow.plans.queries_events import BROAD
from strandflow.plans.query import Query, tables
from strandflow.sources.adapters import HOURLY, TRAJ

#: Kinds by score where it is a deviation; long low ones wear the material out, the rest moves dislocations.
SCORES = d.as_series(Plan(s.Z_NORMALISE, {"series": HOURLY}), "z")
EVENTS = Plan(d.d.CRITICAL_EVENTS, {"series": SCORES}, {"sigmas": 1.0})
KINDS = Plan(
    Op("kinds", "SELECT e.run_id, e.event_id, e.start_frame, e.end_frame, CASE WHEN k.kind = 'plastic' AND k.duration > 1 THEN 'fatigue' WHEN k.kind = 'elastic' AND e.score > 1.5E0 THEN 'dislocation' WHEN k.kind = 'crack_initiation' AND k.duration = 1 THEN 'plastic' ELSE k.kind END AS kind FROM {e} e JOIN {k} k ON k.run_id = e.run_id AND k.event_id = e.event_id"),
    {"e": EVENTS, "k": Plan(m.EVENT_BY_SCORE, {"events": EVENTS})},
)
STRESS = Plan(o.STRESS, {"strain": HOURLY, "materials": q.MAT}, {"unit": 0.0001})
TINY = Plan(Op("tiny", "SELECT run_id, frame, atom_id, x * 0.001E0 AS x, y * 0.001E0 AS y, z * 0.001E0 AS z FROM {x}", light=True), {"x": TRAJ})
PHASES = Plan(Op("plastic_events", "SELECT run_id, event_id, start_frame, end_frame, CASE WHEN start_frame < end_frame THEN 'plastic' ELSE 'elastic' END AS kind FROM {x}"), {"x": BROAD})

QUERIES_ = {
    "mat16_stress": Query(STRESS, "run_id frame ~v"),
    "mat16_edited_stress": Query(Plan(o.EDITED, {"stress": STRESS, "events": KINDS}), "run_id frame ~v"),
    "mat17_event_scores": Query(Plan(o.EVENT_SCORES, {"series": HOURLY, "events": KINDS}), "run_id frame ~strain ~coordination ~damage ~combined"),
    "mat17_failure_mode": Query(Plan(o.FAILURE_MODE, {"series": HOURLY, "events": KINDS}), "run_id mode ~time_to_failure"),
    "mat18_event_strain_field": Query(Plan(o.STRAIN_FIELD, {"traj": TINY, "events": PHASES, "materials": q.MAT}), "atom_id ~strain",
        sql=f"WITH ev AS ({BROAD.statement()}), st AS (SELECT vec_id AS frame, a AS atom_id, 0.04 * sqrt(list_sum(list_transform([1, 2, 3], lambda k: power(embedding[3 * a + k]::DOUBLE - (lag(embedding) OVER w)[3 * a + k]::DOUBLE, 2)))) AS step FROM embeddings, range(21) g(a) WINDOW w AS (PARTITION BY a ORDER BY vec_id)) SELECT atom_id, least(0.5, avg(step) / 2.87 + 0.5 / 2.87 * sum(step) FILTER (EXISTS (SELECT 1 FROM ev WHERE start_frame < end_frame AND st.frame BETWEEN start_frame AND end_frame))) AS strain FROM st WHERE step IS NOT NULL GROUP BY atom_id"),
}

QUERIES, ORACLES = tables(QUERIES_)
