"""Queries on combined results."""

from __future__ import annotations

from strandflow.operators import composite as k
from strandflow.operators import material as m
from strandflow.operators import network as n_
from strandflow.plans import queries_core as c
from strandflow.plans import queries_detect as d
from strandflow.plans import queries_material as q
from strandflow.plans import queries_network as n
from strandflow.plans.op import Plan
from strandflow.plans.query import Query, tables
from strandflow.sources.adapters import HOURLY, TRAJ

INIT = Plan(n_.INITIATORS, {"series": n.SERIES})
FAILURE = Plan(m.FAILURE, {"strain": q.STRAIN, "materials": q.MAT})
SUMMARY = Plan(m.DAMAGE_SUMMARY, {"rate": q.RATE})
DEGREES = Plan(n_.DEGREES, {"links": n.LINKS})
ENERGY = Plan(m.ENERGY, {"traj": TRAJ})
NUCLEI = Plan(m.NUCLEI, {"strain": q.LOCAL})

QUERIES_ = {
    "net10_co_occurrence": Query(Plan(k.CO_OCCURRENCE, {"series": n.SERIES}), "i j together ~share"),
    "net10_cascade_paths": Query(Plan(k.CASCADE_PATHS, {"initiators": INIT, "paths": Plan(n_.PATHS, {"links": n.LINKS})}), "initiator first_frame path hops ~weight"),
    "net14_material_pattern": Query(Plan(k.MATERIAL_PATTERN, {"strain": q.STRAIN}), "frame pattern ~worst", digits=4),
    "net14_strain_links": Query(Plan(k.STRAIN_LINKS, {"strain": q.STRAIN}), "i j ~corr", digits=4),
    "net14_dislocation_links": Query(Plan(k.DISLOCATION_LINKS, {"coordination": q.COORD}), "i j n ~gap"),
    "cau6_tensor_causality": Query(Plan(k.TENSOR_CAUSALITY, {"strain": q.STRAIN}), "i j lag ~cosine", digits=4),
    "cau6_dislocation_causality": Query(Plan(k.DISLOCATION_CAUSALITY, {"coordination": q.COORD}), "i j lag ~p"),
    "cau7_crack_causality": Query(Plan(k.CRACK_CAUSALITY, {"damage": q.RDAM}), "i j ~p"),
    "mat14_prediction": Query(Plan(k.PREDICTION, {"failure": FAILURE, "damage": SUMMARY}), "~failure_probability driver"),
    "mat17_event_totals": Query(Plan(k.EVENT_TOTALS, {"events": d.HOURLY_EVENTS, "series": HOURLY}), "run_id event_id ~total frames class"),
    "mat22_fatigue_cycles": Query(Plan(k.FATIGUE_CYCLES, {"events": d.EVENTS, "rmsf": q.RMSF}), "event_id cycles new_defects ~worst_rmsf"),
    "mat23_mechanism": Query(Plan(k.MECHANISM, {"energy": ENERGY, "nuclei": NUCLEI, "damage": q.RDAM}), "frame mechanism ~severity"),
    "grp6_first_groups": Query(Plan(k.FIRST_EVENTS, {"initiators": INIT, "events": d.EVENTS}), "g delay place"),
    "grp12_event_probability": Query(Plan(k.EVENT_PROBABILITY, {"events": q.EVENTS}), "~mean ~sd ~reliability", digits=4),
    "grp13_sources": Query(Plan(k.SOURCES, {"degrees": DEGREES}), "g place"),
    "asm3_bond_anomalies": Query(Plan(k.BOND_ANOMALIES, {"traj": TRAJ}), "frame #n_anomalies n_bonds"),
    "viz1_dashboard": Query(Plan(k.DASHBOARD, {"scores": d.FINAL, "tension": c.TENSION, "coherence": c.COHERENCE}), "run_id frame ~global_ ~local_ ~final ~rho_t ~coherence"),
}

QUERIES, ORACLES = tables(QUERIES_)
