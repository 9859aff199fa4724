"""Queries on boundaries, breaks, scores and events."""

from __future__ import annotations

from strandflow.operators import detect as d
from strandflow.operators import series as s
from strandflow.operators.quantiles import MEDIAN
from strandflow.plans import queries_core as c
from strandflow.plans.op import Op, Plan
from strandflow.plans.query import Query, tables
from strandflow.sources.adapters import HOURLY


def as_series(plan: Plan, column: str, run: str = "run_id") -> Plan:
    """One column of a plan's result as (run_id, frame, v)."""
    return Plan(Op("series_of", f"SELECT {run} AS run_id, frame, {column} AS v FROM {{x}}", light=True), {"x": plan})


LF = as_series(c.FLOW, "lf_mag")
LFF = as_series(c.ACCEL, "lff_mag")
RHO = as_series(c.TENSION, "rho_t")
Q = as_series(c.ROTATION, "q")
QC = as_series(c.QCUM, "q_cum")
RG = as_series(c.RG, "rg")
RG_MEDIAN = Plan(MEDIAN, {"series": RG})
COH = as_series(c.COHERENCE, "coherence")
grad = lambda p: Plan(s.GRADIENT, {"series": p})
FD = Plan(d.FRACTAL, {"series": RHO})
ENT = Plan(d.ENTROPY, {"series": RHO})
COUP = Plan(d.COUPLING, {"series": QC})
COH1 = c.COHERENCE.with_params(default=1.0)
SCORE = Plan(d.BOUNDARY_SCORE, {"fractal_gradient": grad(as_series(FD, "fd")), "entropy_gradient": grad(as_series(ENT, "entropy")), "coherence": COH1, "coupling": COUP})
CAND = Plan(d.PEAK_CANDIDATES, {"series": as_series(SCORE, "score")})
STRONG = Plan(Op("strong", "SELECT run_id, frame, v AS strength FROM {x} WHERE v >= high"), {"x": CAND})
JUMPS = Plan(d.TENSION_JUMPS, {"series": RHO})
PHASE = Plan(d.PHASE_BREAKS, {"series": Q})
LFZ = Plan(d.CENTRED_Z, {"series": LF})
LFFZ = Plan(d.CENTRED_Z, {"series": LFF}, {"w": 12, "w1": 11})
GRAD_LF = grad(LF)
FLOW_ANOM = Plan(d.FLOW_ANOMALY, {"z": LFZ, "gradient": GRAD_LF, "gradient_std": Plan(s.ROLLING, {"series": as_series(GRAD_LF, "abs(g)")}, {"w": 25})})
gauss = lambda sigma: Plan(s.GAUSSIAN_FILTER, {"series": RHO}, {"sigma": sigma, "reach": s.gaussian_reach(sigma)})
MULTI = Plan(d.MULTISCALE_JUMP, {"deviations": Plan(d.SCALE_DEVIATIONS, {"series": RHO, "a": gauss(4.0), "b": gauss(8.0), "c": gauss(12.0)})})
DEV = Plan(d.LINEAR_DEVIATION, {"totals": Plan(s.TOTALS, {"series": Q})})
CHARGE = Plan(d.CHARGE_BREAK, {"phase": PHASE, "deviation_gradient": grad(DEV)})
COHB = Plan(d.COHERENCE_BREAK, {"gradient": grad(COH)})
EXT = Plan(d.EXTREMA, {"series": RHO})
DIV_SUM = Plan(d.DIVERGENCE_SUM, {"gx": grad(as_series(c.FLOW, "lf_x")), "gy": grad(as_series(c.FLOW, "lf_y")), "gz": grad(as_series(c.FLOW, "lf_z"))})
DIV = Plan(d.DIVERGENCE, {"sum": DIV_SUM})
PAIR = Plan(Op("flow_tension", "SELECT f.run_id, f.frame, f.lf_mag AS a, t.rho_t AS b FROM {f} f JOIN {t} t ON t.run_id = f.run_id AND t.frame = f.frame"), {"f": c.FLOW, "t": c.TENSION})
SING = Plan(d.SINGULARITIES, {"extrema": EXT, "divergence": DIV, "decorrelation": Plan(d.DECORRELATION, {"pair": PAIR})})
BREAKS = Plan(d.COMBINED_BREAKS, {"flow": FLOW_ANOM, "acceleration": LFFZ, "jump": MULTI, "charge": CHARGE, "coherence": COHB, "singular": SING})
GLOBAL = Plan(d.GLOBAL_SCORE, {"flow": FLOW_ANOM, "acceleration": LFFZ, "jump": MULTI, "charge": CHARGE})
LOCAL = Plan(d.LOCAL_SCORE, {"boundary_score": SCORE, "boundaries": STRONG})
DRIFT = Plan(d.DRIFT, {"series": RHO})
GYR = Plan(d.GYRATION_CHANGE, {"gradient": grad(RG)})
EXTENDED = Plan(d.EXTENDED_SCORE, {"drift": DRIFT, "gyration": GYR, "phase": Plan(s.ROLLING, {"series": RHO}, {"w": 25})})
FINAL = Plan(d.FINAL_SCORE, {"global_score": GLOBAL, "local_score": LOCAL, "extended": EXTENDED})
FINAL_S = as_series(FINAL, "final")
EVENTS = Plan(d.CRITICAL_EVENTS, {"series": FINAL_S})
HOURLY_EVENTS = Plan(d.CRITICAL_EVENTS, {"series": HOURLY})
by_group = "CAST(group_id AS VARCHAR(10))"
GROUP_ANOM = Plan(d.GROUP_ANOMALY, {"flow_z": Plan(s.LOCAL_Z, {"series": as_series(c.RES_FLOW, "lf_mag", by_group)}), "tension_z": Plan(s.LOCAL_Z, {"series": as_series(c.RES_TENSION, "rho_t", by_group)})})

QUERIES_ = {
    "bnd1_fractal": Query(FD, "run_id frame ~fd"),
    "bnd2_coherence": Query(COH1, "run_id frame ~coherence"),
    "bnd3_coupling": Query(COUP, "run_id frame ~coupling"),
    "bnd4_entropy": Query(ENT, "run_id frame ~entropy"),
    "bnd5_boundary_score": Query(SCORE, "run_id frame ~score"),
    "bnd6_peak_candidates": Query(CAND, "run_id frame ~v ~high ~low n"),
    "bnd8_legacy_breaks": Query(Plan(d.LEGACY_BREAKS, {"flow_z": LFZ, "acceleration_z": LFFZ, "jumps": JUMPS, "phase": PHASE}), "run_id frame ~flow ~acceleration ~jump ~phase ~combined"),
    "bnd10_segments": Query(Plan(d.SEGMENTS, {"boundaries": STRONG}), "run_id start_frame end_frame pattern"),
    "top1_flow_anomaly": Query(FLOW_ANOM, "run_id frame ~anomaly"),
    "top2_sign_changes": Query(Plan(d.SIGN_CHANGES, {"flow": c.FLOW}), "run_id frame ~changes"),
    "top2_acceleration_anomaly": Query(LFFZ, "run_id frame ~z"),
    "top3_multiscale_jump": Query(MULTI, "run_id frame ~jump"),
    "top4_charge_break": Query(CHARGE, "run_id frame ~brk"),
    "top5_coherence_break": Query(COHB, "run_id frame ~brk"),
    "top6_singularities": Query(SING, "run_id frame ~s"),
    "top7_extrema": Query(EXT, "run_id frame extremum"),
    "top8_combined_breaks": Query(BREAKS, "run_id frame ~score"),
    "ano2_global_score": Query(GLOBAL, "run_id frame ~score"),
    "ano3_local_score": Query(LOCAL, "run_id frame ~score"),
    "ano4_extended_score": Query(EXTENDED, "run_id frame ~score"),
    "ano5_drift": Query(DRIFT, "run_id frame ~score"),
    "ano5_gyration_change": Query(GYR, "run_id frame ~score"),
    "ano6_final_score": Query(FINAL, "run_id frame ~global_ ~local_ ~combined ~final"),
    "ano8_critical_events": Query(EVENTS, "run_id event_id start_frame end_frame ~score"),
    "ano8_hourly_events": Query(HOURLY_EVENTS, "run_id event_id start_frame end_frame ~score"),
    "ano10_ranked_events": Query(Plan(d.RANKED_EVENTS, {"events": HOURLY_EVENTS, "series": HOURLY}), "run_id event_id start_frame end_frame ~score rank name"),
    "ano11_robust_score": Query(Plan(d.ROBUST_SCORE, {"series": RG, "median": RG_MEDIAN, "spread": Plan(MEDIAN, {"series": Plan(d.DEVIATION, {"series": RG, "median": RG_MEDIAN})})}), "frame ~z"),
    "ano12_group_anomaly": Query(GROUP_ANOM, "run_id frame ~v"),
}

QUERIES, ORACLES = tables(QUERIES_)
