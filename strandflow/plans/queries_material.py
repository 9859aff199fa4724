"""Queries on material physics, atom-level impact, assessment and report tables."""

from __future__ import annotations

from strandflow.operators import impact as i
from strandflow.operators import material as m
from strandflow.plans import queries_core as c
from strandflow.plans import queries_detect as d
from strandflow.plans import queries_network as n
from strandflow.plans.op import Op, Plan
from strandflow.plans.query import Query, tables
from strandflow.sources.adapters import ATOMS_DIM, CLUSTERS, HOURLY, KV, TRAJ, WANTED

MAT = m.MATERIAL_TABLE
COORD = Plan(m.CLUSTER_COORDINATION, {"coordination": c.COORD, "member": CLUSTERS})
STRAIN = Plan(m.STRAIN, {"traj": TRAJ, "member": CLUSTERS})
RDAM = Plan(m.RMSD_DAMAGE, {"traj": TRAJ, "member": CLUSTERS})
COH = Plan(m.MATERIAL_COHERENCE, {"coordination": COORD, "strain": STRAIN})
INSTANT = Plan(m.INSTANT_DAMAGE, {"kv": KV})
DAMAGE = Plan(m.CUMULATIVE_DAMAGE, {"damage": INSTANT})
RATE = Plan(m.DAMAGE_RATE, {"damage": DAMAGE})
RMSF = Plan(m.RMSF, {"traj": TRAJ})
EVENTS = Plan(m.CLUSTER_EVENTS, {"strain": STRAIN, "materials": MAT})
LOCAL = Plan(c.f.LOCAL_STRAIN, {"traj": TRAJ})
CLUSTER = Plan(Op("cluster_state", "SELECT s.group_id, s.frame, s.strain, k.coord FROM {s} s JOIN {k} k ON k.frame = s.frame AND k.group_id = s.group_id"), {"s": STRAIN, "k": COORD})
WORST = Plan(Op("worst", "SELECT frame, max(damage) AS damage FROM {x} GROUP BY frame"), {"x": RDAM})
Z = Plan(i.ATOM_Z, {"traj": TRAJ})
ORIGINS = Plan(i.ORIGINS, {"z": Z, "member": CLUSTERS})
#: Two of 21 atoms are rarely 2.5 deviations off in one frame: links are drawn from 1.5 on.
ALINKS = Plan(i.ATOM_LINKS, {"origins": Plan(i.ORIGINS, {"z": Z, "member": CLUSTERS}, {"sigmas": 1.5}), "traj": TRAJ})
ADEG = Plan(i.ATOM_DEGREES, {"origins": ALINKS.inputs["origins"], "links": ALINKS})
PATTERNS = Plan(i.PATTERNS, {"events": d.EVENTS, "links": n.LINKS})
ANOMALY = Plan(i.EVENT_ANOMALY, {"patterns": PATTERNS, "flow": c.FLOW, "tension": c.TENSION, "synchrony": c.SYNC})
AXES = Plan(i.AXES, {"anomaly": ANOMALY})
SIGN = Plan(i.SIGNATURES, {"axes": AXES})

QUERIES_ = {
    "prj11_material_lookup": Query(Plan(m.LOOKUP, {"wanted": WANTED, "materials": MAT}), "part wanted code e_gpa yield_gpa ideal_coord unknown"),
    "mat1_coordination": Query(COORD, "frame group_id ~coord"),
    "mat2_strain": Query(STRAIN, "frame group_id ~e00 ~e11 ~e22 ~e01 ~strain", digits=4),
    "mat3_rmsd_damage": Query(RDAM, "frame group_id ~damage"),
    "mat4_defect_charge": Query(Plan(m.DEFECT_CHARGE, {"coordination": COORD, "flow": c.CLU_FLOW}), "group_id frame ~q ~q_cum"),
    "mat6_material_coherence": Query(COH, "frame ~coherence"),
    "mat7_instant_damage": Query(INSTANT, "frame cluster_id ~d"),
    "mat8_cumulative_damage": Query(DAMAGE, "cluster_id frame ~damage"),
    "mat9_damage_rate": Query(RATE, "cluster_id frame ~rate"),
    "mat9_damage_summary": Query(Plan(m.DAMAGE_SUMMARY, {"rate": RATE}), "cluster_id ~final_damage ~final_rate critical ~failure_probability ~remaining"),
    "mat10_material_state": Query(Plan(m.MATERIAL_STATE, {"damage": DAMAGE, "kv": KV}), "frame ~health state"),
    "mat11_event_kinds": Query(Plan(m.EVENT_KINDS, {"events": d.EVENTS, "coherence": COH, "strain": STRAIN, "rmsd_damage": RDAM}), "run_id event_id start_frame end_frame kind"),
    "mat12_event_by_score": Query(Plan(m.EVENT_BY_SCORE, {"events": d.HOURLY_EVENTS}), "run_id event_id kind duration"),
    "mat13_failure": Query(Plan(m.FAILURE, {"strain": STRAIN, "materials": MAT}), "group_id ~max_strain ~p", digits=4),
    "mat15_temperature": Query(Plan(m.TEMPERATURE, {"kv": KV}), "frame cluster_id ~kelvin ~kv"),
    "mat16_stress_curve": Query(Plan(m.STRESS_CURVE, {"strain": STRAIN, "materials": MAT}), "frame group_id ~stress", digits=4),
    "mat18_strain_field": Query(Plan(m.STRAIN_FIELD, {"traj": TRAJ, "materials": MAT}), "atom_id ~strain"),
    "mat19_rmsf": Query(RMSF, "window_ atom_id ~rmsf ~lindemann"),
    "mat20_energy": Query(Plan(m.ENERGY, {"traj": TRAJ}), "frame ~kinetic ~kelvin phase"),
    "mat21_nuclei": Query(Plan(m.NUCLEI, {"strain": LOCAL}), "frame first_atom last_atom n_atoms"),
    "mat24_critical_rmsf": Query(Plan(m.CRITICAL_RMSF, {"rmsf": RMSF, "materials": MAT}), "window_ n_critical ~worst"),
    "mat25_miner": Query(Plan(m.FATIGUE_LIFE, {"kv": KV}), "cluster_id ~miner levels", digits=9),
    "sta6_von_mises": Query(Plan(m.VON_MISES, {"strain": STRAIN}), "frame group_id ~stress", digits=3),
    "sta6_weibull": Query(Plan(m.WEIBULL, {"strain": STRAIN}), "group_id ~shape ~scale", digits=4),
    "sta7_reliability": Query(Plan(m.RELIABILITY, {"strain": STRAIN}), "group_id ~mean ~sd ~beta ~avg_over", digits=4),
    "grp5_roles": Query(Plan(n.n.DEGREES, {"links": n.LINKS}), "g role"),
    "grp7_importance": Query(Plan(i.IMPORTANCE, {"series": d.GROUP_ANOM, "events": d.EVENTS}), "g ~score place"),
    "grp9_cluster_events": Query(EVENTS, "group_id peak_frame ~peak_strain ~damage ~dislocation", digits=4),
    "grp10_reinforce": Query(Plan(m.REINFORCE, {"events": EVENTS}), "group_id ~damage place", digits=4),
    "grp11_health": Query(Plan(m.HEALTH, {"events": EVENTS}), "state ~health n", digits=4),
    "ano9_damage_blend": Query(Plan(d.d.DAMAGE_BLEND, {"series": d.FINAL_S, "damage": WORST}), "run_id frame ~v"),
    "ano13_cluster_anomaly": Query(Plan(d.d.CLUSTER_ANOMALY, {"cluster": CLUSTER}), "group_id frame ~a", digits=4),
    "atm1_atom_z": Query(Z, "frame atom_id ~step ~z"),
    "atm1_origins": Query(ORIGINS, "frame group_id atom_id ~z signature"),
    "atm2_waves": Query(Plan(i.WAVES, {"origins": ORIGINS, "z": Z}), "origin_frame origin frame atom_id ~z"),
    "atm4_degrees": Query(ADEG, "frame atom_id ~z degree hub"),
    "atm5_targets": Query(Plan(i.TARGETS, {"degrees": ADEG}), "atom_id priority ~score place"),
    "atm7_defect_events": Query(Plan(i.DEFECT_EVENTS, {"z": Z}), "frame atom_id kind"),
    "atm8_plastic_zone": Query(Plan(i.PLASTIC_ZONE, {"origins": ORIGINS, "traj": TRAJ, "centre": c.COM}), "frame ~radius n"),
    "atm10_owners": Query(Plan(i.OWNERS, {"atoms": ATOMS_DIM, "member": CLUSTERS}), "atom_id group_id"),
    "atm11_dispatch": Query(Plan(i.DISPATCH, {"events": d.EVENTS}), "run_id event_id form"),
    "net15_atom_links": Query(ALINKS, "frame from_id to_id ~distance ~strength"),
    "net15_atom_lag_links": Query(Plan(i.ATOM_LAG_LINKS, {"z": Z}), "from_id to_id ~corr"),
    "net16_atom_pattern": Query(Plan(i.ATOM_PATTERN, {"origins": ORIGINS}), "frame pattern n"),
    "net17_defect_classes": Query(Plan(i.DEFECT_CLASSES, {"z": Z}), "atom_id ~path_length class"),
    "asm1_patterns": Query(PATTERNS, "run_id event_id start_frame end_frame pattern n_bonds"),
    "asm2_event_anomaly": Query(ANOMALY, "run_id event_id duration ~jump ~z ~rho_t ~sigma_s"),
    "asm3_evidence": Query(Plan(i.EVIDENCE, {"events": d.EVENTS, "z": Z}), "event_id ~max_velocity ~max_acceleration"),
    "asm4_axes": Query(AXES, "run_id event_id pattern ~spatial ~sync ~temporal"),
    "asm5_signatures": Query(SIGN, "run_id event_id pattern signature ~confidence"),
    "asm6_cascade_info": Query(Plan(i.CASCADE_INFO, {"links": n.LINKS}), "from_id to_id ~strength lag place ~index_"),
    "asm7_summary": Query(Plan(i.SUMMARY, {"signatures": SIGN}), "pattern signature n ~confidence"),
    "ant1_contribution": Query(Plan(i.CDR, {"stats": Plan(c.f.GROUP_FRAME_STATS, {"traj": TRAJ, "member": c.RESIDUES})}), "group_id ~contribution ~affinity"),
    "ant2_paratope": Query(Plan(i.PARATOPE, {"coordination": c.COORD}), "atom_id ~frequency"),
    "rpt1_summary": Query(Plan(i.REPORT, {"series": d.FINAL_S}), "run_id ~mean ~std ~most ~least_ #over2 #over3 n"),
    "rpt2_hourly_summary": Query(Plan(i.REPORT, {"series": HOURLY}), "run_id ~mean ~std ~most n", digits=9),
    "viz2_flow_table": Query(Plan(i.FLOW_TABLE, {"links": n.LINKS}), "from_id to_id ~width style"),
    "viz3_heatmap": Query(Plan(i.HEATMAP, {"series": HOURLY}), "run_id bin ~level", digits=9),
}

QUERIES, ORACLES = tables(QUERIES_)
