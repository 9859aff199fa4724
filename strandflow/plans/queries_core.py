"""Queries on features, flow and series."""

from __future__ import annotations

from strandflow.operators import features as f
from strandflow.operators import flow as l
from strandflow.operators import series as s
from strandflow.plans.op import Op, Plan
from strandflow.plans.query import Query, tables
from strandflow.sources.adapters import ATOMS_DIM, CLUSTERS, HOURLY, RESIDUES, TRAJ

GRID = Op("grid", "SELECT run_id, CAST(frame % 24 AS INT) AS i, CAST(floor(frame / 24) AS INT) AS j, v FROM {series}", light=True)
COM = Plan(f.CENTRE, {"traj": TRAJ})
RMSD = Plan(f.RMSD, {"traj": TRAJ})
RG = Plan(f.GYRATION, {"traj": TRAJ})
FLOW = Plan(l.FLOW, {"path": COM})
ACCEL = Plan(l.ACCELERATION, {"flow": FLOW})
TENSION = Plan(l.TENSION, {"path": COM})
ROTATION = Plan(l.ROTATION, {"flow": FLOW})
QCUM = Plan(l.CUMULATIVE_ROTATION, {"rotation": ROTATION})
PAIR = Plan(l.RMSD_RG, {"rmsd": RMSD, "rg": RG})
SYNC = Plan(l.SYNCHRONY, {"pair": PAIR})
COHERENCE = Plan(l.COHERENCE, {"flow": FLOW})
RES = Plan(f.GROUP_CENTRES, {"traj": TRAJ, "member": RESIDUES})
CLU = Plan(f.GROUP_CENTRES, {"traj": TRAJ, "member": CLUSTERS})
RES_D = Plan(f.PAIR_DISTANCES, {"centres": RES})
CLU_D = Plan(f.PAIR_DISTANCES, {"centres": CLU})
RES_FLOW = Plan(l.GROUP_FLOW, {"centres": RES})
RES_TENSION = Plan(l.GROUP_TENSION, {"centres": RES})
CLU_FLOW = Plan(l.GROUP_FLOW, {"centres": CLU})
COORD = Plan(f.COORDINATION, {"traj": TRAJ})
DEFECTS = Plan(f.DEFECTS, {"coordination": COORD})

QUERIES_ = {
    "prj1_frame_slice": Query(Plan(f.FRAME_SLICE, {"traj": TRAJ}), "run_id frame atom_id ~x ~y ~z"),
    "prj2_atom_slice": Query(Plan(f.ATOM_SLICE, {"traj": TRAJ, "atoms": ATOMS_DIM}), "frame atom_id ~x ~y ~z"),
    "prj3_uniform_groups": Query(Plan(f.UNIFORM_GROUPS, {"traj": TRAJ}), "kind atom_id group_id"),
    "prj5_id_mapping": Query(Plan(f.ID_MAPPING, {"member": Plan(f.SUBDIVIDE, {"traj": TRAJ, "member": CLUSTERS})}), "group_id idx n_atoms parent_id sub_id siblings"),
    "prj6_subdivide": Query(Plan(f.SUBDIVIDE, {"traj": TRAJ, "member": CLUSTERS}), "parent_id group_id atom_id"),
    "prj7_defect_atoms": Query(Plan(f.DEFECT_ATOMS, {"member": CLUSTERS}), "atom_id"),
    "prj8_encode_types": Query(Plan(f.ENCODE_TYPES, {"atoms": ATOMS_DIM}), "atom_id atom_type type_code"),
    "prj9_grid_clusters": Query(Plan(f.GRID_CLUSTERS, {"traj": TRAJ}), "atom_id gx gy gz group_id"),
    "prj12_composition": Query(Plan(f.COMPOSITION, {"member": CLUSTERS, "atoms": ATOMS_DIM}), "group_id atom_type n ~share"),
    "fea1_rmsd": Query(RMSD, "run_id frame ~rmsd"),
    "fea2_gyration": Query(RG, "run_id frame ~rg"),
    "fea3_centre": Query(COM, "run_id frame ~x ~y ~z"),
    "fea4_contacts": Query(Plan(f.CONTACTS, {"traj": TRAJ}), "run_id frame contacts"),
    "fea5_dihedrals": Query(Plan(f.DIHEDRALS, {"traj": TRAJ}), "run_id frame k ~angle"),
    "fea6_group_centres": Query(RES, "kind group_id frame ~x ~y ~z"),
    "fea7_pair_distances": Query(RES_D, "frame i j ~d"),
    "fea8_coordination_histogram": Query(Plan(f.COORDINATION_HISTOGRAM, {"coordination": COORD}), "run_id frame coord n ~mean"),
    "fea8_local_strain": Query(Plan(f.LOCAL_STRAIN, {"traj": TRAJ}), "frame atom_id ~mean_disp ~disp"),
    "fea9_defects": Query(DEFECTS, "atom_id coord"),
    "fea10_expand_defects": Query(Plan(f.EXPAND_DEFECTS, {"defects": DEFECTS, "traj": TRAJ}), "atom_id"),
    "fea11_group_frame_stats": Query(Plan(f.GROUP_FRAME_STATS, {"traj": TRAJ, "member": RESIDUES}), "group_id ~rg ~density"),
    "fea11_gaussian_coupling": Query(Plan(f.GAUSSIAN_COUPLING, {"distances": RES_D}), "i j ~coupling"),
    "lam1_flow": Query(FLOW, "run_id frame ~lf_x ~lf_y ~lf_z ~lf_mag"),
    "lam2_acceleration": Query(ACCEL, "run_id frame ~lff_mag"),
    "lam3_tension": Query(TENSION, "run_id frame ~rho_t"),
    "lam4_rotation": Query(QCUM, "run_id frame ~q ~q_cum"),
    "lam5_synchrony": Query(SYNC, "run_id frame ~sigma_s"),
    "lam6_coherence": Query(COHERENCE, "run_id frame ~coherence"),
    "lam7_adaptive_windows": Query(Plan(l.ADAPTIVE_WINDOWS, {"rmsd": RMSD, "flow": FLOW}), "run_id n_frames ~scale tension fast slow"),
    "lam8_fixed_windows": Query(Plan(l.FIXED_WINDOWS, {"rmsd": RMSD}), "run_id primary_w fast_w slow_w"),
    "lam9_group_flow": Query(RES_FLOW, "group_id frame ~fx ~fy ~fz ~lf_mag"),
    "lam10_group_tension": Query(RES_TENSION, "group_id frame ~rho_t"),
    "lam11_residue_coupling": Query(Plan(l.RESIDUE_COUPLING, {"distances": RES_D}), "frame i j ~coupling"),
    "lam12_cluster_coupling": Query(Plan(l.CLUSTER_COUPLING, {"distances": CLU_D}), "frame i j ~coupling"),
    "ten1_gradient": Query(Plan(s.GRADIENT, {"series": HOURLY}), "run_id frame ~g"),
    "ten2_covariance_matrix": Query(Plan(s.COVARIANCE_MATRIX, {"series": HOURLY}), "i j ~cov ~corr"),
    "ten3_sliding": Query(Plan(s.SLIDING, {"series": HOURLY}), "run_id frame ~mean ~std ~var ~mx ~mn ~total", digits=9),
    "ten3_sliding_median": Query(Plan(s.SLIDING_MEDIAN, {"series": HOURLY}), "run_id frame ~med"),
    "ten4_convolve": Query(Plan(s.CONVOLVE, {"series": HOURLY}), "run_id frame ~c"),
    "ten4_convolve_2d": Query(Plan(s.CONVOLVE_2D, {"grid": Plan(GRID, {"series": HOURLY})}), "run_id i j ~c cells", digits=9),
    "ten5_gaussian_filter": Query(Plan(s.GAUSSIAN_FILTER, {"series": HOURLY}), "run_id frame ~v"),
    "ten8_rolling": Query(Plan(s.ROLLING, {"series": HOURLY}), "run_id frame ~mean ~std"),
    "ten9_moving_average": Query(Plan(s.MOVING_AVERAGE, {"series": HOURLY}), "run_id frame ~mean", digits=9),
    "ten10_local_std": Query(Plan(s.LOCAL_STD, {"series": HOURLY}, {"w": 25}), "run_id frame ~std"),
    "ten11_z_normalise": Query(Plan(s.Z_NORMALISE, {"series": HOURLY}), "run_id frame ~z"),
    "ext6_gaussian_smooth": Query(Plan(s.GAUSSIAN_SMOOTH, {"series": HOURLY}), "run_id frame ~v"),
    "ano1_local_z": Query(Plan(s.LOCAL_Z, {"series": HOURLY}), "run_id frame ~z"),
}

QUERIES, ORACLES = tables(QUERIES_)
