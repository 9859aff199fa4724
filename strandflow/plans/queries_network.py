"""Queries on networks, causality, statistics and evaluation."""

from __future__ import annotations

from strandflow.operators import network as n
from strandflow.operators import series as s
from strandflow.operators.quantiles import QUARTILES
from strandflow.plans import queries_core as c
from strandflow.plans import queries_detect as d
from strandflow.plans.op import Op, Plan
from strandflow.plans.query import Query, tables
from strandflow.sources.adapters import HOURLY

SERIES = d.GROUP_ANOM
NEAR = Plan(n.NEAR_PAIRS, {"distances": c.RES_D})
PAIRS = Plan(n.PAIR_NAMES, {"pairs": NEAR})
ALL = Plan(n.ALL_PAIRS, {"series": SERIES})
PROFILE = Plan(n.LAG_PROFILE, {"series": SERIES, "pairs": PAIRS})
LINKS = Plan(n.CAUSAL_LINKS, {"profile": PROFILE, "pairs": PAIRS})
TOP = Plan(n.TOP_CAUSAL, {"links": LINKS})
SYNC = Plan(n.SYNC_LINKS, {"profile": PROFILE, "pairs": PAIRS}, {"least": 0.05})
INSIDE = Plan(n.EVENT_SERIES, {"events": d.EVENTS, "series": SERIES})
MODE = Plan(n.NETWORK_MODE, {"inside": INSIDE})
#: Seven groups cannot differ by two deviations often: the line is drawn at one.
INSTANT = Plan(n.INSTANT_LINKS, {"inside": INSIDE, "events": d.EVENTS, "distances": c.RES_D}, {"sigmas": 1.0})
TRANSITION = Plan(n.TRANSITION_LINKS, {"inside": INSIDE, "pairs": PAIRS})
ECAUSE = Plan(n.EVENT_CAUSALITY, {"series": SERIES})
BEST = Plan(n.BEST_LAG, {"profile": ECAUSE})
BOOT = Plan(n.BOOTSTRAP_CORRELATION, {"series": SERIES})
#: Labelled events: runs of hours with unusually many events. Scores: the hourly mean value as z; boundaries: its peaks.
TRUTH = Plan(Op("truth", "SELECT run_id, event_id, start_frame, end_frame + 1 AS end_frame FROM {x}"), {"x": Plan(d.d.CRITICAL_EVENTS, {"series": d.as_series(HOURLY, "n")})})
SCORES = d.as_series(Plan(s.Z_NORMALISE, {"series": HOURLY}), "z")
BOUNDS = Plan(Op("high_peaks", "SELECT run_id, frame FROM {x} WHERE v >= high"), {"x": Plan(d.d.PEAK_CANDIDATES, {"series": SCORES})})
DETECTED = Plan(n.DETECTION, {"truth": TRUTH, "series": SCORES, "boundaries": BOUNDS})
SCORED = Plan(
    Op("scored", "SELECT s.run_id, round(s.v, 9) AS v, t.event_id IS NOT NULL AS truth FROM {series} s LEFT JOIN {truth} t ON t.run_id = s.run_id AND s.frame >= t.start_frame AND s.frame < t.end_frame"),
    {"series": SCORES, "truth": TRUTH},
)
ROC = Plan(n.ROC, {"scored": SCORED})
TIMING = Plan(n.TIMING, {"detection": DETECTED})

QUERIES_ = {
    "net1_near_pairs": Query(NEAR, "i j ~distance"),
    "net2_all_pairs": Query(ALL, "i j"),
    "net3_distance_tiers": Query(Plan(n.DISTANCE_TIERS, {"pairs": NEAR}), "i j ~tier"),
    "net4_adaptive_windows": Query(Plan(n.ADAPTIVE_GROUP_WINDOWS, {"series": SERIES}), "g w"),
    "net5_causal_links": Query(LINKS, "from_id to_id ~strength lag ~distance ~sync_rate link_type asynchronous"),
    "net6_top_causal": Query(TOP, "from_id to_id ~strength lag place"),
    "net6_sync_links": Query(SYNC, "i j ~sync_rate ~distance"),
    "net7_modes": Query(MODE, "event_id n mode"),
    "net8_instant_links": Query(INSTANT, "event_id i j ~strength ~distance strong"),
    "net9_transition_rules": Query(TRANSITION, "event_id from_id to_id kind ~strength lag ~sync_rate ~distance strong"),
    "net10_initiators": Query(Plan(n.INITIATORS, {"series": SERIES}), "g first_frame place"),
    "net11_degrees": Query(Plan(n.DEGREES, {"links": LINKS}), "g #out_degree #in_degree #degree role"),
    "net11_stats": Query(Plan(n.NETWORK_STATS, {"links": LINKS, "sync": SYNC, "pairs": NEAR}), "#n_causal #n_sync #n_async ~mean_strength ~mean_distance ~mean_lag #n_pairs ~async_ratio"),
    "net12_paths": Query(Plan(n.PATHS, {"links": LINKS}), "path hops ~weight"),
    "net16_bridges": Query(Plan(n.BRIDGES, {"links": LINKS}), "a b n_links ~total ~strongest least_lag"),
    "cau1_event_causality": Query(BEST, "i j lag ~p"),
    "cau2_transfer_entropy": Query(Plan(n.TRANSFER_ENTROPY, {"series": SERIES, "quartiles": Plan(QUARTILES, {"series": SERIES})}), "i j ~te"),
    "cau2_surrogate": Query(Plan(n.SURROGATE_TE, {"series": SERIES}), "i j ~te"),
    "cau3_lag_profile": Query(Plan(n.LAG_PROFILE, {"series": SERIES, "pairs": ALL}), "i j lag ~corr n"),
    "cau4_ordered_pairs": Query(Plan(n.ORDERED_PAIRS, {"best": BEST}), "i j lag ~p place"),
    "sta1_bootstrap_correlation": Query(BOOT, "i j ~estimate ~lo ~hi ~bias ~se"),
    "sta2_bootstrap_statistics": Query(Plan(n.BOOTSTRAP_STATISTICS, {"series": SERIES}), "g stat ~estimate ~lo ~hi ~bias ~se"),
    "sta3_permutation": Query(Plan(n.PERMUTATION, {"series": SERIES}), "i j ~observed ~p_two ~p_greater ~p_less"),
    "sta4_null_p_value": Query(Plan(n.NULL_P_VALUE, {"series": SERIES}), "g ~observed ~null_mean ~p_two ~p_greater ~p_less significant"),
    "sta5_chain_confidence": Query(Plan(n.CHAIN_CONFIDENCE, {"links": TOP, "boot": BOOT}), "from_id to_id ~strength ~estimate ~lo ~hi ~se ~bias significant"),
    "evl1_detection": Query(DETECTED, "run_id event_id ~peak_score peak near_boundary sustained detected ~confidence start_error end_error"),
    "evl2_timing": Query(TIMING, "run_id ~mean_error ~median_error ~accuracy #n_events"),
    "evl3_roc": Query(ROC, "run_id ~roc_auc ~pr_auc ~fpr"),
    "evl4_overall": Query(Plan(n.OVERALL, {"detection": DETECTED, "timing": TIMING, "roc": ROC}), "run_id ~detection_rate ~confidence ~score grade"),
}

QUERIES, ORACLES = tables(QUERIES_)
