"""Queries on the networks inside long events, with statements of their own for the check."""

from __future__ import annotations

from strandflow.operators import events as o
from strandflow.operators import network as n_
from strandflow.operators import series as s
from strandflow.plans import queries_core as c
from strandflow.plans import queries_detect as d
from strandflow.plans import queries_network as n
from strandflow.plans.op import Op, Plan
from strandflow.plans.query import Query, tables

#: Events of many lengths: runs of high scores, and of their means over 24 frames.
BROAD = Plan(
    Op("broad_events", "SELECT run_id, event_id, start_frame, end_frame FROM {a} UNION ALL SELECT run_id, 1000000 + event_id, start_frame, end_frame FROM {b}"),
    {"a": d.EVENTS, "b": Plan(d.d.CRITICAL_EVENTS, {"series": d.as_series(Plan(s.MOVING_AVERAGE, {"series": d.FINAL_S}), "mean")}, {"sigmas": 0.5})},
)
INSIDE = Plan(n_.EVENT_SERIES, {"events": BROAD, "series": d.GROUP_ANOM})
MODE = Plan(n_.NETWORK_MODE, {"inside": INSIDE})
PAIRS = Plan(o.NEAR_PAIRS, {"events": BROAD, "distances": c.RES_D})
PROFILE = Plan(o.LAG_PROFILE, {"inside": INSIDE, "pairs": PAIRS})
LINKS = Plan(o.LINKS, {"profile": PROFILE})
SYNC = Plan(o.SYNC_LINKS, {"profile": PROFILE})
LONG = Plan(Op("long_inside", "SELECT * FROM {x} WHERE n >= 10", light=True), {"x": INSIDE})
PEAKS = Plan(o.PEAKS, {"inside": LONG})
STARTS = Plan(o.INITIATORS, {"peaks": PEAKS, "links": LINKS})
PATHS = Plan(o.PATHS, {"initiators": STARTS, "links": LINKS})

# Of each long event the groups' scores as lists; lags and directions by slices of them.
_OWN = f"""WITH ev AS MATERIALIZED (SELECT event_id, start_frame, end_frame, end_frame - start_frame + 1 AS n FROM ({BROAD.statement()}) WHERE end_frame - start_frame >= 9),
sc AS MATERIALIZED ({d.GROUP_ANOM.statement()}), ds AS MATERIALIZED ({c.RES_D.statement()}),
li AS MATERIALIZED (SELECT event_id, n, start_frame, run_id AS g, list(v ORDER BY frame) AS v FROM ev JOIN sc ON frame BETWEEN start_frame AND end_frame GROUP BY ALL),
near AS (SELECT event_id, i::VARCHAR AS i, j::VARCHAR AS j, avg(d) AS distance FROM (SELECT event_id, start_frame + unnest(list_transform(range(0, 10), lambda k: floor(k * (n - 1) / 9)::INT)) AS frame FROM ev) e JOIN ds USING (frame) GROUP BY ALL HAVING avg(d) < 15),
co AS (SELECT event_id, i, j, distance, lag, way, corr(CASE WHEN way = 1 THEN x[t] ELSE x[t + lag] END, CASE WHEN way = 1 THEN y[t + lag] ELSE y[t] END) AS c FROM (SELECT *, unnest(range(1, n - lag + 1)) AS t FROM (
  SELECT *, unnest(range(0, least(200, n // 2), 10)) AS lag FROM (SELECT p.*, a.n, a.v AS x, b.v AS y, unnest([1, -1]) AS way FROM near p JOIN li a ON a.event_id = p.event_id AND a.g = p.i JOIN li b ON b.event_id = p.event_id AND b.g = p.j))) WHERE lag > 0 OR way = 1 GROUP BY ALL),
top AS (SELECT event_id, i, j, distance, arg_min(struct_pack(c := c, lag := lag, way := way), [-round(abs(c), 9), lag, -way]) AS b, max(CASE WHEN lag = 0 THEN c END) AS sync_rate FROM co GROUP BY ALL),
links AS (SELECT event_id, CASE WHEN b.way = 1 THEN i ELSE j END AS from_id, CASE WHEN b.way = 1 THEN j ELSE i END AS to_id, abs(b.c) AS strength, b.lag AS lag, distance, sync_rate, abs(sync_rate) <= 0.2 AS asynchronous FROM top WHERE abs(b.c) >= 0.2)
"""

QUERIES_ = {
    "grp3_event_networks": Query(Plan(n_.EVENT_STATS, {"mode": n.MODE, "instant": n.INSTANT, "transition": n.TRANSITION}), "event_id n mode #n_links #n_causal #n_strong ~mean_strength ~mean_distance"),
    "grp3_event_links": Query(LINKS, "event_id from_id to_id ~strength lag ~distance ~sync_rate asynchronous", sql=_OWN + "SELECT * FROM links"),
    "grp3_event_sync": Query(SYNC, "event_id i j ~sync_rate ~distance", sql=_OWN + "SELECT * FROM top WHERE abs(sync_rate) > 0.2"),
    "grp3_event_pairs": Query(Plan(Op("long_pairs", "SELECT * FROM {x} WHERE n >= 10"), {"x": PAIRS}), "event_id i j ~distance", sql=_OWN + "SELECT * FROM near"),
    "grp4_event_peaks": Query(PEAKS, "event_id g delay ~peak place"),
    "grp6_event_initiators": Query(STARTS, "event_id g reason"),
    "grp3_event_paths": Query(PATHS, "event_id path hops place"),
    "grp3_event_summary": Query(Plan(o.SUMMARY, {"mode": MODE, "links": LINKS, "sync": SYNC, "initiators": STARTS, "paths": PATHS}), "event_id n mode #n_causal #n_async #n_sync ~strength ~lag #n_initiators longest"),
}

QUERIES, ORACLES = tables(QUERIES_)
