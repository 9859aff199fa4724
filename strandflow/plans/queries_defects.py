"""Queries on defect networks of events, each with a statement of its own for the check."""

from __future__ import annotations

from strandflow.operators import defects as o
from strandflow.plans import queries_core as c
from strandflow.plans import queries_material as q
from strandflow.plans.op import Op, Plan
from strandflow.plans.queries_events import BROAD
from strandflow.plans.query import Query, tables
from strandflow.sources.adapters import ATOMS_DIM, CLUSTERS, TRAJ

UNIT = 0.045
ATOMS = Plan(c.f.DEFECT_ATOMS, {"member": CLUSTERS})
PATHS = Plan(o.PATHS, {"frames": Plan(o.EVENT_FRAMES, {"events": BROAD}), "traj": TRAJ, "atoms": ATOMS}, {"unit": UNIT})
TYPES = Plan(o.TYPES, {"paths": PATHS})
PAIRS = Plan(o.CELL_PAIRS, {"paths": PATHS})
STATS = Plan(o.PAIR_STATS, {"paths": PATHS, "pairs": PAIRS, "types": TYPES})
LINKS = Plan(o.LINKS, {"stats": STATS, "pairs": PAIRS, "kinds": ATOMS_DIM, "owner": Plan(o.OWNER, {"member": CLUSTERS})})
SCALED = Plan(Op("scaled", f"SELECT run_id, frame, atom_id, x * {UNIT} AS x, y * {UNIT} AS y, z * {UNIT} AS z FROM {{x}}", light=True), {"x": TRAJ})
FIELD = Plan(q.m.STRAIN_FIELD, {"traj": SCALED, "materials": q.MAT})

# An event at a time over lists of norms, all pairs, rules as stated; nothing of the plan but the events.
_OWN = f"""WITH ev AS MATERIALIZED ({BROAD.statement()}),
pos AS MATERIALIZED (SELECT e.event_id, e.start_frame, e.end_frame - e.start_frame + 1 AS n, a AS atom, list({UNIT} * sqrt(power({{x}}, 2) + power({{y}}, 2) + power({{z}}, 2)) ORDER BY vec_id) AS r,
    list([{UNIT} * {{x}}, {UNIT} * {{y}}, {UNIT} * {{z}}] ORDER BY vec_id) AS p FROM ev e JOIN embeddings v ON v.vec_id BETWEEN e.start_frame AND e.end_frame, range(9, 21) g(a) GROUP BY ALL),
kind AS (SELECT *, list_sum(list_transform(range(1, n), lambda t: sqrt(list_sum(list_transform([1, 2, 3], lambda k: power(p[t + 1][k] - p[t][k], 2)))))) AS len FROM pos),
typed AS (SELECT *, CASE WHEN len > n * 0.5 THEN 'dislocation' WHEN len > n * 0.2 THEN 'plastic' ELSE 'elastic' END AS type, 1 + (atom - 9) // 4 AS g FROM kind),
win AS (SELECT *, least(n, CASE type WHEN 'dislocation' THEN 5 WHEN 'plastic' THEN 10 ELSE 20 END) AS w FROM typed),
duo AS (SELECT a.event_id, a.n, a.atom AS i, b.atom AS j, a.g AS gi, b.g AS gj, a.type AS ti, b.type AS tj, least(a.w, b.w) AS w, a.r AS x, b.r AS y,
    list_transform(range(1, a.n + 1), lambda t: sqrt(list_sum(list_transform([1, 2, 3], lambda k: power(a.p[t][k] - b.p[t][k], 2))))) AS apart FROM win a JOIN win b ON a.event_id = b.event_id AND a.atom < b.atom),
cor AS (SELECT event_id, i, j, lag, corr(x[t], y[t + lag]) AS c FROM (SELECT *, unnest(range(1, CASE WHEN lag = 0 THEN w ELSE n - lag END + 1)) AS t FROM (SELECT *, unnest(range(0, least(4, w))) AS lag FROM duo WHERE n > 1)) GROUP BY ALL),
fact AS (SELECT d.*, apart[1] AS distance, CASE WHEN list_avg(apart) < 6 THEN 1 / (1 + list_avg(apart)) ELSE 0 END AS coupling,
    (SELECT coalesce(max(CASE WHEN isfinite(c) THEN c END), 0) FROM cor k WHERE k.event_id = d.event_id AND k.i = d.i AND k.j = d.j AND lag = 0) AS sync,
    (SELECT arg_max(struct_pack(c := abs(c), lag := lag), [round(abs(c), 9), -lag]) FROM cor k WHERE k.event_id = d.event_id AND k.i = d.i AND k.j = d.j AND lag > 0 AND isfinite(c)) AS top FROM duo d),
links AS (SELECT event_id, i, j, gi, gj, 'elastic' AS link_type, abs(sync) AS strength, 0 AS lag, distance, coupling AS stress_transfer FROM fact WHERE n > 1 AND ti = 'elastic' AND tj = 'elastic' AND abs(sync) > 0.7 AND distance < 6
  UNION ALL SELECT event_id, i, j, gi, gj, 'plastic', top.c, top.lag, distance, coupling FROM fact WHERE n > 1 AND 'plastic' IN (ti, tj) AND top.c > 0.5 AND distance < 6
  UNION ALL SELECT event_id, i, j, gi, gj, 'fracture', coupling, 0, distance, coupling * 210 FROM fact WHERE n > 1 AND 'dislocation' IN (ti, tj) AND coupling > 0.5 AND distance < 6
  UNION ALL SELECT event_id, i, j, gi, gj, 'elastic', 1 / (1 + distance), 0, distance, CASE WHEN j < 15 THEN 1.2 WHEN i < 18 AND j >= 15 AND (i >= 15 OR j < 18) THEN 1.5 ELSE 1.0 END / (1 + distance) FROM fact WHERE n = 1 AND distance < 4)
""".format(x="embedding[3 * a + 1]::DOUBLE * 40", y="embedding[3 * a + 2]::DOUBLE * 40", z="embedding[3 * a + 3]::DOUBLE * 40")

QUERIES_ = {
    "net17_defect_types": Query(TYPES, "event_id atom_id ~path_length type w", sql=_OWN + "SELECT event_id, atom AS atom_id, coalesce(len, 0) AS path_length, CASE WHEN n = 1 THEN 'elastic' ELSE type END AS type, w FROM win"),
    "net17_defect_links": Query(LINKS, "event_id i j gi gj link_type ~strength lag ~distance ~stress_transfer", sql=_OWN + "SELECT * FROM links"),
    "net17_defect_density": Query(Plan(o.DENSITY, {"paths": PATHS, "pairs": Plan(o.CELL_PAIRS, {"paths": PATHS}, {"reach": 0.4})}, {"reach": 0.4}), "event_id atom_id neighbours ~density", digits=4,
        sql=_OWN + "SELECT a.event_id, a.atom AS atom_id, count(f.i) AS neighbours, count(f.i) / (4.0 / 3 * pi() * 0.064) AS density FROM pos a LEFT JOIN fact f ON f.event_id = a.event_id AND a.atom IN (f.i, f.j) AND f.distance < 0.4 GROUP BY a.event_id, a.atom"),
    "net17_defect_pattern": Query(Plan(o.PATTERN, {"links": LINKS, "events": BROAD}), "event_id #n_elastic #n_plastic #n_fracture pattern",
        sql=_OWN + "SELECT e.event_id, e, p, f, e AS n_elastic, p AS n_plastic, f AS n_fracture, CASE WHEN n = 1 THEN 'elastic' WHEN f > p THEN 'crack_propagation' WHEN p > e THEN 'plastic_flow' ELSE 'elastic_deformation' END AS pattern FROM (SELECT v.event_id, v.end_frame - v.start_frame + 1 AS n, count(*) FILTER (link_type = 'elastic') AS e, count(*) FILTER (link_type = 'plastic') AS p, count(*) FILTER (link_type = 'fracture') AS f FROM ev v LEFT JOIN links l USING (event_id) GROUP BY ALL) e"),
    "net17_dislocation_cores": Query(Plan(o.CORES, {"links": LINKS, "types": TYPES}), "event_id atom_id degree place",
        sql=_OWN + "SELECT event_id, atom_id, degree, place FROM (SELECT event_id, atom_id, degree, row_number() OVER (PARTITION BY event_id ORDER BY degree DESC, atom_id) AS place FROM (SELECT event_id, atom_id, count(*) AS degree FROM (SELECT event_id, unnest([i, j]) AS atom_id FROM links WHERE link_type = 'plastic') GROUP BY event_id, atom_id)) JOIN win w USING (event_id) WHERE w.atom = atom_id AND place <= 10 AND degree >= 3 AND type = 'dislocation'"),
    "net17_crack_tips": Query(Plan(o.TIPS, {"strongest": Plan(o.STRONGEST, {"links": LINKS})}), "event_id atom_id place",
        sql=_OWN + "SELECT event_id, atom_id, place FROM (SELECT event_id, unnest(list_sort(list_distinct(flatten(list([i, j]))))[:5]) AS atom_id, unnest(range(1, least(5, len(list_distinct(flatten(list([i, j])))))+1)) AS place FROM (SELECT * FROM links WHERE link_type = 'fracture' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(stress_transfer, 9) DESC, i, j) <= 5) GROUP BY event_id)"),
    "net17_concentrators": Query(Plan(o.CONCENTRATORS, {"field": FIELD, "atoms": ATOMS}, {"sigmas": 1.0}), "atom_id ~strain place",
        sql=f"WITH f AS (SELECT a AS atom_id, least(0.5, avg(step) / 2.87) AS strain FROM (SELECT a, {UNIT} * 40 * sqrt(list_sum(list_transform([1, 2, 3], lambda k: power(embedding[3 * a + k]::DOUBLE - (lag(embedding) OVER w)[3 * a + k]::DOUBLE, 2)))) AS step FROM embeddings, range(9, 21) g(a) WINDOW w AS (PARTITION BY a ORDER BY vec_id)) GROUP BY a) SELECT atom_id, strain, row_number() OVER (ORDER BY atom_id) AS place FROM f WHERE strain > (SELECT avg(strain) + stddev_pop(strain) FROM f) QUALIFY place <= 10"),
    "net17_bridges": Query(Plan(o.BRIDGES, {"links": LINKS, "events": BROAD}), "event_id gi gj n_links ~total_strength ~most_stress bridge_type",
        sql=_OWN + "SELECT event_id, gi, gj, count(*) AS n_links, sum(strength) AS total_strength, max(stress_transfer) AS most_stress, CASE WHEN max(stress_transfer) > 2.1 THEN 'crack' WHEN sum(strength) > 2 THEN 'dislocation' ELSE 'grain_boundary' END AS bridge_type FROM links JOIN ev USING (event_id) WHERE gi <> gj AND (start_frame = end_frame OR link_type <> 'elastic') GROUP BY ALL"),
}

QUERIES, ORACLES = tables(QUERIES_)
