"""Queries on how long a material lasts, each with a statement of its own for the check."""

from __future__ import annotations

from strandflow.operators import lifetime as o
from strandflow.plans import queries_material as q
from strandflow.plans import queries_network as n
from strandflow.plans.op import Op, Plan
from strandflow.plans.queries_events import BROAD
from strandflow.plans.query import Query, tables
from strandflow.sources.adapters import TRAJ

#: The unit of length at which about half of the atoms are critical now and then.
UNIT = 0.0335
SMALL = Plan(Op("small", f"SELECT run_id, frame, atom_id, x * {UNIT} AS x, y * {UNIT} AS y, z * {UNIT} AS z FROM {{x}}", light=True), {"x": TRAJ})
#: Loads and their releases in turn: each lasts from an event's start to that of the next, the last to its event's end.
CYCLES = Plan(Op("cycles", "SELECT run_id, cycle, start_frame AS start_, CAST(coalesce(next_, end_frame + 1) AS INT) AS end_, cycle % 2 = 1 AS loading FROM (SELECT run_id, start_frame, end_frame, row_number() OVER w AS cycle, lead(start_frame) OVER w AS next_ FROM {x} WINDOW w AS (PARTITION BY run_id ORDER BY start_frame, end_frame, event_id)) e"), {"x": BROAD})
SPAN = Plan(o.SPAN, {"traj": SMALL})
FIELD = Plan(o.FIELD, {"traj": SMALL, "span": SPAN})
CRITICAL = Plan(o.CRITICAL, {"most": Plan(o.MOST, {"field": FIELD}), "materials": q.MAT})
DIVERGENCE = Plan(o.DIVERGENCE, {"field": FIELD, "critical": CRITICAL, "span": SPAN, "materials": q.MAT})
NUCLEI = Plan(o.NUCLEI, {"field": FIELD, "materials": q.MAT}, {"gap": 2})
GROWTH = Plan(o.GROWTH, {"nuclei": NUCLEI, "span": SPAN, "stress": Plan(q.m.VON_MISES, {"strain": q.STRAIN})})
MELTED = Plan(o.MELTED, {"cycles": CYCLES, "field": FIELD, "materials": q.MAT})
FATIGUE = Plan(o.FATIGUE, {"cycles": CYCLES, "melted": MELTED})
LIFE = Plan(o.LIFE, {"fatigue": FATIGUE, "span": SPAN})
PHASE = Plan(o.PHASE, {"traj": SMALL, "materials": q.MAT})
OUTLOOK = Plan(o.OUTLOOK, {"divergence": DIVERGENCE, "phase": PHASE, "growth": GROWTH, "life": LIFE, "materials": q.MAT})

# Windows by their bounds; series, islands and cycles as lists that are walked through.
_OWN = f"""WITH RECURSIVE n AS (SELECT count(*) AS n, least(100, count(*) // 10) AS w, greatest(1, least(100, count(*) // 10) // 2) AS s FROM embeddings),
f AS MATERIALIZED (SELECT k AS window_, a AS atom_id, {UNIT} * 40 * sqrt(list_sum([var_pop(embedding[3 * a + 1]::DOUBLE), var_pop(embedding[3 * a + 2]::DOUBLE), var_pop(embedding[3 * a + 3]::DOUBLE)])) AS rmsf
  FROM n, range(0, 100000) g(k), range(21) r(a), embeddings WHERE k <= (n.n - n.w) // n.s AND vec_id BETWEEN k * n.s AND k * n.s + n.w - 1 GROUP BY k, a),
hot AS (SELECT *, rmsf > 0.1 * 2.87 AS over_ FROM f),
bad AS (SELECT list_sort(list_distinct(list(atom_id))) AS atoms FROM hot WHERE over_),
e AS (SELECT list(rmsf ORDER BY window_) AS r FROM f, bad WHERE atom_id = atoms[1]),
g AS (SELECT list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i = 1 THEN r[2] - r[1] WHEN i = len(r) THEN r[i] - r[i - 1] ELSE (r[i + 1] - r[i - 1]) / 2 END) AS g FROM e),
dv AS (SELECT list_filter(range(1, len(g) + 1), lambda i: g[i] > list_avg(g) + 2 * list_stddev_pop(g))[1] - 1 AS k, list_max(g) AS rate FROM g),
gaps AS (SELECT window_, atom_id, count(*) FILTER (gap IS NULL OR gap > 2) OVER (PARTITION BY window_ ORDER BY atom_id) AS isle FROM (SELECT window_, atom_id, atom_id - lag(atom_id) OVER (PARTITION BY window_ ORDER BY atom_id) AS gap FROM hot WHERE over_)),
nu AS (SELECT window_, min(atom_id) AS first_atom, max(atom_id) AS last_atom, count(*) AS n_atoms FROM gaps GROUP BY window_, isle),
sz AS (SELECT list(size ORDER BY window_) AS s FROM (SELECT window_, max(n_atoms) AS size FROM nu GROUP BY window_)),
gr AS (SELECT len(s) AS windows, list_max(s) AS largest, s[-1] AS last_, coalesce(list_avg(list_transform(range(2, len(s) + 1), lambda i: s[i] - s[i - 1])), 0) AS mean_growth FROM sz),
ev AS MATERIALIZED (SELECT row_number() OVER (ORDER BY start_frame, end_frame, event_id) AS c, start_frame AS a, coalesce(lead(start_frame) OVER (ORDER BY start_frame, end_frame, event_id), end_frame + 1) AS b FROM ({BROAD.statement()})),
me AS MATERIALIZED (SELECT c, atom_id FROM ev JOIN f ON window_ >= a // 10 AND window_ < b // 10 WHERE c % 2 = 1 GROUP BY c, atom_id HAVING avg(rmsf) > 0.1 * 2.87),
ml AS (SELECT c, count(atom_id) AS m FROM ev LEFT JOIN me USING (c) GROUP BY c),
fa AS (SELECT c, m, CASE WHEN c % 2 = 0 THEN floor(0.1 * lag(m) OVER (ORDER BY c)) ELSE 0 END AS new_ FROM ml),
ac AS (SELECT c, c % 2 = 1 AS loading, m, new_, sum(new_) OVER (ORDER BY c) AS total FROM fa),
li AS (SELECT list(total ORDER BY c) AS t FROM ac),
lf AS (SELECT len(t) AS n_cycles, t[-1] AS defects, CASE WHEN len(t) > 1 THEN list_avg(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i = 1 THEN t[2] - t[1] WHEN i = len(t) THEN t[i] - t[i - 1] ELSE (t[i + 1] - t[i - 1]) / 2 END)) ELSE 0 END AS rate FROM li),
st AS (SELECT avg(abs(stress)) AS stress FROM ({Plan(q.m.VON_MISES, {"strain": q.STRAIN}).statement()}))
"""
_DIVERGENCE = "SELECT 'run0' AS run_id, (SELECT len(atoms) FROM bad) AS n_critical, max(rmsf) AS most, max(rmsf) / 2.87 AS ratio, avg(rmsf) / 2.87 AS lindemann_mean, (SELECT k * s FROM dv, n) AS divergence_time, (SELECT CASE WHEN k IS NULL THEN 0 ELSE rate END FROM dv) AS divergence_rate FROM f"
_GROWTH = "SELECT 'run0' AS run_id, windows, largest, mean_growth, 4 / stress AS critical_nm, CASE WHEN mean_growth > 0 AND 6.3 > last_ THEN (6.3 - last_) / mean_growth END AS coalescence FROM gr, st"
_LIFE = "SELECT 'run0' AS run_id, n_cycles, defects, rate, CASE WHEN rate > 0 THEN (2.1 - defects) / rate END AS cycles_left FROM lf"
_SERIES = f"""WITH sc AS MATERIALIZED ({n.SERIES.statement()}), pa AS ({n.PAIRS.statement()}), li AS (SELECT run_id AS g, list(v ORDER BY frame) AS v FROM sc GROUP BY run_id),
pr AS (SELECT p.i, p.j, lag, corr(x.v[t], y.v[t + lag]) AS c FROM pa p JOIN li x ON x.g = p.i JOIN li y ON y.g = p.j, range(1, 100) l(lag), range(1, 1000000) r(t) WHERE lag < len(x.v) // 2 AND t <= len(x.v) - lag GROUP BY ALL)
SELECT i, j, b.c AS strength, b.lag AS lag FROM (SELECT i, j, arg_min(struct_pack(c := abs(c), lag := lag), [-round(abs(c), 9), lag]) AS b FROM pr GROUP BY i, j) WHERE b.c >= 0.1"""

QUERIES_ = {
    "mat19_rmsf_field": Query(FIELD, "run_id window_ atom_id ~rmsf", sql=_OWN + "SELECT 'run0' AS run_id, * FROM f"),
    "mat19_divergence": Query(DIVERGENCE, "run_id #n_critical ~most ~ratio ~lindemann_mean #divergence_time ~divergence_rate", sql=_OWN + _DIVERGENCE),
    "mat21_damage_nuclei": Query(NUCLEI, "run_id window_ first_atom last_atom #n_atoms", sql=_OWN + "SELECT 'run0' AS run_id, * FROM nu"),
    "mat21_nuclei_growth": Query(GROWTH, "run_id #windows #largest ~mean_growth ~critical_nm ~coalescence", sql=_OWN + _GROWTH),
    "mat22_fatigue": Query(FATIGUE, "run_id #cycle loading #melted #new_defects #defects", sql=_OWN + "SELECT 'run0' AS run_id, c AS cycle, loading, m AS melted, new_ AS new_defects, total AS defects FROM ac"),
    "mat22_stress_concentration": Query(Plan(o.STRESSED, {"melted": MELTED}), "run_id atom_id ~concentration", sql=_OWN + "SELECT 'run0' AS run_id, atom_id, 0.1 * count(*) AS concentration FROM me GROUP BY atom_id"),
    "mat24_fatigue_life": Query(LIFE, "run_id #n_cycles #defects ~rate ~cycles_left", sql=_OWN + _LIFE),
    "mat23_outlook": Query(OUTLOOK, "run_id mechanism ~confidence ~time_to_failure", sql=_OWN + f""", d AS ({_DIVERGENCE}), gw AS ({_GROWTH}), lx AS ({_LIFE}),
ph AS (SELECT {UNIT} * 40 * sqrt(avg(v) / 3) / 2.87 > 0.1 AS liquid FROM (SELECT var_pop(embedding[3 * a + 1]::DOUBLE) + var_pop(embedding[3 * a + 2]::DOUBLE) + var_pop(embedding[3 * a + 3]::DOUBLE) AS v FROM embeddings, range(21) r(a) GROUP BY a))
SELECT 'run0' AS run_id, CASE WHEN coalesce(cycles_left, 1e9) < 1000 THEN 'fatigue_failure' WHEN liquid THEN 'phase_transition' WHEN ratio > 0.1 THEN 'local_melting' ELSE 'unknown' END AS mechanism,
  list_max([CASE WHEN ratio > 0.1 THEN least(1, ratio / 0.2) ELSE 0 END, CASE WHEN liquid THEN 0.9 ELSE 0 END, CASE WHEN coalesce(cycles_left, 1e9) < 1000 THEN 0.7 ELSE 0 END]) AS confidence,
  list_min([CASE WHEN divergence_rate > 0 AND most < 0.287 THEN (0.287 - most) / divergence_rate END, coalescence, 10 * cycles_left]) AS time_to_failure FROM d, gw, lx, ph"""),
    "cau6_general_causality": Query(Plan(o.GENERAL_CAUSALITY, {"series": n.SERIES, "pairs": n.PAIRS}, {"least": 0.1}), "i j ~strength lag", sql=_SERIES),
}

QUERIES, ORACLES = tables(QUERIES_)
