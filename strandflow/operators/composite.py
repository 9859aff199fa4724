"""Operators that combine earlier results: cascades, material networks, predictions and event bookkeeping."""

from __future__ import annotations

from strandflow.plans.op import Op

CO_OCCURRENCE = Op("co_occurrence", "SELECT a.run_id AS i, b.run_id AS j, count(*) AS together, count(*) * 1.0E0 / max(n.n) AS share FROM {series} a JOIN {series} b ON b.frame = a.frame AND a.run_id < b.run_id CROSS JOIN (SELECT count(DISTINCT frame) AS n FROM {series}) n WHERE a.v > <level> AND b.v > <level> GROUP BY a.run_id, b.run_id", {"level": 1.0})
CASCADE_PATHS = Op("cascade_paths", "SELECT i.g AS initiator, i.first_frame, p.path, p.hops, p.weight FROM {initiators} i JOIN {paths} p ON position('/' || i.g || '/' IN p.path) = 1")
MATERIAL_PATTERN = Op("material_pattern", "SELECT frame, CASE WHEN worst > <fracture> THEN 'fracture' WHEN worst > <plastic> THEN 'dislocation' WHEN worst < <elastic> THEN 'strain' ELSE 'general' END AS pattern, worst FROM (SELECT frame, max(strain) AS worst FROM {strain} GROUP BY frame) s", {"elastic": 0.05, "plastic": 0.1, "fracture": 10.0})
STRAIN_LINKS = Op("strain_links", """SELECT a.group_id AS i, b.group_id AS j, CASE WHEN stddev_pop(a.strain) > 1E-10 AND stddev_pop(b.strain) > 1E-10 THEN covar_pop(a.strain, b.strain) / (stddev_pop(a.strain) * stddev_pop(b.strain)) ELSE 0 END AS corr FROM {strain} a JOIN {strain} b ON b.frame = a.frame AND a.group_id < b.group_id WHERE a.frame > 0 GROUP BY a.group_id, b.group_id""")
DISLOCATION_LINKS = Op("dislocation_links", "SELECT a.group_id AS i, b.group_id AS j, count(*) AS n, avg(abs(a.coord - b.coord)) AS gap FROM {coordination} a JOIN {coordination} b ON b.frame = a.frame AND a.group_id < b.group_id WHERE abs(a.coord - <ideal>) > <off> AND abs(b.coord - <ideal>) > <off> GROUP BY a.group_id, b.group_id", {"ideal": 8.0, "off": 2.0})
TENSOR_CAUSALITY = Op("tensor_causality", """SELECT a.group_id AS i, b.group_id AS j, l.lag, avg(CASE WHEN a.strain > 1E-12 AND b.strain > 1E-12 THEN (a.e00 * b.e00 + a.e11 * b.e11 + a.e22 * b.e22 + 2 * (a.e01 * b.e01 + a.e02 * b.e02 + a.e12 * b.e12)) / (a.strain * b.strain) ELSE 0 END) AS cosine
    FROM {strain} a CROSS JOIN (SELECT RANGE(1, <lags>)RANGE AS lag) l JOIN {strain} b ON b.frame = a.frame + l.lag AND b.group_id <> a.group_id GROUP BY a.group_id, b.group_id, l.lag""", {"lags": 5},
    spark="""SELECT a.group_id AS i, b.group_id AS j, a.lag, avg(CASE WHEN a.strain > 1E-12 AND b.strain > 1E-12 THEN (a.e00 * b.e00 + a.e11 * b.e11 + a.e22 * b.e22 + 2 * (a.e01 * b.e01 + a.e02 * b.e02 + a.e12 * b.e12)) / (a.strain * b.strain) ELSE 0 END) AS cosine
    FROM (SELECT *, RANGE(1, <lags>)RANGE AS lag FROM {strain}) a JOIN {strain} b ON b.frame = a.frame + a.lag AND b.group_id <> a.group_id GROUP BY a.group_id, b.group_id, a.lag""")
DISLOCATION_CAUSALITY = Op("dislocation_causality", "SELECT a.group_id AS i, b.group_id AS j, l.lag, avg(CASE WHEN abs(b.coord - <ideal>) > <off> THEN 1.0E0 ELSE 0.0E0 END) AS p FROM {coordination} a CROSS JOIN (SELECT RANGE(1, <lags>)RANGE AS lag) l JOIN {coordination} b ON b.frame = a.frame + l.lag AND b.group_id <> a.group_id WHERE abs(a.coord - <ideal>) > <off> GROUP BY a.group_id, b.group_id, l.lag", {"ideal": 8.0, "off": 3.0, "lags": 5},
    spark="""SELECT a.group_id AS i, b.group_id AS j, a.lag, avg(CASE WHEN abs(b.coord - <ideal>) > <off> THEN 1.0E0 ELSE 0.0E0 END) AS p FROM (SELECT group_id, frame, RANGE(1, <lags>)RANGE AS lag FROM {coordination} WHERE abs(coord - <ideal>) > <off>) a
    JOIN {coordination} b ON b.frame = a.frame + a.lag AND b.group_id <> a.group_id GROUP BY a.group_id, b.group_id, a.lag""")
CRACK_CAUSALITY = Op("crack_causality", "SELECT i, j, sum(CASE WHEN spread THEN 1 ELSE 0 END) * 1.0E0 / count(*) * least(1.0E0, avg(k) / <toughness>) AS p FROM (SELECT a.group_id AS i, b.group_id AS j, b.damage > <level> AS spread, a.damage * sqrt(pi()) AS k FROM {damage} a JOIN {damage} b ON b.frame = a.frame + 1 AND b.group_id <> a.group_id WHERE a.damage > <level>) c GROUP BY i, j", {"level": 0.99, "toughness": 3.0})
PREDICTION = Op("prediction", "SELECT least(1.0E0, greatest(max(p), max(worst))) AS failure_probability, CASE WHEN max(p) > max(worst) THEN 'static' ELSE 'damage' END AS driver FROM (SELECT p, 0.0E0 AS worst FROM {failure} UNION ALL SELECT 0.0E0, final_damage FROM {damage}) u")
EVENT_TOTALS = Op("event_totals", "SELECT e.run_id, e.event_id, sum(s.v) AS total, count(*) AS frames, CASE WHEN sum(s.v) > 10 THEN 'severe' ELSE 'mild' END AS class FROM {events} e JOIN {series} s ON s.run_id = e.run_id AND s.frame BETWEEN e.start_frame AND e.end_frame GROUP BY e.run_id, e.event_id")
FATIGUE_CYCLES = Op("fatigue_cycles", "SELECT e.event_id, e.end_frame - e.start_frame + 1 AS cycles, CAST(floor(0.1E0 * (e.end_frame - e.start_frame + 1)) AS INT) AS new_defects, coalesce(max(r.rmsf), 0) AS worst_rmsf FROM {events} e LEFT JOIN {rmsf} r ON r.window_ = CAST(floor(e.start_frame / <half>) AS INT) GROUP BY e.event_id, e.start_frame, e.end_frame", {"half": 50})
MECHANISM = Op("mechanism", "SELECT frame, CASE WHEN phase = 'liquid' THEN 'melting' WHEN n > 3 THEN 'nucleation' WHEN worst > 0.5E0 THEN 'ductile' ELSE 'none' END AS mechanism, least(1.0E0, worst) AS severity FROM (SELECT e.frame, e.phase, coalesce(max(n.n), 0) AS n, max(d.damage) AS worst FROM {energy} e LEFT JOIN (SELECT frame, count(*) AS n FROM {nuclei} GROUP BY frame) n ON n.frame = e.frame JOIN {damage} d ON d.frame = e.frame GROUP BY e.frame, e.phase) x")
EVENT_PROBABILITY = Op("event_probability", "SELECT avg(damage) AS mean, stddev_pop(damage) AS sd, CASE WHEN stddev_pop(damage) > 1E-10 THEN (1 - avg(damage)) / stddev_pop(damage) END AS reliability FROM {events}")
SOURCES = Op("sources", "SELECT g, out_degree, place FROM (SELECT g, out_degree, row_number() OVER (ORDER BY out_degree DESC, g) AS place FROM {degrees}) p WHERE place <= 3")
FIRST_EVENTS = Op("first_events", "SELECT g, delay, place FROM (SELECT i.g, i.first_frame - e.start_frame AS delay, row_number() OVER (ORDER BY i.first_frame - e.start_frame, i.g) AS place FROM {initiators} i CROSS JOIN (SELECT min(start_frame) AS start_frame FROM {events}) e WHERE i.first_frame >= e.start_frame) p WHERE place <= 3")
BOND_ANOMALIES = Op("bond_anomalies", "SELECT a.frame, sum(CASE WHEN sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) NOT BETWEEN <lo> AND <hi> THEN 1 ELSE 0 END) AS n_anomalies, count(*) AS n_bonds FROM {traj} a JOIN {traj} b ON b.run_id = a.run_id AND b.frame = a.frame AND b.atom_id = a.atom_id + 1 GROUP BY a.frame", {"lo": 4.0, "hi": 20.0})
DASHBOARD = Op("dashboard", "SELECT f.run_id, f.frame, f.global_, f.local_, f.final, t.rho_t, c.coherence FROM {scores} f JOIN {tension} t ON t.run_id = f.run_id AND t.frame = f.frame JOIN {coherence} c ON c.run_id = f.run_id AND c.frame = f.frame")
