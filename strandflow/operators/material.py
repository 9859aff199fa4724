"""Material physics: strain, damage, failure and fatigue. `traj` is (run_id, frame, atom_id, x, y, z), `member` (kind, group_id, atom_id), `kv` (run_id, frame, cluster_id, kv_ratio)."""

from __future__ import annotations

from strandflow.operators import scan
from strandflow.plans.op import Function, Op, Source

#: Material constants (GPa, angstrom, K, MPa m^0.5).
MATERIALS = [
    ("SUJ2", "BCC", 2.87, 210.0, 1.5, 2.0, 0.7, 30.0, 1811.0, 8, 0.10),
    ("AL7075", "FCC", 4.05, 71.7, 0.503, 0.572, 0.159, 23.0, 933.0, 12, 0.12),
    ("Ti6Al4V", "HCP", 2.95, 113.8, 0.88, 0.95, 0.51, 75.0, 1941.0, 12, 0.11),
    ("SS316L", "FCC", 3.58, 193.0, 0.205, 0.515, 0.24, 112.0, 1673.0, 12, 0.12),
]
_COLUMNS = "code, crystal, lattice, e_gpa, yield_gpa, ultimate_gpa, fatigue_gpa, k_ic, melting_k, ideal_coord, lindemann"
_VALUES = " UNION ALL ".join("SELECT " + ", ".join(f"{f'{v!r}' if isinstance(v, str) else f'CAST({v} AS DOUBLE)' if isinstance(v, float) else v} AS {c}" for v, c in zip(row, _COLUMNS.split(", "), strict=True)) for row in MATERIALS)
MATERIAL_TABLE = Source("materials", lambda spark, sf_dir: spark.sql(_VALUES), _VALUES)

LOOKUP = Op("material_lookup", "SELECT w.part, w.code AS wanted, coalesce(m.code, d.code) AS code, coalesce(m.e_gpa, d.e_gpa) AS e_gpa, coalesce(m.yield_gpa, d.yield_gpa) AS yield_gpa, coalesce(m.ideal_coord, d.ideal_coord) AS ideal_coord, m.code IS NULL AS unknown FROM {wanted} w LEFT JOIN {materials} m ON m.code = w.code CROSS JOIN (SELECT * FROM {materials} WHERE code = 'SUJ2') d")
CLUSTER_COORDINATION = Op("cluster_coordination", "SELECT c.run_id, c.frame, m.group_id, avg(c.coord * 1.0E0) AS coord FROM {coordination} c JOIN {member} m ON m.atom_id = c.atom_id GROUP BY c.run_id, c.frame, m.group_id")

_A, _B = ("x", "y", "z"), ("rx", "ry", "rz")
_SUMS = ", ".join([*(f"sum(({a} - m{a}) * ({b} - m{b})) AS h{i}{j}" for i, a in enumerate(_A) for j, b in enumerate(_B)), *(f"sum(({a} - m{a}) * ({b} - m{b})) + {'1E-6' if i == j else '0'} AS c{i}{j}" for i, a in enumerate(_B) for j, b in enumerate(_B))])


def _cofactor(i: int, j: int) -> str:
    """Entry (i, j) of the inverse of c, times its determinant."""
    r, s = [k for k in range(3) if k != j], [k for k in range(3) if k != i]
    sign = "" if (i + j) % 2 == 0 else "-"
    return f"{sign}(c{r[0]}{s[0]} * c{r[1]}{s[1]} - c{r[0]}{s[1]} * c{r[1]}{s[0]})"


_DET = "(" + " + ".join(f"c0{j} * ({_cofactor(j, 0)})" for j in range(3)) + ")"
_F = ", ".join("(" + " + ".join(f"h{i}{k} * ({_cofactor(k, j)})" for k in range(3)) + f") / {_DET} AS f{i}{j}" for i in range(3) for j in range(3))
_E = ", ".join("(" + " + ".join(f"f{k}{i} * f{k}{j}" for k in range(3)) + f" - {1 if i == j else 0}) / 2 AS e{i}{j}" for i in range(3) for j in range(3))
STRAIN = Op("strain", f"""SELECT *, sqrt({' + '.join(f'e{i}{j} * e{i}{j}' for i in range(3) for j in range(3))}) AS strain FROM (SELECT run_id, frame, group_id, {_E} FROM (SELECT run_id, frame, group_id, {_F} FROM (
    SELECT run_id, frame, group_id, {_SUMS} FROM (SELECT t.run_id, t.frame, m.group_id, t.x, t.y, t.z, r.x AS rx, r.y AS ry, r.z AS rz, {', '.join(f'avg(t.{a}) OVER w AS m{a}' for a in _A)}, {', '.join(f'avg(r.{a}) OVER w AS mr{a}' for a in _A)}, count(*) OVER w AS k
      FROM {{traj}} t JOIN {{member}} m ON m.atom_id = t.atom_id JOIN {{traj}} r ON r.run_id = t.run_id AND r.atom_id = t.atom_id AND r.frame = 0 WINDOW w AS (PARTITION BY t.run_id, t.frame, m.group_id)) p WHERE k >= 4 GROUP BY run_id, frame, group_id) s) d) e""",
    doc="deformation gradient H (C + 1e-6 I)^-1 by the adjugate, and E = (F'F - I) / 2")
RMSD_DAMAGE = Op("rmsd_damage", "SELECT t.run_id, t.frame, m.group_id, tanh(sqrt(avg(power(t.x - r.x, 2) + power(t.y - r.y, 2) + power(t.z - r.z, 2))) / 2) AS damage FROM {traj} t JOIN {member} m ON m.atom_id = t.atom_id JOIN {traj} r ON r.run_id = t.run_id AND r.atom_id = t.atom_id AND r.frame = 0 GROUP BY t.run_id, t.frame, m.group_id")
DEFECT_CHARGE = Op("defect_charge", """SELECT group_id, frame, q, sum(q) OVER (PARTITION BY group_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q_cum FROM (SELECT c.group_id, c.frame, tanh(0.3E0 * f.lf_mag + 0.2E0 * abs(c.coord - lag(c.coord, 1, c.coord) OVER (PARTITION BY c.group_id ORDER BY c.frame))) AS q
    FROM {coordination} c JOIN {flow} f ON f.group_id = c.group_id AND f.frame = c.frame) x""")
MATERIAL_COHERENCE = Op("material_coherence", "SELECT c.frame, avg(CASE WHEN abs(c.coord - <ideal>) < 1 AND s.strain < 0.01E0 THEN 1.0E0 WHEN abs(c.coord - <ideal>) < 2 THEN 0.7E0 ELSE 1 / (1 + abs(c.coord - <ideal>) + s.strain) END) AS coherence FROM {coordination} c JOIN {strain} s ON s.frame = c.frame AND s.group_id = c.group_id GROUP BY c.frame", {"ideal": 8.0})

INSTANT_DAMAGE = Op("instant_damage", "SELECT run_id, frame, cluster_id, CASE WHEN kv_ratio > <critical> THEN least(1.0E0, power((kv_ratio - <critical>) / <critical>, <exponent>) * <factor>) ELSE 0 END AS d FROM {kv}", {"critical": 1.5, "exponent": 2.0, "factor": 1.0})
CUMULATIVE_DAMAGE_PLAIN = """WITH RECURSIVE fold(run_id, cluster_id, frame, damage) AS (SELECT run_id, cluster_id, frame, d * <fatigue> FROM {damage} WHERE frame = 0
    UNION ALL SELECT f.run_id, f.cluster_id, d.frame, least(1.0, f.damage * (1 - <recovery>) + d.d * <fatigue>) FROM fold f JOIN {damage} d ON d.run_id = f.run_id AND d.cluster_id = f.cluster_id AND d.frame = f.frame + 1) SELECT run_id, cluster_id, frame, damage FROM fold"""


CUMULATIVE_DAMAGE = Function("cumulative_damage", CUMULATIVE_DAMAGE_PLAIN, {"recovery": 0.01, "fatigue": 1.0}, run=scan.cumulative_damage, doc="a scan over blocks; the check's form goes frame by frame")
DAMAGE_RATE = Op("damage_rate", "SELECT run_id, cluster_id, frame, damage, CASE WHEN p IS NULL AND q IS NULL THEN 0 WHEN p IS NULL THEN q - damage WHEN q IS NULL THEN damage - p ELSE (q - p) / 2 END AS rate FROM (SELECT run_id, cluster_id, frame, damage, lag(damage) OVER w AS p, lead(damage) OVER w AS q FROM {damage} WINDOW w AS (PARTITION BY run_id, cluster_id ORDER BY frame)) x")
DAMAGE_SUMMARY = Op("damage_summary", """SELECT cluster_id, final_damage, final_rate, critical, greatest(1 - exp(-power(max_damage / <d0>, <m>)), n_critical * 1.0E0 / n_clusters) AS failure_probability, CASE WHEN recent_rate > 1E-6 THEN greatest(0.0E0, (1 - final_damage) / recent_rate) END AS remaining FROM (
    SELECT *, sum(CASE WHEN critical THEN 1 ELSE 0 END) OVER () AS n_critical, count(*) OVER () AS n_clusters, max(most) OVER () AS max_damage FROM (SELECT r.cluster_id, max_by(r.damage, r.frame) AS final_damage, max_by(r.rate, r.frame) AS final_rate, max(r.damage) AS most, avg(CASE WHEN r.frame > n.last - 10 THEN r.rate END) AS recent_rate,
      max_by(r.damage, r.frame) > <percolation> OR max_by(r.rate, r.frame) > 0.1E0 AS critical FROM {rate} r CROSS JOIN (SELECT max(frame) AS last FROM {rate}) n GROUP BY r.cluster_id) c) s""", {"d0": 0.6, "m": 3.0, "percolation": 0.3})
MATERIAL_STATE = Op("material_state", """SELECT frame, health, CASE WHEN p > 0.8E0 OR worst > <ultimate> THEN 'failed' WHEN p > 0.5E0 OR health < 0.5E0 THEN 'critical' WHEN p > 0.2E0 THEN 'damaged' ELSE 'healthy' END AS state FROM (SELECT frame, p, worst, greatest(0.0E0, least(1.0E0, (1 - p) * CASE WHEN worst > <ultimate> THEN 0.1E0 WHEN worst > <yield> THEN 1 - 0.5E0 * (worst - <yield>) / (<ultimate> - <yield>) ELSE 1 END)) AS health
    FROM (SELECT d.frame, max(d.damage) AS p, max(k.kv_ratio) AS worst FROM {damage} d JOIN {kv} k ON k.frame = d.frame AND k.cluster_id = d.cluster_id GROUP BY d.frame) x) y""", {"yield": 1.5, "ultimate": 2.0})
EVENT_KINDS = Op("event_kinds", """SELECT run_id, event_id, start_frame, end_frame, CASE WHEN coh < 0.5E0 THEN CASE WHEN dmg > 0.7E0 THEN 'crack_initiation' WHEN strain > 2 THEN 'plastic_deformation' ELSE 'dislocation_nucleation' END WHEN coh > 0.8E0 THEN CASE WHEN strain < 0.5E0 THEN 'elastic_deformation' ELSE 'uniform_deformation' END ELSE 'transition_state' END AS kind FROM (
    SELECT e.run_id, e.event_id, e.start_frame, e.end_frame, avg(c.coherence) AS coh, max(s.strain) AS strain, max(d.damage) AS dmg FROM {events} e JOIN {coherence} c ON c.frame BETWEEN e.start_frame AND e.end_frame JOIN {strain} s ON s.frame = c.frame JOIN {rmsd_damage} d ON d.frame = c.frame AND d.group_id = s.group_id GROUP BY e.run_id, e.event_id, e.start_frame, e.end_frame) x""")
EVENT_BY_SCORE = Op("event_by_score", "SELECT run_id, event_id, CASE WHEN score > 5 THEN 'fracture' WHEN score > 3 AND end_frame - start_frame < 10 THEN 'crack_initiation' WHEN end_frame - start_frame > 100 THEN 'fatigue' WHEN score > 2 THEN 'plastic' ELSE 'elastic' END AS kind, end_frame - start_frame + 1 AS duration FROM {events}")
FAILURE = Op("failure", """SELECT group_id, max_strain, CASE WHEN max_strain * e_gpa > ultimate_gpa THEN 1.0E0 WHEN max_strain * e_gpa > yield_gpa THEN (max_strain * e_gpa - yield_gpa) / (ultimate_gpa - yield_gpa) ELSE 0 END AS p, CASE WHEN max_strain > 1E-9 THEN 1E6 * power(0.3E0 / max_strain, 12) END AS cycles
    FROM (SELECT group_id, max(strain) AS max_strain FROM {strain} WHERE frame > 0 GROUP BY group_id) s CROSS JOIN (SELECT * FROM {materials} WHERE code = '<code>') m""", {"code": "SUJ2"})
TEMPERATURE = Op("temperature", "SELECT frame, cluster_id, greatest(0.0E0, least(<most>, 300 * kv_ratio)) AS kelvin, greatest(0.0E0, least(5.0E0, kv_ratio)) AS kv FROM {kv}", {"most": 2000.0})
STRESS_CURVE = Op("stress_curve", "SELECT frame, group_id, strain, CASE WHEN strain * e_gpa <= yield_gpa THEN strain * e_gpa ELSE least(ultimate_gpa, yield_gpa * power(strain * e_gpa / yield_gpa, <n>)) END AS stress FROM {strain} CROSS JOIN (SELECT * FROM {materials} WHERE code = '<code>') m", {"code": "SUJ2", "n": 0.2})
STRAIN_FIELD = Op("strain_field", "SELECT t.atom_id, least(0.5E0, avg(t.step) / m.lattice) AS strain FROM (SELECT atom_id, frame, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)) AS step FROM {traj} WINDOW w AS (PARTITION BY run_id, atom_id ORDER BY frame)) t CROSS JOIN (SELECT * FROM {materials} WHERE code = '<code>') m GROUP BY t.atom_id, m.lattice", {"code": "SUJ2"})
RMSF = Op("rmsf", """SELECT window_, atom_id, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rmsf, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) / <lattice> AS lindemann FROM (SELECT CAST(floor(frame / <half>) AS INT) AS window_, atom_id, x, y, z FROM {traj} UNION ALL SELECT CAST(floor(frame / <half>) AS INT) - 1, atom_id, x, y, z FROM {traj} WHERE frame >= <half>) w GROUP BY window_, atom_id HAVING count(*) = 2 * <half>""", {"half": 50, "lattice": 2.87})
ENERGY = Op("energy", """SELECT frame, kinetic, kelvin, CASE WHEN kelvin > <melting> THEN 'liquid' WHEN kelvin > 0.8E0 * <melting> THEN 'transition' ELSE 'solid' END AS phase FROM (SELECT frame, 0.5E0 * <mass> * avg(v2) AS kinetic, <mass> * avg(v2) / (3 * <boltzmann>) AS kelvin FROM (SELECT frame, (power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)) * <unit> * <unit> AS v2
    FROM {traj} WINDOW w AS (PARTITION BY run_id, atom_id ORDER BY frame)) s WHERE v2 IS NOT NULL GROUP BY frame) e""", {"mass": 55.845, "boltzmann": 0.00831, "melting": 1811.0, "unit": 0.1}, doc="the length unit is explicit")
NUCLEI = Op("nuclei", "SELECT frame, min(atom_id) AS first_atom, max(atom_id) AS last_atom, count(*) AS n_atoms FROM (SELECT frame, atom_id, sum(brk) OVER (PARTITION BY frame ORDER BY atom_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT frame, atom_id, CASE WHEN atom_id - lag(atom_id, 1, -1000) OVER (PARTITION BY frame ORDER BY atom_id) > <gap> THEN 1 ELSE 0 END AS brk FROM {strain} WHERE disp > <critical>) b) i GROUP BY frame, island", {"gap": 2, "critical": 12.0})
FATIGUE_LIFE = Op("fatigue_life", "SELECT cluster_id, sum(n / nf) AS miner, count(*) AS levels FROM (SELECT cluster_id, round(kv_ratio, 1) AS level, count(*) * 1.0E0 AS n, 1E6 * power(round(kv_ratio, 1) / <ultimate>, -3) AS nf FROM {kv} WHERE kv_ratio > 0.05E0 GROUP BY cluster_id, round(kv_ratio, 1)) c GROUP BY cluster_id", {"ultimate": 2.0}, doc="Miner's sum over stress levels")
CRITICAL_RMSF = Op("critical_rmsf", "SELECT r.window_, count(*) AS n_critical, max(r.rmsf) AS worst FROM {rmsf} r CROSS JOIN (SELECT * FROM {materials} WHERE code = '<code>') m WHERE r.rmsf > m.lindemann * m.lattice GROUP BY r.window_", {"code": "SUJ2"})
RELIABILITY = Op("reliability", """SELECT group_id, mean, sd, CASE WHEN sd > 1E-10 THEN (<limit> - mean) / sd END AS beta, avg_over FROM (SELECT group_id, avg(strain) AS mean, stddev_pop(strain) AS sd, avg(CASE WHEN strain > <limit> THEN 1.0E0 ELSE 0.0E0 END) AS avg_over FROM {strain} GROUP BY group_id) s""", {"limit": 1.0})
VON_MISES = Op("von_mises", "SELECT frame, group_id, <e> * sqrt(0.5E0 * (power(e00 - e11, 2) + power(e11 - e22, 2) + power(e22 - e00, 2)) + 3 * (e01 * e01 + e12 * e12 + e02 * e02)) AS stress FROM {strain}", {"e": 210.0})
WEIBULL = Op("weibull", "SELECT group_id, regr_slope(y, x) AS shape, exp(-regr_intercept(y, x) / regr_slope(y, x)) AS scale FROM (SELECT group_id, ln(strain) AS x, ln(-ln(1 - i * 1.0E0 / (n + 1))) AS y FROM (SELECT group_id, strain, row_number() OVER (PARTITION BY group_id ORDER BY round(strain, 12), frame) AS i, count(*) OVER (PARTITION BY group_id) AS n FROM {strain} WHERE frame > 0) r) l GROUP BY group_id", doc="plotting position i / (n + 1)")
CLUSTER_EVENTS = Op("cluster_events", "SELECT group_id, max_by(frame, strain) AS peak_frame, max(strain) AS peak_strain, greatest(0.0E0, least(1.0E0, (max(strain) * e_gpa - yield_gpa) / (ultimate_gpa - yield_gpa))) AS damage, max(strain) / (lattice * lattice) AS dislocation FROM {strain} CROSS JOIN (SELECT * FROM {materials} WHERE code = '<code>') m GROUP BY group_id, e_gpa, yield_gpa, ultimate_gpa, lattice", {"code": "SUJ2"})
HEALTH = Op("health", "SELECT CASE WHEN worst > 0.8E0 THEN 'failed' WHEN worst > 0.5E0 THEN 'critical' WHEN worst > 0.2E0 THEN 'damaged' ELSE 'healthy' END AS state, 1 - mean AS health, n FROM (SELECT max(damage) AS worst, avg(damage) AS mean, count(*) AS n FROM {events}) e")
REINFORCE = Op("reinforce", "SELECT group_id, damage, place FROM (SELECT group_id, damage, row_number() OVER (ORDER BY round(damage, 9) DESC, group_id) AS place FROM {events} WHERE damage > <least>) p WHERE place <= 5", {"least": 0.1})
