"""How long a material lasts: diverging fluctuations, growing damage nuclei, load cycles, and what they predict.

`traj` is (run_id, frame, atom_id, x, y, z), frames from 0 without gaps. Fluctuations are taken in windows of a tenth of a run, at most
100 frames, that overlap by half; a frame goes to the two or three windows that hold it, so windows are groups and no run is sorted.
A place is critical where its fluctuation is over the material's Lindemann criterion times its lattice constant.

Defined results: a run of fewer than 10 frames has no windows and gives no rows; what never comes is null (no divergence, no coalescence, no
end by fatigue); a load cycle beyond the last window melts nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandflow.operators.network import lagged_pairs
from strandflow.plans.op import Function, Op

SPAN = Op(
    "rmsf_span",
    """
    SELECT run_id, n, n_atoms, width, stride, CAST(floor((n - width) / stride) AS INT) + 1 AS n_windows
    FROM (
        SELECT run_id, n, n_atoms, CAST(least(100, floor(n / 10)) AS INT) AS width, CAST(greatest(1, floor(least(100, floor(n / 10)) / 2)) AS INT) AS stride
        FROM (SELECT run_id, max(frame) + 1 AS n, count(DISTINCT atom_id) AS n_atoms FROM {traj} GROUP BY run_id) r
        WHERE n >= 10) w""",
)
FIELD = Op(
    "rmsf_field",
    """
    SELECT run_id, window_, atom_id, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rmsf
    FROM (
        SELECT t.run_id, t.atom_id, t.x, t.y, t.z, RANGE(CAST(greatest(0, floor((t.frame - s.width) / s.stride) + 1) AS INT), CAST(least(s.n_windows - 1, floor(t.frame / s.stride)) AS INT))RANGE AS window_
        FROM {traj} t JOIN {span} s ON s.run_id = t.run_id
        WHERE t.frame < (s.n_windows - 1) * s.stride + s.width) w
    GROUP BY run_id, window_, atom_id""",
)
_LIMIT = "(SELECT lindemann * lattice AS critical, lindemann, lattice, melting_k FROM {materials} WHERE code = '<code>') m"
_CODE = {"code": "SUJ2"}
CRITICAL = Op(
    "critical_places",
    f"""
    SELECT run_id, atom_id, most, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN n <= <limit> THEN atom_id ELSE most END, atom_id) AS place
    FROM (
        SELECT a.run_id, a.atom_id, a.most, c.n, row_number() OVER (PARTITION BY a.run_id ORDER BY round(a.most, 12) DESC, a.atom_id) AS r
        FROM {{most}} a CROSS JOIN {_LIMIT} JOIN (SELECT run_id, count(*) AS n FROM {{most}} CROSS JOIN {_LIMIT} WHERE most > critical GROUP BY run_id) c ON c.run_id = a.run_id
        WHERE a.most > m.critical) x
    WHERE r <= <limit>""",
    {**_CODE, "limit": 1000},
    doc="atoms that are ever critical, by number; of more than the limit, the highest, from the least of them on",
)
MOST = Op("most_rmsf", "SELECT run_id, atom_id, max(rmsf) AS most FROM {field} GROUP BY run_id, atom_id")
DIVERGENCE = Op(
    "divergence",
    f"""
    WITH e AS (SELECT f.run_id, f.window_, f.rmsf FROM {{field}} f JOIN {{critical}} c ON c.run_id = f.run_id AND c.atom_id = f.atom_id WHERE c.place = 1),
    g AS (
        SELECT e.run_id, e.window_, CASE WHEN p.rmsf IS NULL THEN q.rmsf - e.rmsf WHEN q.rmsf IS NULL THEN e.rmsf - p.rmsf ELSE (q.rmsf - p.rmsf) / 2 END AS g
        FROM e LEFT JOIN e p ON p.run_id = e.run_id AND p.window_ = e.window_ - 1 LEFT JOIN e q ON q.run_id = e.run_id AND q.window_ = e.window_ + 1),
    t AS (SELECT run_id, avg(g) + 2 * stddev_pop(g) AS line, max(g) AS rate FROM g GROUP BY run_id),
    d AS (SELECT g.run_id, min(g.window_) AS first_, max(t.rate) AS rate FROM g JOIN t ON t.run_id = g.run_id WHERE g.g > t.line GROUP BY g.run_id)
    SELECT a.run_id, coalesce(c.n, 0) AS n_critical, a.most, a.most / m.lattice AS ratio, a.mean / m.lattice AS lindemann_mean, d.first_ * s.stride AS divergence_time, coalesce(d.rate, 0) AS divergence_rate
    FROM (SELECT run_id, max(rmsf) AS most, avg(rmsf) AS mean FROM {{field}} GROUP BY run_id) a CROSS JOIN {_LIMIT} JOIN {{span}} s ON s.run_id = a.run_id
    LEFT JOIN (SELECT run_id, count(*) AS n FROM {{critical}} GROUP BY run_id) c ON c.run_id = a.run_id LEFT JOIN d ON d.run_id = a.run_id""",
    _CODE,
    doc="the first critical atom's windows whose gradient is over mean + 2 deviations; neighbours in time meet by equality",
)
NUCLEI = Op(
    "damage_nuclei",
    f"""
    SELECT run_id, window_, min(atom_id) AS first_atom, max(atom_id) AS last_atom, count(*) AS n_atoms
    FROM (
        SELECT run_id, window_, atom_id, sum(brk) OVER (PARTITION BY run_id, window_ ORDER BY atom_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
        FROM (
            SELECT f.run_id, f.window_, f.atom_id, CASE WHEN f.atom_id - lag(f.atom_id) OVER (PARTITION BY f.run_id, f.window_ ORDER BY f.atom_id) <= <gap> THEN 0 ELSE 1 END AS brk
            FROM {{field}} f CROSS JOIN {_LIMIT} WHERE f.rmsf > m.critical) b) i
    GROUP BY run_id, window_, island""",
    {**_CODE, "gap": 10},
    doc="runs of critical atom numbers in a window, gaps up to 10",
)
GROWTH = Op(
    "nuclei_growth",
    """
    SELECT run_id, windows, largest, mean_growth, critical_nm, CASE WHEN mean_growth > 0 AND 0.3E0 * n_atoms > last_ THEN (0.3E0 * n_atoms - last_) / mean_growth END AS coalescence
    FROM (
        SELECT w.run_id, count(*) AS windows, max(w.size) AS largest, max_by(w.size, w.window_) AS last_, CASE WHEN count(*) > 1 THEN (max_by(w.size, w.window_) - min_by(w.size, w.window_)) * 1.0E0 / (count(*) - 1) ELSE 0 END AS mean_growth, max(s.n_atoms) AS n_atoms, max(2 * <surface> / v.stress) AS critical_nm
        FROM (SELECT run_id, window_, max(n_atoms) AS size FROM {nuclei} GROUP BY run_id, window_) w JOIN {span} s ON s.run_id = w.run_id CROSS JOIN (SELECT avg(abs(stress)) AS stress FROM {stress}) v
        GROUP BY w.run_id) g""",
    {"surface": 2.0},
    doc="steps of the largest nucleus between windows that have one (their mean telescopes), the critical radius 2 gamma / sigma in nm, and windows until a nucleus holds 0.3 of all atoms",
)
MELTED = Op(
    "melted",
    f"""
    SELECT run_id, cycle, atom_id
    FROM (
        SELECT c.run_id, c.cycle, f.atom_id, avg(f.rmsf) AS rmsf
        FROM (SELECT run_id, cycle, RANGE(CAST(floor(start_ / 10) AS INT), CAST(floor(end_ / 10) AS INT) - 1)RANGE AS window_ FROM {{cycles}} WHERE loading AND floor(end_ / 10) > floor(start_ / 10)) c
        JOIN {{field}} f ON f.run_id = c.run_id AND f.window_ = c.window_
        GROUP BY c.run_id, c.cycle, f.atom_id) x CROSS JOIN {_LIMIT}
    WHERE x.rmsf > m.critical""",
    _CODE,
    doc="atoms that a loading cycle melts: critical in the mean over windows start / 10 to end / 10",
)
FATIGUE = Op(
    "fatigue",
    """
    SELECT run_id, cycle, loading, melted, new_defects, sum(new_defects) OVER (PARTITION BY run_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS defects
    FROM (
        SELECT c.run_id, c.cycle, c.loading, CASE WHEN c.loading THEN coalesce(m.n, 0) ELSE 0 END AS melted, CASE WHEN c.loading THEN 0 ELSE CAST(floor(0.1E0 * coalesce(b.n, 0)) AS INT) END AS new_defects
        FROM (SELECT run_id, cycle, loading, max(CASE WHEN loading THEN cycle END) OVER (PARTITION BY run_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before_ FROM {cycles}) c
        LEFT JOIN (SELECT run_id, cycle, count(*) AS n FROM {melted} GROUP BY run_id, cycle) m ON m.run_id = c.run_id AND m.cycle = c.cycle
        LEFT JOIN (SELECT run_id, cycle, count(*) AS n FROM {melted} GROUP BY run_id, cycle) b ON b.run_id = c.run_id AND b.cycle = c.before_) x""",
    doc="an unloading cycle leaves a tenth of what the last loading melted as defects, a fixed number and no draw",
)
LIFE = Op(
    "fatigue_left",
    """
    SELECT f.run_id, f.n AS n_cycles, f.defects, f.rate, CASE WHEN f.rate > 0 THEN (0.1E0 * s.n_atoms - f.defects) / f.rate END AS cycles_left
    FROM (
        SELECT run_id, n, max(CASE WHEN k = n THEN defects END) AS defects, CASE WHEN n > 1 THEN (1.5E0 * (max(CASE WHEN k = n THEN defects END) - max(CASE WHEN k = 1 THEN defects END)) - 0.5E0 * (max(CASE WHEN k = n - 1 THEN defects END) - max(CASE WHEN k = 2 THEN defects END))) / n ELSE 0 END AS rate
        FROM (SELECT f.run_id, f.defects, c.n, f.cycle AS k FROM {fatigue} f JOIN (SELECT run_id, max(cycle) AS n FROM {fatigue} GROUP BY run_id) c ON c.run_id = f.run_id) k
        GROUP BY run_id, n) f JOIN {span} s ON s.run_id = f.run_id""",
    doc="cycles until a tenth of all atoms are defects at the mean gradient of the defects so far, which only its ends make",
)
STRESSED = Op("stress_concentration", "SELECT run_id, atom_id, 0.1E0 * count(*) AS concentration FROM {melted} GROUP BY run_id, atom_id")
PHASE = Op(
    "run_phase",
    f"""
    SELECT run_id, spread / lattice AS ratio, CASE WHEN spread / lattice > lindemann THEN 'liquid' WHEN <kelvin> < 0.7E0 * melting_k THEN 'solid' WHEN <kelvin> > 0.9E0 * melting_k THEN 'liquid' ELSE 'transition' END AS phase
    FROM (SELECT run_id, sqrt(avg(v) / 3) AS spread FROM (SELECT run_id, var_pop(x) + var_pop(y) + var_pop(z) AS v FROM {{traj}} GROUP BY run_id, atom_id) a GROUP BY run_id) s CROSS JOIN {_LIMIT}""",
    {**_CODE, "kelvin": 300.0},
)
OUTLOOK = Op(
    "outlook",
    f"""
    SELECT run_id, CASE WHEN cycles_left < 1000 THEN 'fatigue_failure' WHEN phase = 'liquid' THEN 'phase_transition' WHEN ratio > lindemann THEN 'local_melting' WHEN phase = 'transition' THEN 'incipient_melting' ELSE 'unknown' END AS mechanism,
        greatest(CASE WHEN ratio > lindemann THEN least(1.0E0, ratio / (2 * lindemann)) ELSE 0.0E0 END, CASE phase WHEN 'liquid' THEN 0.9E0 WHEN 'transition' THEN 0.6E0 ELSE 0.0E0 END, CASE WHEN cycles_left < 1000 THEN 0.7E0 ELSE 0.0E0 END) AS confidence,
        least(coalesce(by_rmsf, by_nuclei, by_fatigue), coalesce(by_nuclei, by_rmsf, by_fatigue), coalesce(by_fatigue, by_rmsf, by_nuclei)) AS time_to_failure
    FROM (
        SELECT d.run_id, d.ratio, p.phase, l.cycles_left, m.lindemann, CASE WHEN d.divergence_time IS NOT NULL AND d.divergence_rate > 0 AND m.critical > d.most THEN (m.critical - d.most) / d.divergence_rate END AS by_rmsf, g.coalescence AS by_nuclei, 10.0E0 * l.cycles_left AS by_fatigue
        FROM {{divergence}} d CROSS JOIN {_LIMIT} JOIN {{phase}} p ON p.run_id = d.run_id LEFT JOIN {{growth}} g ON g.run_id = d.run_id LEFT JOIN {{life}} l ON l.run_id = d.run_id) x""",
    _CODE,
    doc="the mechanism that holds last of melting, phase and fatigue, the highest of their confidences and the earliest of the times that exist (a cycle is 10 units)",
)
_STRONGEST = Op(
    "strongest_lag",
    "SELECT i, j, strength, lag FROM (SELECT i, j, abs(corr) AS strength, lag, row_number() OVER (PARTITION BY i, j ORDER BY round(abs(corr), 9) DESC, lag) AS r FROM {profile}) b WHERE r = 1 AND strength >= <least>",
    doc="a pair has a row for each lag, so the windows are small",
)


def general_causality(series: DataFrame, pairs: DataFrame, lags: int, least: float, block: int | None = None) -> DataFrame:
    """(i, j, strength, lag) from the lags of a pair's blocks."""
    return _STRONGEST(profile=lagged_pairs(series, pairs, range(1, lags), both=False, block=block, half="floor(count(DISTINCT frame) / 2)"), least=least)


GENERAL_CAUSALITY = Function(
    "general_causality",
    """
    WITH lags AS (SELECT n, RANGE(1, <lags> - 1)RANGE AS lag FROM (SELECT count(DISTINCT frame) AS n FROM {series}) s),
    profile AS (
        SELECT x.run_id AS i, y.run_id AS j, l.lag, CASE WHEN stddev_pop(x.v) > 1E-10 AND stddev_pop(y.v) > 1E-10 THEN abs(covar_pop(x.v, y.v) / (stddev_pop(x.v) * stddev_pop(y.v))) ELSE 0 END AS c
        FROM {series} x CROSS JOIN lags l JOIN {pairs} p ON p.i = x.run_id JOIN {series} y ON y.run_id = p.j AND y.frame = x.frame + l.lag
        WHERE l.lag < floor(l.n / 2)
        GROUP BY x.run_id, y.run_id, l.lag)
    SELECT i, j, strength, lag FROM (SELECT i, j, c AS strength, lag, row_number() OVER (PARTITION BY i, j ORDER BY round(c, 9) DESC, lag) AS r FROM profile) b WHERE r = 1 AND strength >= <least>""",
    {"lags": 100, "least": 0.2},
    run=general_causality,
    doc="the highest absolute correlation of scores over lags from 1 on, for pairs of groups near each other",
)
