"""Boundaries, topological breaks, anomaly scores and events. `series` is (run_id, frame, v) unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators.windows import window_moments
from strandflow.plans.op import Function, Op

_CENTRED = "ROWS BETWEEN <w> PRECEDING AND <w1> FOLLOWING"
_INSIDE = "f.frame >= <w> AND f.frame < n.n - <w>"
_N = "JOIN (SELECT run_id, max(frame) + 1 AS n FROM {series} GROUP BY run_id) n ON n.run_id = f.run_id"


def _centred(name: str, column: str, value: str, windows: str, default: str, **params) -> Op:
    """An operator whose window is [-w, w) and which has a default near the ends."""
    return Op(name, f"""SELECT f.run_id, f.frame, CASE WHEN {_INSIDE} AND {value[0]} THEN {value[1]} ELSE {default} END AS {column} FROM (
        SELECT run_id, frame, own, v, {windows} FROM {{series}} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame {_CENTRED})) f {_N} WHERE own""", {"w": 25, "w1": 24, **params}, halo=("series", "w"))


FRACTAL = _centred("fractal", "fd", ("vr > 1E-10", "1 + ln(vr) / ln(2 * <w>)"), "var_pop(v) OVER w AS vr", "1.0E0")
COUPLING = _centred("coupling_strength", "coupling", ("vr IS NOT NULL", "1 / (1 + vr)"), "var_pop(v) OVER w AS vr", "1.0E0")
ENTROPY = _centred("entropy", "entropy", ("sv > 1E-10", "ln(sv) - sl / sv"), "sum(CASE WHEN v > 1E-12 THEN v END) OVER w AS sv, sum(CASE WHEN v > 1E-12 THEN v * ln(v) END) OVER w AS sl", "0.0E0")
BOUNDARY_SCORE = Op("boundary_score", """SELECT run_id, frame, (2 * abs(gf) + 1.5E0 * (1 - coherence) + (1 - coupling) + abs(ge)) / 5.5E0 AS score FROM (
    SELECT a.run_id, a.frame, a.g AS gf, coalesce(b.coherence, 1) AS coherence, coalesce(c.coupling, 1) AS coupling, d.g AS ge FROM {fractal_gradient} a JOIN {entropy_gradient} d ON d.run_id = a.run_id AND d.frame = a.frame
    JOIN {coherence} b ON b.run_id = a.run_id AND b.frame = a.frame JOIN {coupling} c ON c.run_id = a.run_id AND c.frame = a.frame) x""")
PEAK_CANDIDATES = Op("peak_candidates", """SELECT run_id, frame, v, m + sd AS high, m + 0.5E0 * sd AS low, n FROM (SELECT f.*, c.m, c.sd, c.n FROM (
    SELECT run_id, frame, own, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM {series} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame)) f
    JOIN (SELECT run_id, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM {series} WHERE own GROUP BY run_id) c ON c.run_id = f.run_id WHERE own AND v > p AND v > q) x WHERE v >= m + 0.5E0 * sd""", halo=("series", "1"))
TENSION_JUMPS = Op("tension_jumps", """SELECT run_id, frame, CASE WHEN p IS NOT NULL AND q IS NOT NULL AND m > 1E-10 AND greatest(abs(v - p), abs(q - v)) > <threshold> * m THEN greatest(abs(v - p), abs(q - v)) / m ELSE 0 END AS jump FROM (
    SELECT run_id, frame, own, v, lag(v) OVER (PARTITION BY run_id, blk ORDER BY frame) AS p, lead(v) OVER (PARTITION BY run_id, blk ORDER BY frame) AS q,
      avg(abs(v)) OVER (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN <w> PRECEDING AND <w> FOLLOWING) AS m FROM {series}) f WHERE own""", {"w": 25, "threshold": 2.0}, halo=("series", "w"))
PHASE_BREAKS = Op("phase_breaks", """SELECT run_id, frame, CASE WHEN abs(v - p) > <threshold> THEN abs(v - p) ELSE 0 END AS brk FROM (SELECT run_id, frame, own, v, lag(v) OVER (PARTITION BY run_id, blk ORDER BY frame) AS p FROM {series}) f
    WHERE own""", {"threshold": 0.1}, halo=("series", "1"))


def centred_z(series: DataFrame, w: int, w1: int, block: int | None = None) -> DataFrame:
    n = series.groupBy("run_id").agg((F.max("frame") + 1).alias("n"))
    z = f"CASE WHEN frame >= {w} AND frame < n - {w} AND sqrt(var_v) > 1E-10 THEN abs(v - m_v) / sqrt(var_v) ELSE 0 END AS z"
    return window_moments(series, ("run_id",), ("v",), w, w1, block).join(n, "run_id").selectExpr("run_id", "frame", z)


CENTRED_Z = Function("centred_z", """SELECT f.run_id, f.frame, CASE WHEN f.frame >= <w> AND f.frame < n.n - <w> AND sd > 1E-10 THEN abs(v - m) / sd ELSE 0 END AS z FROM (
    SELECT run_id, frame, own, v, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM {series} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN <w> PRECEDING AND <w1> FOLLOWING)) f
    JOIN (SELECT run_id, max(frame) + 1 AS n FROM {series} GROUP BY run_id) n ON n.run_id = f.run_id WHERE own""", {"w": 25, "w1": 24}, halo=("series", "w"), run=centred_z)
LEGACY_BREAKS = Op("legacy_breaks", """SELECT a.run_id, a.frame, a.z AS flow, coalesce(b.z, 0) AS acceleration, coalesce(c.jump, 0) AS jump, coalesce(d.brk, 0) AS phase, a.z + 0.8E0 * coalesce(b.z, 0) + 1.2E0 * coalesce(c.jump, 0) + coalesce(d.brk, 0) AS combined
    FROM {flow_z} a LEFT JOIN {acceleration_z} b ON b.run_id = a.run_id AND b.frame = a.frame LEFT JOIN {jumps} c ON c.run_id = a.run_id AND c.frame = a.frame LEFT JOIN {phase} d ON d.run_id = a.run_id AND d.frame = a.frame""")
SEGMENTS = Op("segments", """SELECT run_id, start_frame, end_frame, CASE WHEN rn = 1 THEN 'initial' WHEN end_frame - start_frame < <short> THEN 'elastic' ELSE 'plastic' END AS pattern FROM (
    SELECT run_id, frame AS start_frame, lead(frame) OVER (PARTITION BY run_id ORDER BY frame) AS end_frame, row_number() OVER (PARTITION BY run_id ORDER BY frame) AS rn FROM {boundaries}) s WHERE end_frame IS NOT NULL""", {"short": 100})

FLOW_ANOMALY = Op("flow_anomaly", """SELECT z.run_id, z.frame, greatest(z.z, CASE WHEN abs(g.g) > 3 * s.std THEN abs(g.g) / (s.std + 1E-10) ELSE 0 END) AS anomaly
    FROM {z} z JOIN {gradient} g ON g.run_id = z.run_id AND g.frame = z.frame JOIN {gradient_std} s ON s.run_id = z.run_id AND s.frame = z.frame""")
SIGN_CHANGES = Op("sign_changes", """SELECT run_id, frame, (abs(sign(lf_x) - sign(px)) + abs(sign(lf_y) - sign(py)) + abs(sign(lf_z) - sign(pz))) / 6 AS changes FROM (
    SELECT run_id, frame, own, lf_x, lf_y, lf_z, coalesce(lag(lf_x) OVER w, lf_x) AS px, coalesce(lag(lf_y) OVER w, lf_y) AS py, coalesce(lag(lf_z) OVER w, lf_z) AS pz FROM {flow} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame)) f WHERE own""", halo=("flow", "1"))
SCALE_DEVIATIONS = Op(
    "scale_deviations",
    """
    SELECT s.run_id, s.frame, 1 AS k, abs(s.v - a.v) AS d FROM {series} s JOIN {a} a ON a.run_id = s.run_id AND a.frame = s.frame
    UNION ALL SELECT s.run_id, s.frame, 2, abs(s.v - a.v) FROM {series} s JOIN {b} a ON a.run_id = s.run_id AND a.frame = s.frame
    UNION ALL SELECT s.run_id, s.frame, 3, abs(s.v - a.v) FROM {series} s JOIN {c} a ON a.run_id = s.run_id AND a.frame = s.frame""",
)
MULTISCALE_JUMP = Op(
    "multiscale_jump",
    """
    SELECT u.run_id, u.frame, sum(u.d / (s.sd + 1E-10)) / 3 AS jump
    FROM {deviations} u JOIN (SELECT run_id, k, stddev_pop(d) AS sd FROM {deviations} GROUP BY run_id, k) s ON s.run_id = u.run_id AND s.k = u.k
    GROUP BY u.run_id, u.frame""",
)
LINEAR_DEVIATION = Op("linear_deviation", """SELECT t.run_id, t.frame, abs(t.total - (e.t0 + (e.t1 - e.t0) / greatest(e.n - 1, 1) * (t.frame - e.f0))) AS v FROM {totals} t
    JOIN (SELECT run_id, min_by(total, frame) AS t0, max_by(total, frame) AS t1, min(frame) AS f0, count(*) AS n FROM {totals} GROUP BY run_id) e ON e.run_id = t.run_id""")
CHARGE_BREAK = Op("charge_break", """SELECT p.run_id, p.frame, greatest(p.brk, abs(g.g) / (m.m + 1E-10)) AS brk FROM {phase} p JOIN {deviation_gradient} g ON g.run_id = p.run_id AND g.frame = p.frame
    JOIN (SELECT run_id, max(abs(g)) AS m FROM {deviation_gradient} GROUP BY run_id) m ON m.run_id = p.run_id""")
COHERENCE_BREAK = Op(
    "coherence_break",
    """
    SELECT g.run_id, g.frame, CASE WHEN CASE WHEN g.g < 0 THEN -2 * g.g ELSE g.g END > s.m + 2 * s.sd THEN CASE WHEN g.g < 0 THEN -2 * g.g ELSE g.g END ELSE 0 END AS brk
    FROM {gradient} g
    JOIN (SELECT run_id, avg(CASE WHEN g < 0 THEN -2 * g ELSE g END) AS m, stddev_pop(CASE WHEN g < 0 THEN -2 * g ELSE g END) AS sd FROM {gradient} GROUP BY run_id) s ON s.run_id = g.run_id""",
)
EXTREMA = Op("extrema", """SELECT run_id, frame, CASE WHEN v > hi1 AND v > hi2 THEN 1 WHEN v < lo1 AND v < lo2 THEN 1 ELSE 0 END AS extremum FROM (
    SELECT run_id, frame, own, v, max(v) OVER a AS hi1, max(v) OVER b AS hi2, min(v) OVER a AS lo1, min(v) OVER b AS lo2 FROM {series}
    WINDOW a AS (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN <w> PRECEDING AND 1 PRECEDING), b AS (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND <w> FOLLOWING)) f WHERE own""", {"w": 10}, halo=("series", "w"))
DIVERGENCE_SUM = Op("divergence_sum", "SELECT x.run_id, x.frame, x.g + y.g + z.g AS d FROM {gx} x JOIN {gy} y ON y.run_id = x.run_id AND y.frame = x.frame JOIN {gz} z ON z.run_id = x.run_id AND z.frame = x.frame")
DIVERGENCE = Op("divergence", "SELECT d.run_id, d.frame, CASE WHEN abs(d.d) > 3 * s.sd THEN 1 ELSE 0 END AS anomaly FROM {sum} d JOIN (SELECT run_id, stddev_pop(d) AS sd FROM {sum} GROUP BY run_id) s ON s.run_id = d.run_id")
DECORRELATION = Op("decorrelation", """SELECT f.run_id, f.frame, CASE WHEN f.frame >= <w> AND f.frame < n.n - <w> AND sa > 1E-10 AND sb > 1E-10 THEN 1 - abs(c / (sa * sb)) ELSE 0 END AS d FROM (
    SELECT run_id, frame, own, stddev_pop(a) OVER w AS sa, stddev_pop(b) OVER w AS sb, covar_pop(a, b) OVER w AS c FROM {pair} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN <w> PRECEDING AND <w1> FOLLOWING)) f
    JOIN (SELECT run_id, max(frame) + 1 AS n FROM {pair} GROUP BY run_id) n ON n.run_id = f.run_id WHERE own""", {"w": 25, "w1": 24}, halo=("pair", "w"))
SINGULARITIES = Op("singularities", """SELECT e.run_id, e.frame, (e.extremum + coalesce(d.anomaly, 0) + coalesce(c.d, 0)) / 3.0E0 AS s FROM {extrema} e
    LEFT JOIN {divergence} d ON d.run_id = e.run_id AND d.frame = e.frame LEFT JOIN {decorrelation} c ON c.run_id = e.run_id AND c.frame = e.frame""")
COMBINED_BREAKS = Op("combined_breaks", """SELECT a.run_id, a.frame, (a.anomaly + 0.8E0 * coalesce(b.z, 0) + 0.6E0 * coalesce(c.jump, 0) + 1.2E0 * coalesce(d.brk, 0) + 0.9E0 * coalesce(e.brk, 0) + 1.1E0 * coalesce(f.s, 0)) / 5.6E0 AS score
    FROM {flow} a LEFT JOIN {acceleration} b ON b.run_id = a.run_id AND b.frame = a.frame LEFT JOIN {jump} c ON c.run_id = a.run_id AND c.frame = a.frame LEFT JOIN {charge} d ON d.run_id = a.run_id AND d.frame = a.frame
    LEFT JOIN {coherence} e ON e.run_id = a.run_id AND e.frame = a.frame LEFT JOIN {singular} f ON f.run_id = a.run_id AND f.frame = a.frame""")

GLOBAL_SCORE = Op("global_score", """SELECT a.run_id, a.frame, 0.3E0 * coalesce(a.anomaly, 0) + 0.2E0 * coalesce(b.z, 0) + 0.2E0 * coalesce(c.jump, 0) + 0.3E0 * coalesce(d.brk, 0) AS score FROM {flow} a LEFT JOIN {acceleration} b ON b.run_id = a.run_id AND b.frame = a.frame
    LEFT JOIN {jump} c ON c.run_id = a.run_id AND c.frame = a.frame LEFT JOIN {charge} d ON d.run_id = a.run_id AND d.frame = a.frame""")
LOCAL_SCORE = Op("local_score", """SELECT s.run_id, s.frame, coalesce(b.bump, 0) + s.score AS score FROM {boundary_score} s LEFT JOIN (
    SELECT s.run_id, s.frame, sum(exp(-power(s.frame - b.frame, 2) / (2.0E0 * <sigma> * <sigma>))) AS bump FROM {boundary_score} s JOIN {boundaries} b ON b.run_id = s.run_id AND s.frame >= b.frame - <reach> AND s.frame < b.frame + <reach>
    GROUP BY s.run_id, s.frame) b ON b.run_id = s.run_id AND b.frame = s.frame""", {"sigma": 20.0, "reach": 50},
    spark="""SELECT s.run_id, s.frame, coalesce(b.bump, 0) + s.score AS score FROM {boundary_score} s LEFT JOIN (
    SELECT run_id, near AS frame, sum(exp(-power(near - frame, 2) / (2.0E0 * <sigma> * <sigma>))) AS bump FROM (SELECT run_id, frame, RANGE(frame - <reach>, frame + <reach> - 1)RANGE AS near FROM {boundaries}) x
    GROUP BY run_id, near) b ON b.run_id = s.run_id AND b.frame = s.frame""", doc="a boundary has a row for each frame that it reaches, so no frame meets all boundaries of its run")
DRIFT = Op("drift", """SELECT s.run_id, s.frame, abs(s.v - r.ref) / (r.ref + 1E-10) AS score FROM {series} s JOIN (SELECT s.run_id, avg(s.v) AS ref FROM {series} s JOIN (SELECT run_id, least(1000, floor(count(*) / 4)) AS k FROM {series} GROUP BY run_id) c ON c.run_id = s.run_id WHERE s.frame < c.k GROUP BY s.run_id) r ON r.run_id = s.run_id""")
GYRATION_CHANGE = Op("gyration_change", "SELECT run_id, frame, CASE WHEN g < 0 THEN -2 * g ELSE g END AS score FROM {gradient}")
EXTENDED_SCORE = Op("extended_score", """SELECT a.run_id, a.frame, 0.2E0 * a.score + 0.3E0 * coalesce(b.score, 0) + 0.3E0 * coalesce(c.std, 0) AS score FROM {drift} a LEFT JOIN {gyration} b ON b.run_id = a.run_id AND b.frame = a.frame LEFT JOIN {phase} c ON c.run_id = a.run_id AND c.frame = a.frame""")
FINAL_SCORE = Op("final_score", """SELECT g.run_id, g.frame, g.score AS global_, l.score AS local_, <gw> * g.score + <lw> * l.score AS combined, 0.4E0 * g.score + 0.3E0 * l.score + 0.3E0 * coalesce(e.score, 0) AS final
    FROM {global_score} g JOIN {local_score} l ON l.run_id = g.run_id AND l.frame = g.frame LEFT JOIN {extended} e ON e.run_id = g.run_id AND e.frame = g.frame""", {"gw": 0.5, "lw": 0.5})
CRITICAL_EVENTS = Op("critical_events", """SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY min(frame)) - 1 AS INT) AS event_id, min(frame) AS start_frame, max(frame) AS end_frame, max(v) AS score FROM (
    SELECT s.run_id, s.frame, s.v, s.frame - row_number() OVER (PARTITION BY s.run_id ORDER BY s.frame) AS island FROM {series} s
    JOIN (SELECT run_id, avg(v) + <sigmas> * stddev_pop(v) AS t FROM {series} GROUP BY run_id) c ON c.run_id = s.run_id WHERE s.v > c.t) x GROUP BY run_id, island""", {"sigmas": 2.0}, doc="gaps and islands over frames above mean + sigmas x std")
RANKED_EVENTS = Op(
    "ranked_events",
    """
    SELECT run_id, event_id, start_frame, end_frame, score, rank, 'event_' || CAST(rank AS VARCHAR(10)) AS name
    FROM (
        SELECT t.*, row_number() OVER (ORDER BY score DESC, run_id, event_id) AS rank
        FROM (
            SELECT e.run_id, e.event_id, e.start_frame, e.end_frame, max(s.v) AS score
            FROM (SELECT run_id, event_id, start_frame, end_frame, RANGE(start_frame, end_frame)RANGE AS frame FROM {events}) e JOIN {series} s ON s.run_id = e.run_id AND s.frame = e.frame
            GROUP BY e.run_id, e.event_id, e.start_frame, e.end_frame ORDER BY score DESC, run_id, event_id LIMIT <top>) t) r""",
    {"top": 50},
    doc="the window numbers the top alone",
)
DAMAGE_BLEND = Op("damage_blend", "SELECT s.run_id, s.frame, (1 - <weight>) * s.v + <weight> * coalesce(d.damage, 0) AS v FROM {series} s LEFT JOIN {damage} d ON d.frame = s.frame", {"weight": 0.25})
DEVIATION = Op("deviation", "SELECT s.run_id, s.frame, abs(s.v - m.med) AS v FROM {series} s JOIN {median} m ON m.run_id = s.run_id")
ROBUST_SCORE = Op("robust_score", "SELECT s.run_id, s.frame, CASE WHEN d.med > 1E-10 THEN 0.6745E0 * (s.v - m.med) / d.med ELSE 0 END AS z FROM {series} s JOIN {median} m ON m.run_id = s.run_id JOIN {spread} d ON d.run_id = s.run_id", doc="by a run's median and the median of its deviations from it")
GROUP_ANOMALY = Op("group_anomaly", "SELECT f.run_id, f.frame, (f.z + r.z) / 2 AS v FROM {flow_z} f JOIN {tension_z} r ON r.run_id = f.run_id AND r.frame = f.frame")
CLUSTER_ANOMALY = Op("cluster_anomaly", """SELECT group_id, frame, a FROM (SELECT c.group_id, c.frame, (CASE WHEN sd > 1E-10 THEN abs(c.strain - m) / sd ELSE 0 END + abs(c.coord - <ideal>) / <ideal>) / 2 AS a, max((CASE WHEN sd > 1E-10 THEN abs(c.strain - m) / sd ELSE 0 END + abs(c.coord - <ideal>) / <ideal>) / 2) OVER (PARTITION BY c.group_id) AS most
    FROM {cluster} c JOIN (SELECT group_id, avg(strain) AS m, stddev_pop(strain) AS sd FROM {cluster} GROUP BY group_id) s ON s.group_id = c.group_id) x WHERE most > <sensitivity>""", {"ideal": 8.0, "sensitivity": 1.5})
