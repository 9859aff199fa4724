"""What single events show: importance of groups, defect traces of atoms with their stress, and atomic evidence. All keyed by event."""

from __future__ import annotations

from strandflow.plans.op import Op

EVENT_WINDOWS = Op(
    "event_windows",
    """
    SELECT event_id, g, CAST(greatest(<least>, least(<most>, 100
        * CASE WHEN events > 0.1E0 THEN 0.7E0 WHEN events < 0.02E0 THEN 2.0E0 ELSE 1.0E0 END
        * CASE WHEN vol > 2 THEN 0.8E0 WHEN vol < 0.5E0 THEN 1.3E0 ELSE 1.0E0 END)) AS INT) AS w
    FROM (
        SELECT event_id, g, avg(CASE WHEN v > 1 THEN 1.0E0 ELSE 0.0E0 END) AS events, CASE WHEN avg(v) > 1E-10 THEN stddev_pop(v) / avg(v) ELSE 0 END AS vol
        FROM {inside} GROUP BY event_id, g) s""",
    {"least": 30, "most": 300},
    doc="the window that fits a group's scores inside an event",
)
IMPORTANCE = Op(
    "event_importance",
    """
    SELECT g, score, row_number() OVER (ORDER BY round(score, 9) DESC, g) AS place
    FROM (SELECT p.g, sum(p.peak * (1 + 0.1E0 * (100.0E0 / w.w))) AS score FROM {peaks} p JOIN {windows} w ON w.event_id = p.event_id AND w.g = p.g GROUP BY p.g ORDER BY round(sum(p.peak * (1 + 0.1E0 * (100.0E0 / w.w))), 9) DESC, p.g LIMIT <top>) s""",
    {"top": 10},
    doc="peaks of all events, those in short windows more; the window numbers the top alone",
)
TRACES = Op(
    "defect_traces",
    """
    WITH moved AS (
        SELECT e.run_id, e.event_id, e.kind, t.atom_id, m.group_id, sqrt(power(t.x - p.x, 2) + power(t.y - p.y, 2) + power(t.z - p.z, 2)) AS d, 0 AS pool
        FROM {events} e JOIN {traj} t ON t.run_id = e.run_id AND t.frame = e.start_frame JOIN {traj} p ON p.run_id = e.run_id AND p.atom_id = t.atom_id AND p.frame = e.start_frame - 1
        LEFT JOIN {member} m ON m.atom_id = t.atom_id WHERE e.start_frame > 0),
    centred AS (
        SELECT e.run_id, e.event_id, e.kind, m.group_id, avg(t.x) AS x, avg(t.y) AS y, avg(t.z) AS z
        FROM {events} e JOIN {traj} t ON t.run_id = e.run_id AND t.frame = 0 JOIN {member} m ON m.atom_id = t.atom_id WHERE e.start_frame = 0 GROUP BY e.run_id, e.event_id, e.kind, m.group_id),
    away AS (
        SELECT c.run_id, c.event_id, c.kind, t.atom_id, c.group_id, sqrt(power(t.x - c.x, 2) + power(t.y - c.y, 2) + power(t.z - c.z, 2)) AS d, c.group_id AS pool
        FROM centred c JOIN {member} m ON m.group_id = c.group_id JOIN {traj} t ON t.run_id = c.run_id AND t.frame = 0 AND t.atom_id = m.atom_id),
    every AS (SELECT * FROM moved UNION ALL SELECT * FROM away),
    level AS (SELECT run_id, event_id, pool, avg(d) AS mean, stddev_pop(d) AS sd FROM every GROUP BY run_id, event_id, pool)
    SELECT z.run_id, z.event_id, z.group_id, z.atom_id, z.z, least(z.z / 4, 1.0E0) AS confidence, coalesce(s.strain, 0) * <modulus> AS stress,
        CASE WHEN z.kind = 'dislocation' THEN CASE WHEN z.z > 4 THEN 'dislocation_core' ELSE 'dislocation_cloud' END
            WHEN z.kind = 'crack' THEN CASE WHEN s.strain > 0.02E0 THEN 'crack_tip' ELSE 'process_zone' END
            ELSE CASE WHEN z.z > 3 THEN 'point_defect' ELSE 'elastic_distortion' END END AS signature
    FROM (SELECT e.run_id, e.event_id, e.kind, e.group_id, e.atom_id, (e.d - l.mean) / (l.sd + 1E-10) AS z FROM every e JOIN level l ON l.run_id = e.run_id AND l.event_id = e.event_id AND l.pool = e.pool WHERE e.group_id IS NOT NULL) z
    LEFT JOIN {field} s ON s.atom_id = z.atom_id WHERE z.z > <sigmas>""",
    {"sigmas": 2.5, "modulus": 210.0},
    doc="atoms that move far as an event starts, against all atoms; at frame 0 those far from their group's centre, against the group",
)
ZONES = Op(
    "plastic_zones",
    """
    SELECT t.run_id, t.event_id, t.group_id, count(*) AS n_atoms, max(t.stress) AS most_stress, CASE WHEN max(t.stress) > 0 THEN power(<k_ic> / max(t.stress), 2) / (2 * pi()) END AS zone,
        max(v.stress) * sqrt(pi() * max(v.strain) * 10) AS k_ic
    FROM {traces} t LEFT JOIN (
        SELECT e.run_id, e.event_id, s.group_id, max(s.stress) AS stress, max(s.strain) AS strain
        FROM (SELECT run_id, event_id, RANGE(start_frame, end_frame)RANGE AS frame FROM {events}) e JOIN {stress} s ON s.run_id = e.run_id AND s.frame = e.frame GROUP BY e.run_id, e.event_id, s.group_id) v
        ON v.run_id = t.run_id AND v.event_id = t.event_id AND v.group_id = t.group_id
    GROUP BY t.run_id, t.event_id, t.group_id""",
    {"k_ic": 30.0},
    doc="size of the plastic zone from the highest stress, and the toughness that the event's own stress and strain speak for (a crack of 10 lengths)",
)
_MOVE = "SELECT e.run_id, e.event_id, f.frame, t.atom_id, t.x - p.x AS x, t.y - p.y AS y, t.z - p.z AS z FROM {events} e JOIN (SELECT run_id AS r, event_id AS ev, RANGE(greatest(start_frame, 1), least(start_frame + 9, end_frame))RANGE AS frame FROM {events} WHERE end_frame > start_frame + 1) f ON f.r = e.run_id AND f.ev = e.event_id JOIN {traj} t ON t.run_id = e.run_id AND t.frame = f.frame JOIN {traj} p ON p.run_id = e.run_id AND p.frame = f.frame - 1 AND p.atom_id = t.atom_id"
EVIDENCE = Op(
    "atomic_evidence",
    f"""
    WITH speed AS (
        SELECT e.run_id, e.event_id, max(sqrt(power(t.x - p.x, 2) + power(t.y - p.y, 2) + power(t.z - p.z, 2))) / <dt> AS velocity,
            max(sqrt(power(t.x - 2 * p.x + q.x, 2) + power(t.y - 2 * p.y + q.y, 2) + power(t.z - 2 * p.z + q.z, 2))) / (<dt> * <dt>) AS acceleration
        FROM {{events}} e JOIN {{traj}} t ON t.run_id = e.run_id AND t.frame = e.start_frame JOIN {{traj}} p ON p.run_id = e.run_id AND p.frame = e.start_frame - 1 AND p.atom_id = t.atom_id
        LEFT JOIN {{traj}} q ON q.run_id = e.run_id AND q.frame = e.start_frame - 2 AND q.atom_id = t.atom_id GROUP BY e.run_id, e.event_id),
    move AS ({_MOVE}),
    flat AS (SELECT run_id, event_id, frame, atom_id, 0 AS axis, x AS v FROM move UNION ALL SELECT run_id, event_id, frame, atom_id, 1, y FROM move UNION ALL SELECT run_id, event_id, frame, atom_id, 2, z FROM move),
    alike AS (
        SELECT run_id, event_id, max(abs(c)) AS correlation FROM (
            SELECT a.run_id, a.event_id, CASE WHEN stddev_pop(a.v) > 1E-10 AND stddev_pop(b.v) > 1E-10 THEN covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END AS c
            FROM flat a JOIN flat b ON b.run_id = a.run_id AND b.event_id = a.event_id AND b.atom_id = a.atom_id AND b.axis = a.axis AND b.frame > a.frame GROUP BY a.run_id, a.event_id, a.frame, b.frame) k GROUP BY run_id, event_id),
    bond AS (
        SELECT e.run_id, e.event_id, sum(CASE WHEN sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) NOT BETWEEN <short> AND <long> THEN 1 ELSE 0 END) AS anomalies
        FROM {{events}} e JOIN {{traj}} a ON a.run_id = e.run_id AND a.frame = e.start_frame JOIN {{traj}} b ON b.run_id = e.run_id AND b.frame = e.start_frame AND b.atom_id = a.atom_id + 1
        WHERE a.atom_id < <bonds> GROUP BY e.run_id, e.event_id)
    SELECT e.run_id, e.event_id, coalesce(s.velocity, 0) AS velocity, coalesce(s.acceleration, 0) AS acceleration, coalesce(a.correlation, 0) AS correlation, coalesce(b.anomalies, 0) AS bond_anomalies
    FROM {{events}} e LEFT JOIN speed s ON s.run_id = e.run_id AND s.event_id = e.event_id LEFT JOIN alike a ON a.run_id = e.run_id AND a.event_id = e.event_id LEFT JOIN bond b ON b.run_id = e.run_id AND b.event_id = e.event_id""",
    {"dt": 100.0, "short": 0.8, "long": 2.0, "bonds": 100},
    doc="speed and acceleration as an event starts, the most alike displacements of its first ten frames, and odd ones of the first 100 bonds (atoms in a row)",
)
