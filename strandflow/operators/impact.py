"""Atom-level impact of events and their assessment by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandflow.plans.op import Function, Op, halo_blocks, spark_sql

ATOM_Z = Op("atom_z", """SELECT frame, atom_id, step, CASE WHEN stddev_pop(step) OVER (PARTITION BY frame) > 1E-10 THEN (step - avg(step) OVER (PARTITION BY frame)) / stddev_pop(step) OVER (PARTITION BY frame) ELSE 0 END AS z FROM (SELECT frame, atom_id, own,
    sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)) AS step FROM {traj} WINDOW w AS (PARTITION BY run_id, blk, atom_id ORDER BY frame)) s WHERE own AND step IS NOT NULL""", halo=("traj", "1"))
ORIGINS = Op("origins", "SELECT z.frame, m.group_id, z.atom_id, z.z, CASE WHEN z.z > 5 THEN 'tier1' WHEN z.z > 4 THEN 'tier2' WHEN z.z > 3.5E0 THEN 'tier3' ELSE 'tier4' END AS signature FROM {z} z JOIN {member} m ON m.atom_id = z.atom_id WHERE z.z > <sigmas>", {"sigmas": 2.5})
WAVES = Op("waves", "SELECT o.frame AS origin_frame, o.atom_id AS origin, w.frame, w.atom_id, w.z FROM {origins} o JOIN {z} w ON w.frame BETWEEN o.frame + 1 AND o.frame + 2 AND w.z > <sigmas> LEFT JOIN {origins} p ON p.frame = o.frame AND p.atom_id = w.atom_id WHERE p.atom_id IS NULL", {"sigmas": 2.0})
ATOM_LINKS = Op("atom_links", "SELECT a.frame, a.atom_id AS from_id, b.atom_id AS to_id, sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2)) AS distance, sqrt(a.z * b.z) AS strength FROM {origins} a JOIN {origins} b ON b.frame = a.frame AND a.atom_id < b.atom_id JOIN {traj} p ON p.frame = a.frame AND p.atom_id = a.atom_id JOIN {traj} q ON q.frame = b.frame AND q.atom_id = b.atom_id WHERE power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2) < <reach> * <reach>", {"reach": 30.0})
ATOM_LAG_LINKS = Op("atom_lag_links", "SELECT x.atom_id AS from_id, y.atom_id AS to_id, CASE WHEN stddev_pop(x.step) > 1E-10 AND stddev_pop(y.step) > 1E-10 THEN covar_pop(x.step, y.step) / (stddev_pop(x.step) * stddev_pop(y.step)) ELSE 0 END AS corr FROM {z} x JOIN {z} y ON y.frame = x.frame + <lag> AND y.atom_id <> x.atom_id GROUP BY x.atom_id, y.atom_id", {"lag": 1})
ATOM_PATTERN = Op("atom_pattern", "SELECT frame, CASE WHEN count(*) > 10 THEN 'collective' WHEN count(*) > 2 THEN 'clustered' ELSE 'isolated' END AS pattern, count(*) AS n FROM {origins} GROUP BY frame")
ATOM_DEGREES = Op("atom_degrees", "SELECT o.frame, o.atom_id, o.z, count(l.from_id) AS degree, count(l.from_id) > 1 AS hub FROM {origins} o LEFT JOIN {links} l ON l.frame = o.frame AND (l.from_id = o.atom_id OR l.to_id = o.atom_id) GROUP BY o.frame, o.atom_id, o.z")
TARGETS = Op("targets", "SELECT atom_id, priority, score, row_number() OVER (ORDER BY priority, round(score, 9) DESC, atom_id) AS place FROM (SELECT atom_id, min(CASE WHEN hub THEN 1 WHEN z > 3 THEN 2 ELSE 3 END) AS priority, max(z) AS score FROM {degrees} GROUP BY atom_id ORDER BY priority, round(score, 9) DESC, atom_id LIMIT 7) t")
DEFECT_EVENTS = Op("defect_events", "SELECT frame, atom_id, CASE WHEN z > 4 THEN 'vacancy' WHEN z > 3 THEN 'interstitial' ELSE 'displacement' END AS kind FROM {z} WHERE z > <sigmas>", {"sigmas": 2.5})
PLASTIC_ZONE = Op("plastic_zone", "SELECT o.frame, sqrt(max(power(t.x - c.x, 2) + power(t.y - c.y, 2) + power(t.z - c.z, 2))) AS radius, count(*) AS n FROM {origins} o JOIN {traj} t ON t.frame = o.frame AND t.atom_id = o.atom_id JOIN {centre} c ON c.frame = o.frame GROUP BY o.frame")
OWNERS = Op("owners", "SELECT a.atom_id, coalesce(min(m.group_id), -1) AS group_id FROM {atoms} a LEFT JOIN {member} m ON m.atom_id = a.atom_id AND m.group_id > 0 GROUP BY a.atom_id")
DISPATCH = Op("dispatch", "SELECT run_id, event_id, CASE WHEN end_frame = start_frame THEN 'instantaneous' ELSE 'temporal' END AS form FROM {events}")
DEFECT_CLASSES = Op("defect_classes", "SELECT p.atom_id, p.path_length, CASE WHEN p.path_length > 1.1E0 * a.m THEN 'mobile' WHEN p.path_length > 0.95E0 * a.m THEN 'normal' ELSE 'pinned' END AS class FROM (SELECT atom_id, sum(step) AS path_length FROM {z} GROUP BY atom_id) p CROSS JOIN (SELECT sum(step) / count(DISTINCT atom_id) AS m FROM {z}) a")

PATTERNS = Op("patterns", "SELECT e.run_id, e.event_id, e.start_frame, e.end_frame, CASE WHEN n.n > 0 THEN 'cascade' WHEN e.end_frame - e.start_frame + 1 <= 1 THEN 'instantaneous' ELSE 'transition' END AS pattern, n.n AS n_bonds FROM {events} e CROSS JOIN (SELECT count(*) AS n FROM {links} WHERE asynchronous AND strength > <least>) n", {"least": 0.12})


def event_anomaly(patterns: DataFrame, flow: DataFrame, tension: DataFrame, synchrony: DataFrame, block: int | None = None) -> DataFrame:
    """The statement over the flow in blocks: a run's frames are not sorted by one task."""
    text = EVENT_ANOMALY.sql.replace("(SELECT run_id, frame, lf_mag, lag(lf_mag, 1, lf_mag) OVER (PARTITION BY run_id ORDER BY frame) AS prev FROM {flow})", "(SELECT * FROM (SELECT run_id, frame, own, lf_mag, lag(lf_mag, 1, lf_mag) OVER (PARTITION BY run_id, blk ORDER BY frame) AS prev FROM {held}) h WHERE own)")
    return flow.sparkSession.sql(text, patterns=patterns, flow=flow, held=halo_blocks(flow, 1, block=block), tension=tension, synchrony=synchrony)


def evidence(events: DataFrame, z: DataFrame, block: int | None = None) -> DataFrame:
    """A row for each frame of an event, so that steps meet events by equality; steps in blocks."""
    text = """SELECT e.event_id, max(z.step) AS max_velocity, max(abs(z.step - z.prev)) AS max_acceleration FROM (SELECT event_id, RANGE(start_frame, end_frame)RANGE AS frame FROM {events}) e
        JOIN (SELECT frame, own, step, lag(step, 1, step) OVER (PARTITION BY atom_id, blk ORDER BY frame) AS prev FROM {z}) z ON z.frame = e.frame WHERE z.own GROUP BY e.event_id"""
    return z.sparkSession.sql(spark_sql(text), events=events, z=halo_blocks(z, 1, block=block))


EVENT_ANOMALY = Function("event_anomaly", "SELECT p.run_id, p.event_id, p.pattern, p.n_bonds, p.end_frame - p.start_frame + 1 AS duration, abs(f.lf_mag - f.prev) AS jump, CASE WHEN s.sd > 1E-10 THEN abs(f.lf_mag - s.m) / s.sd ELSE 0 END AS z, t.rho_t, y.sigma_s FROM {patterns} p JOIN (SELECT run_id, frame, lf_mag, lag(lf_mag, 1, lf_mag) OVER (PARTITION BY run_id ORDER BY frame) AS prev FROM {flow}) f ON f.run_id = p.run_id AND f.frame = p.start_frame JOIN (SELECT run_id, avg(lf_mag) AS m, stddev_pop(lf_mag) AS sd FROM {flow} GROUP BY run_id) s ON s.run_id = p.run_id JOIN {tension} t ON t.run_id = p.run_id AND t.frame = p.start_frame JOIN {synchrony} y ON y.run_id = p.run_id AND y.frame = p.start_frame", run=event_anomaly)
EVIDENCE = Function("evidence", "SELECT e.event_id, max(z.step) AS max_velocity, max(abs(z.step - z.prev)) AS max_acceleration FROM {events} e JOIN (SELECT frame, atom_id, step, lag(step, 1, step) OVER (PARTITION BY atom_id ORDER BY frame) AS prev FROM {z}) z ON z.frame BETWEEN e.start_frame AND e.end_frame GROUP BY e.event_id", run=evidence)
AXES = Op("axes", """SELECT run_id, event_id, pattern, CASE WHEN (CASE WHEN jump > 0.1E0 THEN 1 ELSE 0 END + CASE WHEN z > 3 THEN 1 ELSE 0 END) = 0 THEN 0.0E0 ELSE (CASE WHEN jump > 0.1E0 THEN least(jump / 0.5E0, 1.0E0) ELSE 0 END + CASE WHEN z > 3 THEN least(z / 5, 1.0E0) ELSE 0 END) / (CASE WHEN jump > 0.1E0 THEN 1 ELSE 0 END + CASE WHEN z > 3 THEN 1 ELSE 0 END) END AS spatial,
    CASE WHEN (CASE WHEN sigma_s > 0.7E0 THEN 1 ELSE 0 END + CASE WHEN n_bonds >= 1 THEN 1 ELSE 0 END) = 0 THEN 0.0E0 ELSE (CASE WHEN sigma_s > 0.7E0 THEN (sigma_s - 0.5E0) / 0.5E0 ELSE 0 END + CASE WHEN n_bonds >= 1 THEN least(n_bonds / 10.0E0, 1.0E0) ELSE 0 END) / (CASE WHEN sigma_s > 0.7E0 THEN 1 ELSE 0 END + CASE WHEN n_bonds >= 1 THEN 1 ELSE 0 END) END AS sync,
    CASE WHEN duration <= 1 THEN 1.0E0 WHEN sigma_s > 0.7E0 AND duration * <dt> > 300 THEN least(duration * <dt> / 1000.0E0, 1.0E0) ELSE 0.0E0 END AS temporal FROM {anomaly}""", {"dt": 100.0})
SIGNATURES = Op("signatures", """SELECT run_id, event_id, pattern, spatial, sync, temporal, least(1.0E0, CASE pattern WHEN 'instantaneous' THEN 0.9E0 * (spatial + sync + temporal) / 3 WHEN 'cascade' THEN 0.7E0 * (spatial + sync + temporal) / 3 + 0.3E0 * sync ELSE (spatial + sync + temporal) / 3 END) AS confidence,
    CASE pattern WHEN 'instantaneous' THEN CASE WHEN spatial > 0.3E0 AND sync > 0.3E0 THEN 'phase_transition' WHEN spatial > 0.3E0 THEN 'tunneling' WHEN sync > 0.3E0 THEN 'entanglement' ELSE 'none' END
      WHEN 'transition' THEN CASE WHEN temporal > 0.3E0 AND spatial > 0.3E0 THEN 'tunneling' WHEN sync > 0.3E0 AND temporal > 0.3E0 THEN 'coherence' WHEN spatial > 0.3E0 AND sync > 0.3E0 THEN 'phase_transition' ELSE 'none' END
      ELSE CASE WHEN sync > 0.3E0 THEN 'information_transfer' WHEN spatial > 0.3E0 AND temporal > 0.3E0 THEN 'phase_transition' ELSE 'none' END END AS signature FROM {axes}""")
CASCADE_INFO = Op("cascade_info", "SELECT from_id, to_id, strength, lag, row_number() OVER (ORDER BY round(strength, 9) DESC, from_id, to_id) AS place, 2 + 0.8E0 * max(strength) OVER () AS index_ FROM (SELECT * FROM {links} WHERE asynchronous ORDER BY round(strength, 9) DESC, from_id, to_id LIMIT 5) l")
SUMMARY = Op("summary", "SELECT pattern, signature, count(*) AS n, avg(confidence) AS confidence FROM {signatures} GROUP BY pattern, signature")
IMPORTANCE = Op("importance", "SELECT g, score, place FROM (SELECT run_id AS g, sum(peak * 1.1E0) AS score, row_number() OVER (ORDER BY round(sum(peak * 1.1E0), 9) DESC, run_id) AS place FROM (SELECT s.run_id, e.event_id, max(s.v) AS peak FROM {series} s JOIN {events} e ON s.frame BETWEEN e.start_frame AND e.end_frame GROUP BY s.run_id, e.event_id) p GROUP BY run_id) i WHERE place <= 10")
CDR = Op("cdr", "SELECT group_id, 0.2E0 * rg AS contribution, greatest(0.0E0, least(1.0E0, 0.3E0 * rg + 0.3E0 * density)) AS affinity FROM {stats}")
PARATOPE = Op("paratope", "SELECT atom_id, avg(CASE WHEN coord > <least> THEN 1.0E0 ELSE 0.0E0 END) AS frequency FROM {coordination} GROUP BY atom_id HAVING avg(CASE WHEN coord > <least> THEN 1.0E0 ELSE 0.0E0 END) > 0.5E0", {"least": 4})
REPORT = Op("report", "SELECT run_id, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS most, min(v) AS least_, sum(CASE WHEN v > 2 THEN 1 ELSE 0 END) AS over2, sum(CASE WHEN v > 3 THEN 1 ELSE 0 END) AS over3, count(*) AS n FROM {series} GROUP BY run_id")
FLOW_TABLE = Op("flow_table", "SELECT from_id, to_id, round(strength, 6) AS width, CASE WHEN asynchronous THEN 'dashed' ELSE 'solid' END AS style FROM {links}")
HEATMAP = Op("heatmap", "SELECT run_id, CAST(floor(frame / 25) AS INT) AS bin, avg(v) AS level FROM {series} GROUP BY run_id, CAST(floor(frame / 25) AS INT)")
