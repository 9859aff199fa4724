"""Defect networks of events: atoms by how far they move, links by distance and correlation, and what follows from the links.

`events` is (run_id, event_id, start_frame, end_frame), `atoms` (atom_id) the defect atoms, `member` (group_id, atom_id), `types` (atom_id, atom_type).

Pairs are those within `reach` in the event's first frame, found on a grid of cells of that size: an atom meets the atoms of the
27 cells around it by an equality join, so the pairs grow with the atoms and their density and never with their square. With a
reach over the extent of the points all pairs take part. Per pair the frames are joined once, all lags folded into one aggregate.
"""

from __future__ import annotations

from strandflow.plans.op import Op

EVENT_FRAMES = Op("event_frames", "SELECT run_id, event_id, start_frame, end_frame, RANGE(start_frame, end_frame)RANGE AS frame FROM {events}", doc="a row for each frame of each event, so that series join by equality")
PATHS = Op(
    "defect_paths",
    """
    SELECT f.run_id, f.event_id, t.atom_id, f.frame - f.start_frame AS t, f.end_frame - f.start_frame + 1 AS n, t.x * <unit> AS x, t.y * <unit> AS y, t.z * <unit> AS z
    FROM {frames} f JOIN {traj} t ON t.run_id = f.run_id AND t.frame = f.frame JOIN {atoms} a ON a.atom_id = t.atom_id""",
    {"unit": 1.0},
    doc="positions of the defect atoms inside the events, in lengths of `unit`",
)
TYPES = Op(
    "defect_types",
    """
    SELECT run_id, event_id, atom_id, n, path_length, type, least(CASE type WHEN 'dislocation' THEN 5 WHEN 'plastic' THEN 10 ELSE 20 END, n) AS w
    FROM (
        SELECT run_id, event_id, atom_id, n, path_length, CASE WHEN path_length > n * <fast> THEN 'dislocation' WHEN path_length > n * <slow> THEN 'plastic' ELSE 'elastic' END AS type
        FROM (
            SELECT a.run_id, a.event_id, a.atom_id, a.n, coalesce(sum(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2))), 0) AS path_length
            FROM {paths} a LEFT JOIN {paths} b ON b.run_id = a.run_id AND b.event_id = a.event_id AND b.atom_id = a.atom_id AND b.t = a.t + 1
            GROUP BY a.run_id, a.event_id, a.atom_id, a.n) p) c""",
    {"slow": 0.2, "fast": 0.5},
    doc="type by path length a frame; w is the type's window",
)
_SQUARE = "power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)"
CELL_PAIRS = Op(
    "cell_pairs",
    f"""
    WITH cell AS (
        SELECT run_id, event_id, atom_id, n, x, y, z, CAST(floor(x / <reach>) AS BIGINT) AS cx, CAST(floor(y / <reach>) AS BIGINT) AS cy, CAST(floor(z / <reach>) AS BIGINT) AS cz
        FROM {{paths}} WHERE t = 0),
    around AS (
        SELECT run_id, event_id, atom_id, x, y, z, cx + d.k % 3 - 1 AS nx, cy + CAST(floor(d.k / 3) AS BIGINT) % 3 - 1 AS ny, cz + CAST(floor(d.k / 9) AS BIGINT) - 1 AS nz
        FROM cell CROSS JOIN (SELECT RANGE(0, 26)RANGE AS k) d)
    SELECT a.run_id, a.event_id, b.n, a.atom_id AS i, b.atom_id AS j, sqrt({_SQUARE}) AS distance
    FROM around a JOIN cell b ON b.run_id = a.run_id AND b.event_id = a.event_id AND b.cx = a.nx AND b.cy = a.ny AND b.cz = a.nz
    WHERE a.atom_id < b.atom_id AND {_SQUARE} < <reach> * <reach>""",
    {"reach": 6.0},
    doc="pairs of an event's atoms within reach in its first frame",
)
DENSITY = Op(
    "defect_density",
    """
    SELECT p.run_id, p.event_id, p.atom_id, coalesce(d.n, 0) AS neighbours, coalesce(d.n, 0) / (4.0E0 / 3 * pi() * power(<reach>, 3)) AS density
    FROM (SELECT run_id, event_id, atom_id FROM {paths} WHERE t = 0) p
    LEFT JOIN (SELECT run_id, event_id, a, count(*) AS n FROM (SELECT run_id, event_id, i AS a FROM {pairs} UNION ALL SELECT run_id, event_id, j FROM {pairs}) e GROUP BY run_id, event_id, a) d
        ON d.run_id = p.run_id AND d.event_id = p.event_id AND d.a = p.atom_id""",
    {"reach": 6.0},
    doc="neighbours within reach and their number by volume; pairs of the same reach",
)
PAIR_STATS = Op(
    "defect_pair_stats",
    """
    WITH r AS (SELECT run_id, event_id, atom_id, t, x, y, z, sqrt(x * x + y * y + z * z) AS r FROM {paths}),
    typed AS (
        SELECT p.run_id, p.event_id, p.i, p.j, p.distance, u.type AS ti, v.type AS tj, least(u.w, v.w) AS w
        FROM {pairs} p JOIN {types} u ON u.run_id = p.run_id AND u.event_id = p.event_id AND u.atom_id = p.i
        JOIN {types} v ON v.run_id = p.run_id AND v.event_id = p.event_id AND v.atom_id = p.j WHERE p.n > 1),
    step AS (
        SELECT p.run_id, p.event_id, p.i, p.j, p.distance, p.ti, p.tj, l.lag, CASE WHEN l.lag > 0 OR a.t < p.w THEN a.r END AS a, CASE WHEN l.lag > 0 OR a.t < p.w THEN b.r END AS b,
            CASE WHEN l.lag = 0 THEN sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) END AS apart
        FROM typed p CROSS JOIN (SELECT RANGE(0, <lags>)RANGE AS lag) l JOIN r a ON a.run_id = p.run_id AND a.event_id = p.event_id AND a.atom_id = p.i
        JOIN r b ON b.run_id = p.run_id AND b.event_id = p.event_id AND b.atom_id = p.j AND b.t = a.t + l.lag
        WHERE l.lag < p.w),
    lagged AS (
        SELECT run_id, event_id, i, j, distance, ti, tj, lag, avg(apart) AS apart,
            CASE WHEN stddev_pop(a) > 1E-10 AND stddev_pop(b) > 1E-10 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) ELSE 0 END AS corr
        FROM step GROUP BY run_id, event_id, i, j, distance, ti, tj, lag)
    SELECT run_id, event_id, i, j, distance, ti, tj, max(CASE WHEN lag = 0 THEN corr END) AS sync, max(CASE WHEN best = 1 AND lag > 0 THEN abs(corr) END) AS lag_strength, max(CASE WHEN best = 1 AND lag > 0 THEN lag END) AS best_lag,
        CASE WHEN max(apart) < <near> THEN 1 / (1 + max(apart)) ELSE 0 END AS coupling
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id, event_id, i, j, lag > 0 ORDER BY round(abs(corr), 9) DESC, lag) AS best FROM lagged) k
    GROUP BY run_id, event_id, i, j, distance, ti, tj""",
    {"lags": 3, "near": 6.0},
    doc="of each pair: correlation in step over the smaller window, the strongest later one, and 1 / (1 + mean distance) where that is below `near`",
)
LINKS = Op(
    "defect_links",
    """
    SELECT l.run_id, l.event_id, l.i, l.j, coalesce(g.group_id, -1) AS gi, coalesce(h.group_id, -1) AS gj, l.link_type, l.strength, l.lag, l.distance, l.stress_transfer
    FROM (
        SELECT run_id, event_id, i, j, 'elastic' AS link_type, abs(sync) AS strength, 0 AS lag, distance, coupling AS stress_transfer FROM {stats} WHERE ti = 'elastic' AND tj = 'elastic' AND abs(sync) > <sync>
        UNION ALL SELECT run_id, event_id, i, j, 'plastic', lag_strength, best_lag, distance, coupling FROM {stats} WHERE (ti = 'plastic' OR tj = 'plastic') AND lag_strength > <least>
        UNION ALL SELECT run_id, event_id, i, j, 'fracture', coupling, 0, distance, coupling * <modulus> FROM {stats} WHERE (ti = 'dislocation' OR tj = 'dislocation') AND coupling > <coupled>
        UNION ALL SELECT p.run_id, p.event_id, p.i, p.j, 'elastic', 1 / (1 + p.distance), 0, p.distance,
            CASE WHEN s.atom_type = 'Fe' AND t.atom_type = 'Fe' THEN 1.2E0 WHEN s.atom_type = 'C' OR t.atom_type = 'C' THEN 1.5E0 ELSE 1.0E0 END / (1 + p.distance)
        FROM {pairs} p LEFT JOIN {kinds} s ON s.run_id = p.run_id AND s.atom_id = p.i LEFT JOIN {kinds} t ON t.run_id = p.run_id AND t.atom_id = p.j WHERE p.n = 1 AND p.distance < <cutoff>) l
    LEFT JOIN {owner} g ON g.atom_id = l.i LEFT JOIN {owner} h ON h.atom_id = l.j""",
    {"sync": 0.7, "least": 0.5, "coupled": 0.5, "modulus": 210.0, "cutoff": 4.0},
    doc="elastic links move in step, plastic ones one after the other, fracture ones are close and one of them breaks away; an event of one frame has links by distance",
)
OWNER = Op("first_owner", "SELECT atom_id, min(group_id) AS group_id FROM {member} GROUP BY atom_id", light=True)
PATTERN = Op(
    "defect_pattern",
    """
    SELECT e.run_id, e.event_id, coalesce(n_elastic, 0) AS n_elastic, coalesce(n_plastic, 0) AS n_plastic, coalesce(n_fracture, 0) AS n_fracture,
        CASE WHEN e.end_frame = e.start_frame THEN 'elastic' WHEN coalesce(n_fracture, 0) > coalesce(n_plastic, 0) THEN 'crack_propagation' WHEN coalesce(n_plastic, 0) > coalesce(n_elastic, 0) THEN 'plastic_flow' ELSE 'elastic_deformation' END AS pattern
    FROM {events} e LEFT JOIN (
        SELECT run_id, event_id, sum(CASE WHEN link_type = 'elastic' THEN 1 ELSE 0 END) AS n_elastic, sum(CASE WHEN link_type = 'plastic' THEN 1 ELSE 0 END) AS n_plastic, sum(CASE WHEN link_type = 'fracture' THEN 1 ELSE 0 END) AS n_fracture
        FROM {links} GROUP BY run_id, event_id) l ON l.run_id = e.run_id AND l.event_id = e.event_id""",
)
CORES = Op(
    "dislocation_cores",
    """
    SELECT d.run_id, d.event_id, d.atom_id, d.degree, d.place
    FROM (
        SELECT run_id, event_id, atom_id, degree, row_number() OVER (PARTITION BY run_id, event_id ORDER BY degree DESC, atom_id) AS place
        FROM (SELECT run_id, event_id, atom_id, count(*) AS degree FROM (
            SELECT run_id, event_id, i AS atom_id FROM {links} WHERE link_type = 'plastic' UNION ALL SELECT run_id, event_id, j FROM {links} WHERE link_type = 'plastic') e GROUP BY run_id, event_id, atom_id) c) d
    JOIN {types} t ON t.run_id = d.run_id AND t.event_id = d.event_id AND t.atom_id = d.atom_id
    WHERE d.place <= 10 AND d.degree >= 3 AND t.type = 'dislocation'""",
    doc="of an event's ten atoms with most plastic links, the dislocations with three or more",
)
TIPS = Op(
    "crack_tips",
    """
    SELECT run_id, event_id, atom_id, place FROM (
        SELECT run_id, event_id, atom_id, row_number() OVER (PARTITION BY run_id, event_id ORDER BY atom_id) AS place
        FROM (SELECT run_id, event_id, i AS atom_id FROM {strongest} UNION SELECT run_id, event_id, j FROM {strongest}) a) p
    WHERE place <= 5""",
    doc="the atoms of an event's five fracture links of most stress transfer, five at most",
)
STRONGEST = Op(
    "strongest_fracture",
    "SELECT run_id, event_id, i, j FROM (SELECT run_id, event_id, i, j, row_number() OVER (PARTITION BY run_id, event_id ORDER BY round(stress_transfer, 9) DESC, i, j) AS r FROM {links} WHERE link_type = 'fracture') l WHERE r <= 5",
)
CONCENTRATORS = Op(
    "stress_concentrators",
    """
    SELECT atom_id, strain, place FROM (
        SELECT s.atom_id, s.strain, row_number() OVER (ORDER BY s.atom_id) AS place
        FROM (SELECT f.atom_id, f.strain FROM {field} f JOIN {atoms} a ON a.atom_id = f.atom_id CROSS JOIN (
            SELECT avg(f.strain) + <sigmas> * stddev_pop(f.strain) AS line FROM {field} f JOIN {atoms} a ON a.atom_id = f.atom_id) c
            WHERE f.strain > c.line ORDER BY f.atom_id LIMIT <most>) s) p""",
    {"sigmas": 2.0, "most": 10},
    doc="defect atoms strained by more than mean + sigmas x deviation, the first ten; the window numbers those alone",
)
BRIDGES = Op(
    "defect_bridges",
    """
    SELECT run_id, event_id, gi, gj, count(*) AS n_links, sum(strength) AS total_strength, max(stress_transfer) AS most_stress,
        CASE WHEN max(stress_transfer) > <modulus> * 0.01E0 THEN 'crack' WHEN sum(strength) > 2 THEN 'dislocation' ELSE 'grain_boundary' END AS bridge_type
    FROM {links} l JOIN (SELECT run_id AS r, event_id AS e, max(CASE WHEN end_frame > start_frame THEN 1 ELSE 0 END) AS long_ FROM {events} GROUP BY run_id, event_id) x ON x.r = l.run_id AND x.e = l.event_id
    WHERE gi <> gj AND (long_ = 0 OR link_type <> 'elastic') GROUP BY run_id, event_id, gi, gj""",
    {"modulus": 210.0},
    doc="links between two groups: plastic and fracture ones, of events of one frame all",
)
