"""Networks inside events: links, initiators and paths of every event in one job, keyed by event, pair and lag.

`inside` is (event_id, g, t, n, v): the groups' scores in each event, t from its start, n its length. `distances` is (frame, i, j, d).
Events differ in length, so each has its own lags, windows and samples; all rows carry the event and join by equality.
"""

from __future__ import annotations

from strandflow.plans.op import Op

_CORR = "CASE WHEN stddev_pop(a) > 1E-10 AND stddev_pop(b) > 1E-10 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) ELSE 0 END"

NEAR_PAIRS = Op(
    "event_near_pairs",
    """
    SELECT e.event_id, e.n, CAST(d.i AS VARCHAR(20)) AS i, CAST(d.j AS VARCHAR(20)) AS j, avg(d.d) AS distance
    FROM (
        SELECT event_id, n, start_frame + CAST(floor(k * (n - 1) / greatest(m - 1, 1)) AS INT) AS frame
        FROM (SELECT event_id, start_frame, end_frame - start_frame + 1 AS n, least(<samples>, end_frame - start_frame + 1) AS m, RANGE(0, <samples> - 1)RANGE AS k FROM {events}) s
        WHERE k < m) e
    JOIN {distances} d ON d.frame = e.frame
    GROUP BY e.event_id, e.n, d.i, d.j HAVING avg(d.d) < <most>""",
    {"samples": 10, "most": 15.0},
    doc="pairs near each other in an event: mean distance over evenly spaced frames of it",
)
LAG_PROFILE = Op(
    "event_lag_profile",
    f"""
    SELECT event_id, i, j, way, lag, distance, {_CORR} AS corr
    FROM (
        SELECT p.event_id, p.i, p.j, p.way, l.lag, p.distance, x.v AS a, y.v AS b
        FROM (SELECT event_id, i, j, n, distance, 1 AS way FROM {{pairs}} UNION ALL SELECT event_id, j, i, n, distance, -1 FROM {{pairs}}) p
        CROSS JOIN (SELECT k * <step> AS lag FROM (SELECT RANGE(0, <lags> - 1)RANGE AS k) k0) l
        JOIN {{inside}} x ON x.event_id = p.event_id AND x.g = p.i
        JOIN {{inside}} y ON y.event_id = p.event_id AND y.g = p.j AND y.t = x.t + l.lag
        WHERE p.n >= <least> AND (l.lag < floor(p.n / 2)) AND (l.lag > 0 OR p.way = 1)) q
    GROUP BY event_id, i, j, way, lag, distance""",
    {"step": 10, "lags": 20, "least": 10},
    spark=f"""
    SELECT event_id, i, j, way, lag, distance, {_CORR} AS corr
    FROM (
        SELECT p.event_id, p.i, p.j, p.way, x.lag, p.distance, x.v AS a, y.v AS b
        FROM (SELECT event_id, i, j, n, distance, 1 AS way FROM {{pairs}} UNION ALL SELECT event_id, j, i, n, distance, -1 FROM {{pairs}}) p
        JOIN (SELECT event_id, g, v, k * <step> AS lag, t + k * <step> AS later FROM (SELECT event_id, g, t, n, v, RANGE(0, <lags> - 1)RANGE AS k FROM {{inside}} WHERE n >= <least>) s WHERE k * <step> < floor(n / 2)) x ON x.event_id = p.event_id AND x.g = p.i
        JOIN {{inside}} y ON y.event_id = p.event_id AND y.g = p.j AND y.t = x.later
        WHERE p.n >= <least> AND (x.lag > 0 OR p.way = 1)) q
    GROUP BY event_id, i, j, way, lag, distance""",
    doc="correlation of i with j later, in both ways, for lags below half the event",
)
LINKS = Op(
    "event_links",
    """
    SELECT event_id, from_id, to_id, strength, lag, distance, sync_rate, asynchronous, place
    FROM (
        SELECT event_id, i AS from_id, j AS to_id, abs(corr) AS strength, lag, distance, sync_rate, abs(sync_rate) <= <sync> AS asynchronous,
            row_number() OVER (PARTITION BY event_id ORDER BY round(abs(corr), 9) DESC, i, j) AS place
        FROM (
            SELECT event_id, i, j, lag, distance, corr, max(CASE WHEN lag = 0 THEN corr END) OVER (PARTITION BY event_id, least(i, j), greatest(i, j)) AS sync_rate,
                row_number() OVER (PARTITION BY event_id, least(i, j), greatest(i, j) ORDER BY round(abs(corr), 9) DESC, lag, way DESC) AS best
            FROM {profile}) b
        WHERE best = 1 AND abs(corr) > <least>) s
    WHERE place <= <top> AND strength >= <weak>""",
    {"least": 0.15, "sync": 0.2, "top": 500, "weak": 0.2},
    doc="a pair's strongest lag, the strongest links of an event; a pair has a few dozen lags, so its window is small",
)
SYNC_LINKS = Op("event_sync_links", "SELECT event_id, i, j, corr AS sync_rate, distance FROM {profile} WHERE lag = 0 AND abs(corr) > <least>", {"least": 0.2})

_RISES = """
    SELECT event_id, g, t, v FROM (
        SELECT s.event_id, s.g, s.t, s.v, c.high, lag(s.v) OVER w AS p, lead(s.v) OVER w AS q
        FROM {inside} s JOIN (SELECT event_id, g, avg(v) + stddev_pop(v) AS high FROM {inside} GROUP BY event_id, g) c ON c.event_id = s.event_id AND c.g = s.g
        WINDOW w AS (PARTITION BY s.event_id, s.g ORDER BY s.t)) x
    WHERE v > p AND v > q AND v >= high"""
_TOPS = "SELECT event_id, g, t, v FROM (SELECT event_id, g, t, v, row_number() OVER (PARTITION BY event_id, g ORDER BY v DESC, t) AS r FROM {inside}) m WHERE r = 1"
_PLACED = """
    SELECT k.event_id, k.g, k.t AS delay, i.v AS peak, k.place FROM (
        SELECT event_id, g, t, row_number() OVER (PARTITION BY event_id, g ORDER BY t) AS place FROM (
            SELECT event_id, g, t FROM kept
            UNION ALL SELECT m.event_id, m.g, m.t FROM tops m LEFT JOIN (SELECT DISTINCT event_id, g FROM kept) h ON h.event_id = m.event_id AND h.g = m.g WHERE h.g IS NULL) a) k
    JOIN {inside} i ON i.event_id = k.event_id AND i.g = k.g AND i.t = k.t WHERE k.place <= <most>"""


class _Thinned(Op):
    """A fold over an event's few rises: each engine has its own form of it."""

    def plain(self, params: dict) -> str:
        text = f"""WITH rises AS ({_RISES}), tops AS ({_TOPS}),
            kept AS (SELECT event_id, g, unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), list([CAST(t AS BIGINT)] ORDER BY v DESC, t)), lambda a, x: CASE WHEN len(list_filter(a, lambda k: abs(k - x[1]) < <apart>)) > 0 THEN a ELSE list_append(a, x[1]) END)) AS t FROM rises GROUP BY event_id, g)
            {_PLACED}"""
        for k, v in {**self.params, **params}.items():
            text = text.replace(f"<{k}>", str(v))
        return text


PEAKS = _Thinned(
    "event_peaks",
    "",  # the check's form is `plain`
    {"apart": 5, "most": 5},
    spark="""
    SELECT event_id, g, x.t AS delay, -x.v AS peak, place + 1 AS place FROM (
        SELECT event_id, g, posexplode(slice(array_sort(transform(if(size(rises) = 0, array(top), aggregate(array_sort(rises), cast(array() AS array<struct<v: double, t: bigint>>),
            (a, x) -> if(exists(a, k -> abs(k.t - x.t) < <apart>), a, array_append(a, x)))), x -> struct(x.t, x.v))), 1, <most>)) AS (place, x)
        FROM (
            SELECT event_id, g, collect_list(CASE WHEN v > p AND v > q AND v >= high THEN struct(-v AS v, CAST(t AS BIGINT) AS t) END) AS rises,
                max_by(struct(-v AS v, CAST(t AS BIGINT) AS t), struct(v IS NOT NULL, v, -t)) AS top
            FROM (
                SELECT event_id, g, t, v, lag(v) OVER w AS p, lead(v) OVER w AS q, avg(v) OVER every + stddev_pop(v) OVER every AS high
                FROM {inside} WINDOW w AS (PARTITION BY event_id, g ORDER BY t), every AS (PARTITION BY event_id, g)) s
            GROUP BY event_id, g) r) e""",
    doc="a group's peaks in an event: over mean + deviation, the highest first removing all closer than `apart`; without one the highest frame. An event's rows of a group are shuffled once",
)
INITIATORS = Op(
    "event_initiators",
    """
    WITH stat AS (SELECT event_id, CASE WHEN stddev_pop(delay) > 0 THEN avg(delay) - 2 * stddev_pop(delay) ELSE PCT(delay, 0.25) END AS early FROM {peaks} GROUP BY event_id),
    early AS (SELECT p.event_id, p.g, p.delay FROM {peaks} p JOIN stat s ON s.event_id = p.event_id WHERE p.delay < greatest(10, s.early)),
    found AS (SELECT s.event_id, count(e.g) AS n FROM stat s LEFT JOIN early e ON e.event_id = s.event_id GROUP BY s.event_id),
    hub AS (
        SELECT d.event_id, d.g FROM (
            SELECT event_id, from_id AS g, count(*) AS degree, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, from_id) AS r FROM {links} GROUP BY event_id, from_id) d
        JOIN found f ON f.event_id = d.event_id LEFT JOIN (SELECT DISTINCT event_id, g FROM early) e ON e.event_id = d.event_id AND e.g = d.g
        WHERE f.n < 3 AND d.r <= 3 AND d.degree >= <degree> AND e.g IS NULL),
    chosen AS (SELECT DISTINCT event_id, g, 'early' AS reason FROM early UNION ALL SELECT event_id, g, 'hub' FROM hub)
    SELECT event_id, g, reason FROM chosen
    UNION ALL SELECT DISTINCT p.event_id, p.g, 'fastest' FROM (SELECT event_id, g, row_number() OVER (PARTITION BY event_id ORDER BY delay, g) AS r FROM {peaks}) p
    LEFT JOIN (SELECT DISTINCT event_id FROM chosen) s ON s.event_id = p.event_id WHERE s.event_id IS NULL AND p.r <= 3""",
    {"degree": 3},
    doc="groups that answer before max(10, mean - 2 deviations, or the first quartile without deviation); with fewer than three, hubs; without any, the three fastest",
)
PATHS = Op(
    "event_paths",
    """
    WITH RECURSIVE walk(event_id, path, at_, hops) AS (
        SELECT event_id, CAST('/' || g || '/' AS VARCHAR(400)), g, 0 FROM {initiators}
        UNION ALL SELECT w.event_id, CAST(w.path || l.to_id || '/' AS VARCHAR(400)), l.to_id, w.hops + 1
        FROM walk w JOIN {links} l ON l.event_id = w.event_id AND l.from_id = w.at_ WHERE w.hops < <depth> AND position('/' || l.to_id || '/' IN w.path) = 0)
    SELECT event_id, path, hops, place FROM (
        SELECT w.event_id, w.path, w.hops, row_number() OVER (PARTITION BY w.event_id ORDER BY w.hops DESC, w.path) AS place
        FROM walk w LEFT JOIN (SELECT DISTINCT event_id, from_id FROM {links}) o ON o.event_id = w.event_id AND o.from_id = w.at_
        WHERE w.hops > 0 AND (w.hops = <depth> OR o.from_id IS NULL)) p
    WHERE place <= <most>""",
    {"depth": 5, "most": 5},
    doc="the longest ways from an event's initiators along its links, to the depth or to a group without links; ties by name",
)
SUMMARY = Op(
    "event_summary",
    """
    SELECT m.event_id, m.n, m.mode, coalesce(l.n_causal, 0) AS n_causal, coalesce(l.n_async, 0) AS n_async, coalesce(s.n_sync, 0) AS n_sync, l.strength, l.lag, coalesce(i.n, 0) AS n_initiators, coalesce(p.longest, 0) AS longest
    FROM {mode} m LEFT JOIN (SELECT event_id, count(*) AS n_causal, sum(CASE WHEN asynchronous THEN 1 ELSE 0 END) AS n_async, avg(strength) AS strength, avg(lag * 1.0E0) AS lag FROM {links} GROUP BY event_id) l ON l.event_id = m.event_id
    LEFT JOIN (SELECT event_id, count(*) AS n_sync FROM {sync} GROUP BY event_id) s ON s.event_id = m.event_id
    LEFT JOIN (SELECT event_id, count(*) AS n FROM {initiators} GROUP BY event_id) i ON i.event_id = m.event_id
    LEFT JOIN (SELECT event_id, max(hops) AS longest FROM {paths} GROUP BY event_id) p ON p.event_id = m.event_id
    WHERE m.n >= <least>""",
    {"least": 10},
)
