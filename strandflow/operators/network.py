"""Pair networks, causality and resampling statistics over groups. `series` is (run_id, frame, v), a run per group.

Lag joins keep the series narrow: (group, frame, v) joined on shifted frames, one row per pair, lag and frame, folded at once into sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators import draws, resample
from strandflow.operators.windows import block_lags, packed
from strandflow.plans.op import BLOCK, Function, Op, halo_blocks

_CORR = "CASE WHEN stddev_pop(a) > 1E-10 AND stddev_pop(b) > 1E-10 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) ELSE 0 END"

NEAR_PAIRS = Op(
    "near_pairs",
    """
    SELECT i, j, avg(d) AS distance
    FROM {distances}
    WHERE frame IN (
        SELECT CAST(floor(k * (n - 1) / greatest(m - 1, 1)) AS INT)
        FROM (SELECT n, least(<samples>, n) AS m FROM (SELECT max(frame) + 1 AS n FROM {distances}) c0) c CROSS JOIN (SELECT RANGE(0, <samples> - 1)RANGE AS k) k
        WHERE k < m)
    GROUP BY i, j
    HAVING avg(d) < <most>""",
    {"most": 15.0, "samples": 10},
    doc="mean distance over evenly spaced frames",
)
ALL_PAIRS = Op("all_pairs", "SELECT a.g AS i, b.g AS j FROM (SELECT DISTINCT run_id AS g FROM {series}) a JOIN (SELECT DISTINCT run_id AS g FROM {series}) b ON a.g < b.g")
DISTANCE_TIERS = Op("distance_tiers", "SELECT i, j, distance, CASE WHEN distance < 5 THEN 1.0E0 WHEN distance < 10 THEN 0.8E0 ELSE 0.5E0 END AS tier FROM {pairs}")
PAIR_NAMES = Op("pair_names", "SELECT CAST(i AS VARCHAR(20)) AS i, CAST(j AS VARCHAR(20)) AS j, distance FROM {pairs}", doc="pairs of groups under the names of their series", light=True)
ADAPTIVE_GROUP_WINDOWS = Op(
    "adaptive_group_windows",
    """
    SELECT run_id AS g, CAST(greatest(<least>, least(<most>, 100
        * CASE WHEN events > 0.1E0 THEN 0.7E0 WHEN events < 0.02E0 THEN 2.0E0 ELSE 1.0E0 END
        * CASE WHEN vol > 2 THEN 0.8E0 WHEN vol < 0.5E0 THEN 1.3E0 ELSE 1.0E0 END)) AS INT) AS w
    FROM (
        SELECT run_id, avg(CASE WHEN v > 1 THEN 1.0E0 ELSE 0.0E0 END) AS events, CASE WHEN avg(v) > 1E-10 THEN stddev_pop(v) / avg(v) ELSE 0 END AS vol
        FROM {series} GROUP BY run_id) s""",
    {"least": 30, "most": 300},
)
_LAGGED = Op(
    "lagged_pairs",
    """
    SELECT i, j, lag, CASE WHEN sqrt(va) > 1E-10 AND sqrt(vb) > 1E-10 THEN c / (sqrt(va) * sqrt(vb)) ELSE 0 END AS corr, CAST(rows AS BIGINT) AS n
    FROM (
        SELECT i, j, lag, sum(n) AS rows, sum(sa + na * power(ma - a, 2)) / nullif(sum(na), 0) AS va, sum(sb + nb * power(mb - b, 2)) / nullif(sum(nb), 0) AS vb,
            sum(sc + nc * (pa - p) * (pb - q)) / nullif(sum(nc), 0) AS c
        FROM (
            SELECT *, sum(na * ma) OVER w / nullif(sum(na) OVER w, 0) AS a, sum(nb * mb) OVER w / nullif(sum(nb) OVER w, 0) AS b,
                sum(nc * pa) OVER w / nullif(sum(nc) OVER w, 0) AS p, sum(nc * pb) OVER w / nullif(sum(nc) OVER w, 0) AS q
            FROM {parts} WINDOW w AS (PARTITION BY i, j, lag)) m
        GROUP BY i, j, lag) s
    CROSS JOIN (SELECT <half> AS half FROM {series}) c
    WHERE s.lag < c.half""",
    {"half": "(max(frame) + 1) / 2"},
    doc="blocks of a pair and lag put together by their means and squared deviations; a window holds a row for each block",
)


def lagged_pairs(series: DataFrame, pairs: DataFrame, lags: range, both: bool = True, block: int | None = None, **params) -> DataFrame:
    """(i, j, lag, corr, n) for lags below half the run: a pair and block of frames is one group, with the frames that its lags reach; all lags are slices of its arrays."""
    narrow, reach = series.select(F.col("run_id").cast("string").alias("run_id"), "frame", F.col("v").cast("double").alias("v")), lags[-1]
    size = max(block or BLOCK, 2 * reach + 1)
    held = halo_blocks(narrow, reach, block=block).where(f"own or frame >= (blk + 1) * {size}").withColumnRenamed("blk", "frame_blk")
    span = narrow.agg(F.floor(F.min("frame") / size).cast("int").alias("lo"), F.floor(F.max("frame") / size).cast("int").alias("hi")).where("lo is not null")
    seats = pairs.select(F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j")).crossJoin(F.broadcast(span))  # one row
    seats = seats.select("i", "j", F.explode(F.sequence("lo", "hi")).alias("frame_blk"))
    seats = seats.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("later")).withColumn("run_id", F.expr("if(later, j, i)"))
    return _LAGGED(series=narrow, parts=block_lags(seats.join(packed(held), ["run_id", "frame_blk"]), lags, both), **params)


def lag_profile(series: DataFrame, pairs: DataFrame, lags: int = 20, step: int = 10, block: int | None = None) -> DataFrame:
    """(i, j, lag, corr, n) in both directions."""
    return lagged_pairs(series, pairs, range(0, lags * step, step), block=block)


LAG_PROFILE = Function(
    "lag_profile",
    f"""
    SELECT i, j, lag, {_CORR} AS corr, count(*) AS n
    FROM (
        SELECT p.i, p.j, x.lag, x.v AS a, y.v AS b
        FROM (SELECT i, j FROM {{pairs}} UNION ALL SELECT j, i FROM {{pairs}}) p
        JOIN (SELECT s.run_id, s.frame, s.v, l.lag FROM {{series}} s CROSS JOIN (SELECT k * <step> AS lag FROM (SELECT RANGE(0, <lags> - 1)RANGE AS k) k0) l) x ON x.run_id = p.i
        JOIN {{series}} y ON y.run_id = p.j AND y.frame = x.frame + x.lag
        CROSS JOIN (SELECT max(frame) + 1 AS n FROM {{series}}) c
        WHERE x.lag < c.n / 2) q
    GROUP BY i, j, lag""",
    {"lags": 20, "step": 10},
    doc="correlation of i with j later by lag, for every pair in both directions; lags below half the run",
    run=lag_profile,
)
CAUSAL_LINKS = Op(
    "causal_links",
    """
    SELECT from_id, to_id, strength, lag, distance, sync_rate, 'transition' AS link_type, abs(sync_rate) <= <sync> AS asynchronous
    FROM (
        SELECT r.i AS from_id, r.j AS to_id, abs(r.corr) AS strength, r.lag, p.distance,
            max(CASE WHEN r.lag = 0 THEN r.corr END) OVER (PARTITION BY p.i, p.j) AS sync_rate,
            row_number() OVER (PARTITION BY p.i, p.j ORDER BY round(abs(r.corr), 9) DESC, r.lag, r.i) AS best
        FROM {profile} r JOIN {pairs} p ON p.i = least(r.i, r.j) AND p.j = greatest(r.i, r.j)) b
    WHERE best = 1 AND strength > <least>""",
    {"least": 0.15, "sync": 0.2},
    doc="the strongest lag of a pair in either direction; pairs have a few dozen lags, so the windows are small",
)
TOP_CAUSAL = Op(
    "top_causal",
    "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY round(strength, 9) DESC, from_id, to_id) AS place FROM (SELECT * FROM {links} ORDER BY round(strength, 9) DESC, from_id, to_id LIMIT <top>) t) l WHERE strength >= <least>",
    {"top": 500, "least": 0.2},
)
SYNC_LINKS = Op(
    "sync_links",
    "SELECT r.i, r.j, r.corr AS sync_rate, p.distance FROM {profile} r JOIN {pairs} p ON p.i = r.i AND p.j = r.j WHERE r.lag = 0 AND abs(r.corr) > <least>",
    {"least": 0.2},
)
EVENT_SERIES = Op(
    "event_series",
    """
    SELECT e.event_id, s.run_id AS g, s.frame - e.start_frame AS t, e.end_frame - e.start_frame + 1 AS n, s.v
    FROM (SELECT event_id, start_frame, end_frame, RANGE(start_frame, end_frame)RANGE AS frame FROM {events}) e JOIN {series} s ON s.frame = e.frame""",
    doc="the groups' scores inside each event; t counts from its start, n is its length; a row for each frame of an event, so that the join is by equality",
)
NETWORK_MODE = Op(
    "network_mode",
    """
    SELECT event_id, n, CASE WHEN n = 1 THEN 'instantaneous' WHEN n = 2 THEN 'tunneling' WHEN n = 3 THEN 'jump' WHEN n < 10 THEN 'short_transition' ELSE 'classical' END AS mode
    FROM {inside} GROUP BY event_id, n""",
)
INSTANT_LINKS = Op(
    "instant_links",
    """
    WITH high AS (
        SELECT s.event_id, s.g, s.v, c.t
        FROM {inside} s JOIN (SELECT event_id, avg(v) + <sigmas> * stddev_pop(v) AS t FROM {inside} WHERE t = 0 GROUP BY event_id) c ON c.event_id = s.event_id
        WHERE s.t = 0 AND s.v > c.t)
    SELECT event_id, i, j, strength, distance, strength > 1.5E0 * t AS strong
    FROM (
        SELECT a.event_id, a.g AS i, b.g AS j, a.t, k.distance,
            sqrt(a.v * b.v) * greatest(0.5E0, least(2.0E0, k.coupling / (m.mean + 1E-10))) AS strength
        FROM high a JOIN high b ON b.event_id = a.event_id AND a.g < b.g
        JOIN (SELECT CAST(i AS VARCHAR(20)) AS i, CAST(j AS VARCHAR(20)) AS j, frame, d AS distance, 1 / (1 + d) AS coupling FROM {distances}) k ON k.i = a.g AND k.j = b.g
        JOIN {events} e ON e.event_id = a.event_id AND e.start_frame = k.frame
        JOIN (SELECT frame, avg(1 / (1 + d)) AS mean FROM {distances} GROUP BY frame) m ON m.frame = k.frame) l""",
    {"sigmas": 2.0},
    doc="groups over mean + sigmas x std in the event's first frame, in pairs: geometric mean of the scores, weighted by coupling",
)
TRANSITION_LINKS = Op(
    "transition_links",
    """
    WITH change AS (
        SELECT event_id, g, n,
            max(CASE WHEN t = 1 THEN v END) - max(CASE WHEN t = 0 THEN v END) AS step,
            abs(max(CASE WHEN t = 1 THEN v END) - max(CASE WHEN t = 0 THEN v END)) + abs(max(CASE WHEN t = 2 THEN v END) - max(CASE WHEN t = 1 THEN v END)) AS jump,
            avg(CASE WHEN t >= floor(n / 2) THEN v END) - avg(CASE WHEN t < floor(n / 2) THEN v END) AS half
        FROM {inside} WHERE n BETWEEN 2 AND 9 GROUP BY event_id, g, n)
    SELECT event_id, CASE WHEN kind = 'causal' AND abs(hj) >= abs(hi) THEN j ELSE i END AS from_id, CASE WHEN kind = 'causal' AND abs(hj) >= abs(hi) THEN i ELSE j END AS to_id, kind, strength, lag, sync_rate, distance,
        CASE WHEN n = 2 THEN strength > 0.7E0 WHEN n = 3 THEN strength > 0.5E0 ELSE kind = 'causal' AND strength > 0.5E0 END AS strong
    FROM (
        SELECT a.event_id, a.n, p.i, p.j, p.distance, a.half AS hi, b.half AS hj,
            CASE WHEN a.n = 2 THEN 'tunneling' WHEN a.n = 3 THEN 'jump' WHEN a.half * b.half > 0 THEN 'sync' ELSE 'causal' END AS kind,
            CASE WHEN a.n = 2 THEN sqrt(abs(a.step * b.step)) WHEN a.n = 3 THEN sqrt(a.jump * b.jump) WHEN a.half * b.half > 0 THEN sqrt(abs(a.half * b.half)) ELSE greatest(abs(a.half), abs(b.half)) END AS strength,
            CAST(CASE WHEN a.n = 2 THEN 0 WHEN a.n = 3 THEN 1 WHEN a.half * b.half > 0 THEN 0 ELSE floor(a.n / 2) END AS INT) AS lag,
            CASE WHEN a.n = 2 THEN 0.8E0 WHEN a.n = 3 THEN 0.5E0 WHEN a.half * b.half > 0 THEN 0.6E0 ELSE 0.2E0 END AS sync_rate
        FROM {pairs} p JOIN change a ON a.g = p.i JOIN change b ON b.g = p.j AND b.event_id = a.event_id
        WHERE CASE WHEN a.n = 2 THEN a.step * b.step > 0 AND abs(a.step) > 0.5E0 AND abs(b.step) > 0.5E0
            WHEN a.n = 3 THEN a.jump > 0.3E0 AND b.jump > 0.3E0
            ELSE abs(a.half) > 0.2E0 AND abs(b.half) > 0.2E0 END) l""",
    doc="rules for events of 2, 3 and 4 to 9 frames over near pairs",
)
EVENT_STATS = Op(
    "event_stats",
    """
    SELECT m.event_id, m.n, m.mode, count(l.strength) AS n_links, coalesce(sum(CASE WHEN l.kind = 'causal' THEN 1 ELSE 0 END), 0) AS n_causal,
        coalesce(sum(CASE WHEN l.strong THEN 1 ELSE 0 END), 0) AS n_strong, avg(l.strength) AS mean_strength, avg(l.distance) AS mean_distance
    FROM {mode} m LEFT JOIN (
        SELECT event_id, 'sync' AS kind, strength, distance, strong FROM {instant}
        UNION ALL SELECT event_id, kind, strength, distance, strong FROM {transition}) l ON l.event_id = m.event_id
    GROUP BY m.event_id, m.n, m.mode""",
    doc="the networks of all events, one row each",
)
INITIATORS = Op("initiators", "SELECT run_id AS g, first_frame, row_number() OVER (ORDER BY first_frame, run_id) AS place FROM (SELECT run_id, min(frame) AS first_frame FROM {series} WHERE v > <level> GROUP BY run_id ORDER BY first_frame, run_id LIMIT 5) f", {"level": 2.0})
DEGREES = Op("degrees", """SELECT g, sum(o) AS out_degree, sum(i) AS in_degree, sum(o) + sum(i) AS degree, CASE WHEN sum(o) > 2 * sum(i) THEN 'driver' WHEN sum(i) > 2 * sum(o) THEN 'responder' ELSE 'mediator' END AS role
    FROM (SELECT from_id AS g, 1 AS o, 0 AS i FROM {links} UNION ALL SELECT to_id, 0, 1 FROM {links}) d GROUP BY g""")
NETWORK_STATS = Op(
    "network_stats",
    """
    SELECT l.n_causal, s.n_sync, l.n_async, l.mean_strength, l.mean_distance, l.mean_lag, p.n_pairs, l.n_async / (l.n_causal + 1E-10) AS async_ratio
    FROM (SELECT count(*) AS n_causal, coalesce(sum(CASE WHEN asynchronous THEN 1 ELSE 0 END), 0) AS n_async, avg(strength) AS mean_strength,
            avg(CASE WHEN distance > 0 THEN distance END) AS mean_distance, avg(lag * 1.0E0) AS mean_lag FROM {links}) l
    CROSS JOIN (SELECT count(*) AS n_sync FROM {sync}) s CROSS JOIN (SELECT count(*) AS n_pairs FROM {pairs}) p""",
)
PATHS = Op("paths", """WITH RECURSIVE top3 AS (SELECT from_id, to_id, strength FROM (SELECT from_id, to_id, strength, row_number() OVER (PARTITION BY from_id ORDER BY round(strength, 9) DESC, to_id) AS r FROM {links}) x WHERE r <= 3),
    walk(path, at_, hops, weight) AS (SELECT CAST('/' || from_id || '/' || to_id || '/' AS VARCHAR(400)), to_id, 1, strength FROM top3
      UNION ALL SELECT CAST(w.path || t.to_id || '/' AS VARCHAR(400)), t.to_id, w.hops + 1, w.weight * t.strength FROM walk w JOIN top3 t ON t.from_id = w.at_ WHERE w.hops < <depth> AND position('/' || t.to_id || '/' IN w.path) = 0)
    SELECT path, hops, weight FROM walk""", {"depth": 5})
BRIDGES = Op("bridges", "SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, count(*) AS n_links, sum(strength) AS total, max(strength) AS strongest, min(lag) AS least_lag FROM {links} GROUP BY least(from_id, to_id), greatest(from_id, to_id)")

EVENT_CAUSALITY = Op("event_causality", """SELECT x.run_id AS i, y.run_id AS j, l.lag, avg(CASE WHEN y.v > <level> THEN 1.0E0 ELSE 0.0E0 END) AS p FROM {series} x CROSS JOIN (SELECT RANGE(1, <lags>)RANGE AS lag) l
    JOIN {series} y ON y.frame = x.frame + l.lag AND y.run_id <> x.run_id WHERE x.v > <level> GROUP BY x.run_id, y.run_id, l.lag""", {"level": 1.0, "lags": 10},
    spark="""SELECT x.run_id AS i, y.run_id AS j, x.lag, avg(CASE WHEN y.v > <level> THEN 1.0E0 ELSE 0.0E0 END) AS p FROM (SELECT run_id, frame, RANGE(1, <lags>)RANGE AS lag FROM {series} WHERE v > <level>) x
    JOIN {series} y ON y.frame = x.frame + x.lag AND y.run_id <> x.run_id GROUP BY x.run_id, y.run_id, x.lag""")
BEST_LAG = Op("best_lag", "SELECT i, j, lag, p FROM (SELECT i, j, lag, p, row_number() OVER (PARTITION BY i, j ORDER BY round(p, 9) DESC, lag) AS r FROM {profile}) b WHERE r = 1 AND p >= <least>", {"least": 0.0})
TRANSFER_ENTROPY = Op("transfer_entropy", """WITH bins AS (SELECT s.run_id, s.frame, CASE WHEN s.v <= e.q1 THEN 0 WHEN s.v <= e.q2 THEN 1 WHEN s.v <= e.q3 THEN 2 ELSE 3 END AS b FROM {series} s
      JOIN {quartiles} e ON e.run_id = s.run_id),
    steps AS (SELECT s.run_id, s.frame, s.b, t.b AS nxt FROM bins s JOIN bins t ON t.run_id = s.run_id AND t.frame = s.frame + 1),
    joint AS (SELECT x.run_id AS i, y.run_id AS j, y.nxt, y.b AS yb, x.b AS xb, count(*) AS n FROM steps y JOIN bins x ON x.frame = y.frame - <lag> + 1 AND x.run_id <> y.run_id GROUP BY x.run_id, y.run_id, y.nxt, y.b, x.b),
    m AS (SELECT *, sum(n) OVER (PARTITION BY i, j) AS total, sum(n) OVER (PARTITION BY i, j, yb) AS n_y, sum(n) OVER (PARTITION BY i, j, yb, xb) AS n_yx, sum(n) OVER (PARTITION BY i, j, nxt, yb) AS n_ny FROM joint)
    SELECT i, j, sum(n * 1.0E0 / total * ln(n * 1.0E0 * n_y / (n_yx * 1.0E0 * n_ny))) AS te FROM m GROUP BY i, j""", {"lag": 1}, doc="plug-in estimate on quartile bins; a frame meets the next one by equality, so no task sorts a run")
ORDERED_PAIRS = Op("ordered_pairs", "SELECT i, j, lag, p, row_number() OVER (ORDER BY round(p, 9) DESC, i, j) AS place FROM {best} WHERE p >= <least>", {"least": 0.1})
SURROGATE_TE = Op("surrogate_te", """SELECT i, j, CASE WHEN own_err > 1E-12 AND both_err > 1E-12 THEN ln(own_err / both_err) ELSE 0 END AS te FROM (SELECT x.run_id AS i, y.run_id AS j, avg(power(y.nxt - y.v, 2)) AS own_err, avg(power(y.nxt - (y.v + x.v) / 2, 2)) AS both_err
    FROM (SELECT s.run_id, s.frame, s.v, t.v AS nxt FROM {series} s JOIN {series} t ON t.run_id = s.run_id AND t.frame = s.frame + 1) y JOIN {series} x ON x.frame = y.frame AND x.run_id <> y.run_id GROUP BY x.run_id, y.run_id) e""")

_REPS = "(SELECT RANGE(1, <reps>)RANGE AS rep) r"
#: Frames are numbered without gaps, so a frame's place is its distance to the first one.
_FRAMES = "(SELECT f0.frame, f0.frame - f1.lo AS place_ FROM (SELECT DISTINCT frame FROM {series}) f0 CROSS JOIN (SELECT min(frame) AS lo FROM {series}) f1) f"
#: Draws with replacement: replicate `rep` takes frame number `pick`, `times` over. A hash of replicate and place, the same in every engine.
_DRAWS = f"""draws AS (
        SELECT d.rep, f.frame, d.times
        FROM (
            SELECT rep, HASH32['<seed>|' || rep || '|' || place_] % n AS pick, count(*) AS times
            FROM {_FRAMES} CROSS JOIN {_REPS} CROSS JOIN (SELECT count(DISTINCT frame) AS n FROM {{series}}) n
            GROUP BY 1, 2) d
        JOIN {_FRAMES} ON f.place_ = d.pick)"""
_RES = {"seed": 42, "reps": 1000}

BOOTSTRAP_CORRELATION = Function("bootstrap_correlation", resample.PLAIN, _RES, run=resample.bootstrap_correlation, doc="percentile interval over frames with Poisson weights, by weight vectors")
_LONG = """    long AS (
        SELECT rep, run_id, 'mean' AS stat, mean AS x FROM replicate UNION ALL SELECT rep, run_id, 'var', var FROM replicate UNION ALL SELECT rep, run_id, 'std', sqrt(var) FROM replicate
        UNION ALL SELECT rep, run_id, 'median', median FROM replicate UNION ALL SELECT rep, run_id, 'max', most FROM replicate UNION ALL SELECT rep, run_id, 'min', least_ FROM replicate)
"""
#: A row for each statistic from one pass: Spark plans a common table anew for every branch of a union that reads it.
_STACKED = "    long AS (SELECT rep, run_id, stack(6, 'mean', mean, 'var', var, 'std', sqrt(var), 'median', median, 'max', most, 'min', least_) AS (stat, x) FROM {replicate})\n"
_INTERVALS = """    SELECT run_id AS g, stat, max(CASE WHEN rep = 0 THEN x END) AS estimate, PCT(CASE WHEN rep > 0 THEN x END, 0.025) AS lo, PCT(CASE WHEN rep > 0 THEN x END, 0.975) AS hi,
        avg(CASE WHEN rep > 0 THEN x END) - max(CASE WHEN rep = 0 THEN x END) AS bias, stddev_pop(CASE WHEN rep > 0 THEN x END) AS se
    FROM long GROUP BY run_id, stat"""
_STATISTICS = f"""    replicate AS (
        SELECT rep, run_id, sum(times * v) / sum(times) AS mean, greatest(sum(times * v * v) / sum(times) - power(sum(times * v) / sum(times), 2), 0) AS var, max(v) AS most, min(v) AS least_,
            (min(CASE WHEN upto >= floor((n + 1) / 2) THEN v END) + min(CASE WHEN upto >= floor(n / 2) + 1 THEN v END)) / 2 AS median
        FROM drawn GROUP BY rep, run_id),
{_LONG}{_INTERVALS}"""
_BOOTSTRAP_INTERVALS = Op("bootstrap_intervals", f"    WITH {_STACKED}{_INTERVALS}")


def bootstrap_statistics(series: DataFrame, seed: int, reps: int, **given) -> DataFrame:
    return _BOOTSTRAP_INTERVALS(replicate=draws.bootstrapped(series, seed, reps, **given))


BOOTSTRAP_STATISTICS = Function(
    "bootstrap_statistics",
    f"""
    WITH {_DRAWS},
    drawn AS (
        SELECT rep, run_id, v, times, sum(times) OVER (PARTITION BY rep, run_id ORDER BY v, frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(times) OVER (PARTITION BY rep, run_id) AS n
        FROM (SELECT rep, frame, times FROM draws UNION ALL SELECT 0, frame, 1 FROM (SELECT DISTINCT frame FROM {{series}}) f) d JOIN {{series}} USING (frame)),
{_STATISTICS}""",
    _RES,
    run=bootstrap_statistics,
    doc="intervals of six statistics; draws go to the block of the frame that they pick, are counted there and meet the series there",
)
PERMUTATION = Function(
    "permutation",
    f"""
    WITH seats AS (SELECT frame, place_, n FROM {_FRAMES} CROSS JOIN (SELECT count(DISTINCT frame) AS n FROM {{series}}) n),
    dealt AS (
        SELECT rep, frame, side FROM (
            SELECT rep, frame, side, n, row_number() OVER (PARTITION BY rep ORDER BY HASH32['<seed>|' || rep || '|' || (place_ + side * n)], place_ + side * n) AS rank
            FROM seats CROSS JOIN (SELECT RANGE(0, 1)RANGE AS side) s CROSS JOIN {_REPS}) d
        WHERE rank <= n),
    sums AS (SELECT d.rep, d.side, s.run_id, sum(s.v) AS s FROM dealt d JOIN {{series}} s ON s.frame = d.frame GROUP BY d.rep, d.side, s.run_id),
    whole AS (SELECT run_id, sum(v) AS s, count(*) AS n FROM {{series}} GROUP BY run_id),
    stat AS (
        SELECT a.run_id AS i, b.run_id AS j, (x.s - y.s) / x.n AS observed, (2 * (a.s + b.s) - x.s - y.s) / x.n AS c
        FROM sums a JOIN sums b ON b.rep = a.rep AND a.side = 0 AND b.side = 1 AND a.run_id < b.run_id JOIN whole x ON x.run_id = a.run_id JOIN whole y ON y.run_id = b.run_id)
    SELECT i, j, max(observed) AS observed, avg(CASE WHEN abs(c) >= abs(observed) - 1E-9 THEN 1.0E0 ELSE 0.0E0 END) AS p_two,
        avg(CASE WHEN c >= observed - 1E-9 THEN 1.0E0 ELSE 0.0E0 END) AS p_greater, avg(CASE WHEN c <= observed + 1E-9 THEN 1.0E0 ELSE 0.0E0 END) AS p_less
    FROM stat GROUP BY i, j""",
    {"seed": 42, "reps": 10000},
    run=draws.permutation,
    doc="difference of means of two groups; each replicate deals the joint places anew, once for all pairs, so only sums a replicate and group are paired",
)
NULL_P_VALUE = Function(
    "null_p_value",
    f"""
    WITH shuffled AS (
        SELECT rep, frame, lead(frame) OVER (PARTITION BY rep ORDER BY HASH32['<seed>|' || rep || '|' || place_], place_) AS next_
        FROM {_FRAMES} CROSS JOIN {_REPS}
        UNION ALL SELECT DISTINCT 0, frame, frame + 1 FROM {{series}}),
    stat AS (
        SELECT p.rep, x.run_id, sum((x.v - m.m) * (y.v - m.m)) / max(m.ss) AS c
        FROM shuffled p JOIN {{series}} x ON x.frame = p.frame JOIN {{series}} y ON y.run_id = x.run_id AND y.frame = p.next_
        JOIN (SELECT run_id, avg(v) AS m, var_pop(v) * count(*) + 1E-300 AS ss FROM {{series}} GROUP BY run_id) m ON m.run_id = x.run_id
        GROUP BY p.rep, x.run_id)
    SELECT s.run_id AS g, max(o.c) AS observed, avg(s.c) AS null_mean, avg(CASE WHEN abs(s.c) >= abs(o.c) - 1E-9 THEN 1.0E0 ELSE 0.0E0 END) AS p_two, avg(CASE WHEN s.c >= o.c - 1E-9 THEN 1.0E0 ELSE 0.0E0 END) AS p_greater,
        avg(CASE WHEN s.c <= o.c + 1E-9 THEN 1.0E0 ELSE 0.0E0 END) AS p_less, avg(CASE WHEN abs(s.c) >= abs(o.c) - 1E-9 THEN 1.0E0 ELSE 0.0E0 END) < 0.05 AS significant
    FROM stat s JOIN stat o ON o.run_id = s.run_id AND o.rep = 0 WHERE s.rep > 0 GROUP BY s.run_id""",
    {"seed": 42, "reps": 1000},
    run=draws.null_p_value,
    doc="lag-one autocorrelation against its distribution over shuffled frames",
)
CHAIN_CONFIDENCE = Op("chain_confidence", "SELECT l.from_id, l.to_id, l.strength, b.estimate, b.lo, b.hi, b.se, b.bias, (b.lo > 0 OR b.hi < 0) AS significant FROM {links} l JOIN {boot} b ON b.i = least(l.from_id, l.to_id) AND b.j = greatest(l.from_id, l.to_id)")
ROC = Op(
    "roc",
    """
    WITH level AS (
        SELECT run_id, v, sum(CASE WHEN truth THEN 1.0E0 ELSE 0.0E0 END) AS p, sum(CASE WHEN truth THEN 0.0E0 ELSE 1.0E0 END) AS n, max(CASE WHEN v > <alarm> THEN 1.0E0 ELSE 0.0E0 END) AS alarm
        FROM {scored} GROUP BY run_id, v),
    part AS (
        SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY run_id) AS pos, sum(n) OVER (PARTITION BY run_id) AS neg
        FROM level WINDOW w AS (PARTITION BY run_id ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    steps AS (SELECT *, lag(tp / (tp + fp)) OVER (PARTITION BY run_id ORDER BY v DESC) AS before_ FROM part)
    SELECT run_id, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(n * (tp - p / 2)) / (max(pos) * max(neg)) ELSE 0.5E0 END AS roc_auc,
        CASE WHEN max(pos) > 0 THEN sum(p * (tp / (tp + fp) + coalesce(before_, 1)) / 2) / max(pos) ELSE 0 END AS pr_auc,
        CASE WHEN max(neg) > 0 THEN sum(n * alarm) / max(neg) ELSE 0 END AS fpr
    FROM steps GROUP BY run_id""",
    {"alarm": 2.0},
    doc="areas by trapezia over the distinct scores; the false positive rate at a score over `alarm`",
)
DETECTION = Op(
    "detection",
    """
    SELECT e.run_id, e.event_id, e.peak_score, e.peak_score > 2 AS peak, coalesce(b.start_error <= <tolerance> OR b.end_error <= <tolerance> OR b.inner_ > 0, FALSE) AS near_boundary, e.sustained > 0.1E0 AS sustained,
        e.peak_score > 2 OR coalesce(b.start_error <= <tolerance> OR b.end_error <= <tolerance> OR b.inner_ > 0, FALSE) AS detected, CASE WHEN e.peak_score > 2 THEN e.peak_score / 2 ELSE e.sustained END AS confidence,
        coalesce(b.start_error, e.n_frames) AS start_error, coalesce(b.end_error, e.n_frames) AS end_error
    FROM (
        SELECT e.run_id, e.event_id, max(s.v) AS peak_score, avg(CASE WHEN s.v > 1.5E0 THEN 1.0E0 ELSE 0.0E0 END) AS sustained, max(n.n) AS n_frames
        FROM {truth} e JOIN {series} s ON s.run_id = e.run_id AND s.frame >= e.start_frame AND s.frame < e.end_frame JOIN (SELECT run_id, count(*) AS n FROM {series} GROUP BY run_id) n ON n.run_id = e.run_id
        GROUP BY e.run_id, e.event_id) e
    LEFT JOIN (
        SELECT e.run_id, e.event_id, min(abs(b.frame - e.start_frame)) AS start_error, min(abs(b.frame - e.end_frame)) AS end_error, sum(CASE WHEN b.frame BETWEEN e.start_frame AND e.end_frame THEN 1 ELSE 0 END) AS inner_
        FROM {truth} e JOIN {boundaries} b ON b.run_id = e.run_id GROUP BY e.run_id, e.event_id) b ON b.run_id = e.run_id AND b.event_id = e.event_id""",
    {"tolerance": 5000},
    doc="`truth` holds labelled events, end exclusive; boundaries are those that the detector found",
)
TIMING = Op(
    "timing",
    """
    SELECT run_id, avg(error * 1.0E0) AS mean_error, PCT(error * 1.0E0, 0.5) AS median_error, avg(CASE WHEN error < <tolerance> THEN 1.0E0 ELSE 0.0E0 END) AS accuracy, count(*) / 2 AS n_events
    FROM (SELECT run_id, start_error AS error FROM {detection} UNION ALL SELECT run_id, end_error FROM {detection}) e GROUP BY run_id""",
    {"tolerance": 5000},
)
OVERALL = Op(
    "overall",
    """
    SELECT run_id, detection_rate, confidence, score, CASE WHEN score > 0.8E0 THEN 'Excellent' WHEN score > 0.6E0 THEN 'Good' WHEN score > 0.4E0 THEN 'Fair' ELSE 'Needs Improvement' END AS grade
    FROM (
        SELECT d.run_id, d.detection_rate, d.confidence, 0.4E0 * d.detection_rate + 0.3E0 * t.accuracy + 0.2E0 * r.roc_auc + 0.1E0 * (1 - r.fpr) AS score
        FROM (SELECT run_id, avg(CASE WHEN detected THEN 1.0E0 ELSE 0.0E0 END) AS detection_rate, avg(confidence) AS confidence FROM {detection} GROUP BY run_id) d
        JOIN {timing} t ON t.run_id = d.run_id JOIN {roc} r ON r.run_id = d.run_id) s""",
)
