"""Phase-space operators on series (run_id, frame, v): delay embedding, neighbours, dimensions, recurrence. All points take part."""

from __future__ import annotations

from strandflow.operators import neighbours
from strandflow.plans.op import Function, Op

EMBED = Op("embed", """SELECT run_id, frame, a, b, c FROM (SELECT run_id, frame, own, v AS a, lead(v, <tau>) OVER w AS b, lead(v, 2 * <tau>) OVER w AS c FROM {series} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame)) e WHERE own AND c IS NOT NULL""", {"tau": 3}, halo=("series", "2 * tau"))
MUTUAL_INFORMATION = Op("mutual_information", """WITH bins AS (SELECT s.run_id, s.frame, CAST(least(19, floor(20 * (s.v - r.lo) / (r.hi - r.lo + 1E-12))) AS INT) AS b FROM {series} s JOIN (SELECT run_id, min(v) AS lo, max(v) AS hi FROM {series} GROUP BY run_id) r ON r.run_id = s.run_id),
    joint AS (SELECT x.run_id, l.lag, x.b AS p, y.b AS q, count(*) * 1.0E0 AS n FROM bins x JOIN (SELECT run_id, count(*) AS n FROM {series} GROUP BY run_id) c ON c.run_id = x.run_id CROSS JOIN (SELECT RANGE(1, <lags>)RANGE AS lag) l JOIN bins y ON y.run_id = x.run_id AND y.frame = x.frame + l.lag WHERE l.lag <= greatest(floor(c.n / 10), 1) GROUP BY x.run_id, l.lag, x.b, y.b),
    m AS (SELECT *, sum(n) OVER (PARTITION BY run_id, lag) AS total, sum(n) OVER (PARTITION BY run_id, lag, p) AS np, sum(n) OVER (PARTITION BY run_id, lag, q) AS nq FROM joint)
    SELECT run_id, lag, sum(n / total * ln(n * total / (np * nq))) AS mi FROM m GROUP BY run_id, lag""", {"lags": 100})
BEST_DELAY = Op("best_delay", "SELECT run_id, coalesce(min(CASE WHEN round(mi, 9) < round(p, 9) AND round(mi, 9) <= round(q, 9) THEN lag END), 1) AS tau FROM (SELECT run_id, lag, mi, lag(mi) OVER (PARTITION BY run_id ORDER BY lag) AS p, lead(mi) OVER (PARTITION BY run_id ORDER BY lag) AS q FROM {mi}) x GROUP BY run_id")
DISTANCES = Op("phase_distances", "SELECT x.run_id, x.frame AS i, y.frame AS j, sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2) + power(x.c - y.c, 2)) AS d FROM {points} x JOIN {points} y ON y.run_id = x.run_id AND y.frame <> x.frame")
_ALL = "SELECT x.run_id, x.frame AS i, y.frame AS j, sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2) + power(x.c - y.c, 2)) AS d FROM {points} x JOIN {points} y ON y.run_id = x.run_id AND y.frame <> x.frame"
KNN = Function("knn", f"SELECT run_id, i AS frame, avg(d) AS mean_distance FROM (SELECT run_id, i, d, row_number() OVER (PARTITION BY run_id, i ORDER BY round(d, 12), j) AS r FROM ({_ALL}) d) k WHERE r <= <k> GROUP BY run_id, i", {"k": 20}, run=neighbours.knn_mean, doc="by tiles; the check's form looks at all pairs")
KNN_ANOMALY = Op("knn_anomaly", "SELECT k.run_id, k.frame + <shift> AS frame, CASE WHEN s.sd > 1E-10 THEN greatest(-5.0E0, least(5.0E0, (k.mean_distance - s.m) / s.sd)) ELSE 0 END AS z FROM {knn} k JOIN (SELECT run_id, avg(mean_distance) AS m, stddev_pop(mean_distance) AS sd FROM {knn} GROUP BY run_id) s ON s.run_id = k.run_id", {"shift": 3})
FALSE_NEIGHBOURS = Op("false_neighbours", """SELECT n.run_id, avg(CASE WHEN abs(x.c - y.c) > <ratio> * n.d THEN 1.0E0 ELSE 0.0E0 END) AS share FROM (SELECT run_id, i, j, d FROM (SELECT run_id, i, j, d, row_number() OVER (PARTITION BY run_id, i ORDER BY round(d, 12), j) AS r FROM (
      SELECT x.run_id, x.frame AS i, y.frame AS j, sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2)) AS d FROM {points} x JOIN {points} y ON y.run_id = x.run_id AND y.frame <> x.frame) p) q WHERE r = 1) n
    JOIN {points} x ON x.run_id = n.run_id AND x.frame = n.i JOIN {points} y ON y.run_id = n.run_id AND y.frame = n.j GROUP BY n.run_id""", {"ratio": 10.0})
CORRELATION_DIMENSION = Op(
    "correlation_dimension",
    """
    WITH near AS (
        SELECT run_id, least(<radii>, greatest(0, CAST(ceil((ln(d + 1E-300) - ln(<lo>)) / (ln(<hi>) - ln(<lo>)) * (<radii> - 1) + 1E-9) AS INT))) AS k, count(*) AS n
        FROM {distances} GROUP BY 1, 2),
    total AS (SELECT run_id, sum(n) * 1.0E0 AS n FROM near GROUP BY run_id),
    part AS (
        SELECT r.run_id, r.k, sum(CASE WHEN m.k <= r.k THEN m.n ELSE 0 END) / max(r.n) AS c
        FROM (SELECT run_id, n, RANGE(0, <radii> - 1)RANGE AS k FROM total) r JOIN near m ON m.run_id = r.run_id GROUP BY r.run_id, r.k)
    SELECT run_id, CASE WHEN count(*) > 5 THEN greatest(0.5E0, least(5.0E0, regr_slope(ln(c), ln(<lo>) + k * (ln(<hi>) - ln(<lo>)) / (<radii> - 1)))) ELSE 2.0E0 END AS dimension
    FROM part WHERE c > 0 GROUP BY run_id""",
    {"radii": 30, "lo": 0.01, "hi": 10.0},
    doc="distances are counted by the least of the radii (equal steps of the logarithm) that holds them, so each is looked at once",
)
LYAPUNOV_RATES = Op(
    "lyapunov_rates",
    """
    WITH pair AS (
        SELECT x.run_id, x.frame AS i, y.frame AS j, sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2) + power(x.c - y.c, 2)) AS d
        FROM (SELECT p.*, p.frame + l.lag AS to_ FROM {points} p CROSS JOIN (SELECT RANGE(-<band>, <band>)RANGE AS lag) l WHERE abs(l.lag) > <apart>) x
        JOIN {points} y ON y.run_id = x.run_id AND y.frame = x.to_),
    near AS (SELECT run_id, i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY run_id, i ORDER BY round(d, 12), j) AS r FROM pair) q WHERE r = 1),
    later AS (SELECT n.run_id, n.i, n.d, k.k, n.i + k.k AS ik, n.j + k.k AS jk FROM near n CROSS JOIN (SELECT RANGE(1, <steps>)RANGE AS k) k)
    SELECT l.run_id, l.i AS frame, avg(ln(greatest(sqrt(power(a.a - b.a, 2) + power(a.b - b.b, 2) + power(a.c - b.c, 2)), 1E-10) / greatest(l.d, 1E-10)) / l.k) AS v
    FROM later l JOIN {points} a ON a.run_id = l.run_id AND a.frame = l.ik JOIN {points} b ON b.run_id = l.run_id AND b.frame = l.jk
    GROUP BY l.run_id, l.i""",
    {"band": 100, "apart": 5, "steps": 10},
    doc="the nearest point of a band around each point, and how the two part; the band is an equi-join on shifted frames",
)
LYAPUNOV = Op("lyapunov", "SELECT run_id, med AS exponent FROM {median}", light=True)
ATTRACTOR_VOLUME = Op("attractor_volume", "SELECT run_id, count(*) / power(128.0E0, 3) AS volume, count(*) AS voxels FROM (SELECT DISTINCT p.run_id, CAST(floor(127 * (p.a - r.lo) / (r.hi - r.lo + 1E-12)) AS INT) AS x, CAST(floor(127 * (p.b - r.lo) / (r.hi - r.lo + 1E-12)) AS INT) AS y, CAST(floor(127 * (p.c - r.lo) / (r.hi - r.lo + 1E-12)) AS INT) AS z FROM {points} p JOIN (SELECT run_id, least(min(a), min(b), min(c)) AS lo, greatest(max(a), max(b), max(c)) AS hi FROM {points} GROUP BY run_id) r ON r.run_id = p.run_id) v GROUP BY run_id")
FRACTAL_MEASURE = Op("fractal_measure", "SELECT run_id, dimension / <m> AS measure FROM {dimension}", {"m": 3.0})
INFORMATION_DIMENSION = Op("information_dimension", """SELECT run_id, regr_slope(h, ln(k)) AS dimension FROM (SELECT run_id, k, -sum(n / total * ln(n / total)) AS h FROM (SELECT run_id, k, n, sum(n) OVER (PARTITION BY run_id, k) AS total FROM (SELECT p.run_id, k.k, CAST(floor(k.k * (p.v - r.lo) / (r.hi - r.lo + 1E-12)) AS INT) AS b, count(*) * 1.0E0 AS n
    FROM {series} p JOIN (SELECT run_id, min(v) AS lo, max(v) AS hi FROM {series} GROUP BY run_id) r ON r.run_id = p.run_id CROSS JOIN (SELECT 10 * k0.k0 AS k FROM (SELECT RANGE(1, 8)RANGE AS k0) k0 WHERE k0.k0 IN (1, 2, 4, 8)) k GROUP BY p.run_id, k.k, CAST(floor(k.k * (p.v - r.lo) / (r.hi - r.lo + 1E-12)) AS INT)) c) t GROUP BY run_id, k) e GROUP BY run_id""")
RECURRENCE = Function("recurrence", f"SELECT run_id, i, j FROM ({_ALL}) d WHERE d < <radius>", {"radius": 0.1}, run=neighbours.within, doc="by tiles; the check's form looks at all pairs")
FALSE_SHARES = Function(
    "false_shares",
    """
    WITH value AS (SELECT s.run_id, s.frame, d.tau, list(t.v ORDER BY k.k) AS x FROM {series} s JOIN {delays} d ON d.run_id = s.run_id CROSS JOIN (SELECT RANGE(0, <most>)RANGE AS k) k JOIN {series} t ON t.run_id = s.run_id AND t.frame = s.frame + k.k * d.tau GROUP BY s.run_id, s.frame, d.tau),
    pair AS (SELECT a.run_id, a.frame AS i, b.frame AS j, a.x AS x, b.x AS y, unnest(range(1, least(<most>, len(a.x), len(b.x)) + 1)) AS m FROM value a JOIN value b ON b.run_id = a.run_id AND b.frame <> a.frame),
    far AS (SELECT run_id, i, j, m, sqrt(list_sum(list_transform(range(1, m + 1), lambda k: power(x[k] - y[k], 2)))) AS d, abs(x[m + 1] - y[m + 1]) AS step FROM pair),
    near AS (SELECT run_id, i, m, arg_min(struct_pack(d := d, step := step), [round(d, 12), j]) AS e FROM far GROUP BY run_id, i, m),
    size AS (SELECT run_id, m, count(*) AS n FROM (SELECT run_id, unnest(range(1, least(<most>, len(x)) + 1)) AS m FROM value) v GROUP BY run_id, m)
    SELECT s.run_id, s.m, s.n, coalesce(sum(CASE WHEN e.d > 1E-10 AND e.step > <ratio> * e.d THEN 1.0E0 ELSE 0.0E0 END), 0) / s.n AS share FROM size s LEFT JOIN near q ON q.run_id = s.run_id AND q.m = s.m GROUP BY s.run_id, s.m, s.n""",
    {"most": 10, "ratio": 10.0},
    run=neighbours.false_shares,
    doc="of every dimension to `most`, at the run's own delay; neighbours by tiles, in the check's form by all pairs",
)
EMBEDDING = Op(
    "embedding",
    """
    WITH length AS (SELECT run_id, count(*) AS n FROM {series} GROUP BY run_id),
    room AS (SELECT l.run_id, d.tau, CAST(least(<most>, floor(l.n / (d.tau * 10.0E0))) AS INT) AS top FROM length l JOIN {delays} d ON d.run_id = l.run_id),
    tried AS (
        SELECT run_id, m, share, before_ FROM (
            SELECT s.run_id, s.m, s.share, r.top, s.n, lag(s.share) OVER (PARTITION BY s.run_id ORDER BY s.m) AS before_ FROM {shares} s JOIN room r ON r.run_id = s.run_id) t
        WHERE m <= top AND n >= <points>),
    chosen AS (
        SELECT run_id, min(CASE WHEN (share < 0.05E0 AND m >= 3) OR (before_ - share > 0.3E0 AND share < 0.1E0) THEN m END) AS early FROM tried GROUP BY run_id),
    least_ AS (SELECT run_id, m FROM (SELECT run_id, m, row_number() OVER (PARTITION BY run_id ORDER BY round(share, 12), m) AS r FROM tried) t WHERE r = 1)
    SELECT r.run_id, r.tau, CAST(CASE WHEN r.top < 2 OR l.m IS NULL THEN 3 ELSE coalesce(c.early, greatest(3, l.m)) END AS INT) AS m
    FROM room r LEFT JOIN chosen c ON c.run_id = r.run_id LEFT JOIN least_ l ON l.run_id = r.run_id""",
    {"most": 10, "points": 100},
    doc="the dimension: the first with hardly any false neighbours, or after a great fall of their share, else that of the smallest share, three at least",
)
RECURRENCE_LINES = """SELECT run_id, {key} AS line, count(*) AS len FROM (SELECT run_id, i, j, {at} - row_number() OVER (PARTITION BY run_id, {key} ORDER BY {at}) AS island FROM {{recurrence}}) x GROUP BY run_id, {key}, island"""
RQA = Op("rqa", f"""SELECT p.run_id, p.n / (t.n * (t.n - 1.0E0)) AS rate, d.det / p.n AS determinism, d.longest, d.h AS entropy, v.lam / p.n AS laminarity, v.trapping FROM (SELECT run_id, count(*) * 1.0E0 AS n FROM {{recurrence}} GROUP BY run_id) p JOIN (SELECT run_id, count(*) * 1.0E0 AS n FROM {{points}} GROUP BY run_id) t ON t.run_id = p.run_id
    JOIN (SELECT run_id, sum(CASE WHEN len >= 2 THEN len * k ELSE 0 END) * 1.0E0 AS det, max(len) AS longest, coalesce(-sum(CASE WHEN len >= 2 THEN k * 1.0E0 / kk * ln(k * 1.0E0 / kk) END), 0) AS h FROM (SELECT run_id, len, count(*) AS k, sum(CASE WHEN len >= 2 THEN count(*) ELSE 0 END) OVER (PARTITION BY run_id) AS kk FROM ({RECURRENCE_LINES.format(key='j - i', at='i').replace('{{', '{').replace('}}', '}')}) l GROUP BY run_id, len) m GROUP BY run_id) d ON d.run_id = p.run_id
    JOIN (SELECT run_id, sum(CASE WHEN len >= 2 THEN len ELSE 0 END) * 1.0E0 AS lam, avg(CASE WHEN len >= 2 THEN len * 1.0E0 END) AS trapping FROM ({RECURRENCE_LINES.format(key='i', at='j').replace('{{', '{').replace('}}', '}')}) l GROUP BY run_id) v ON v.run_id = p.run_id""", doc="lines are islands: diagonals over j - i, verticals over i")
_AXES = ("a", "b", "c")


def _square(form: str) -> str:
    """The sum over the embedded axes of the squared form; $ stands for the axis."""
    return " + ".join(f"power({form.replace('$', x)}, 2)" for x in _AXES)


def _absolute(form: str) -> str:
    return " + ".join(f"abs({form.replace('$', x)})" for x in _AXES)


#: Points with the one before (p), after (n) and the one after that (m).
NEIGHBOURS = Op(
    "phase_neighbours",
    f"""
    SELECT run_id, frame, a, b, c, {", ".join(f"lag({x}) OVER w AS p{x}, lead({x}) OVER w AS n{x}, lead({x}, 2) OVER w AS m{x}" for x in _AXES)}, own
    FROM {{points}} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame)""",
    halo=("points", "2"),
)
TRAJECTORY_ANOMALY = Op(
    "trajectory_anomaly",
    f"""
    SELECT p.run_id, p.frame, k.mean_distance + 0.2E0 * (p.vel + p.acc + p.curv) AS score
    FROM (
        SELECT run_id, frame, sqrt({_square("n$ - $")}) AS vel, sqrt({_square("n$ - 2 * $ + p$")}) AS acc,
            CASE WHEN {_square("n$ - $")} > 1E-10
                THEN sqrt(greatest(({_square("n$ - $")}) * ({_square("n$ - 2 * $ + p$")}) - power({" + ".join(f"(n{x} - {x}) * (n{x} - 2 * {x} + p{x})" for x in _AXES)}, 2), 0)) / power({_square("n$ - $")}, 1.5) ELSE 0 END AS curv
        FROM {{neighbours}} WHERE own AND pa IS NOT NULL AND na IS NOT NULL) p
    JOIN {{knn}} k ON k.run_id = p.run_id AND k.frame = p.frame""",
    doc="speed, acceleration and curvature of the path over all embedded axes",
)
DYNAMICS = Op(
    "dynamics",
    f"""
    SELECT run_id, sum(bend) / count(*) AS chaos, 1 / (1 + sum(error) / count(*)) AS predictability, sum(spread) / count(*) AS complexity, sum(entropy) / count(*) AS entropy_rate, 1 / (1 + sum(wobble) / count(*)) AS stability
    FROM (
        SELECT run_id,
            CASE WHEN ma IS NOT NULL THEN {_absolute("m$ - 2 * n$ + $")} ELSE 0 END AS bend,
            CASE WHEN ma IS NOT NULL THEN sqrt({_square("2 * n$ - $ - m$")}) ELSE 0 END AS error,
            CASE WHEN ma IS NOT NULL AND pa IS NOT NULL THEN sqrt({_square("$ - (p$ + $ + n$) / 3")}) ELSE 0 END AS spread,
            CASE WHEN ma IS NOT NULL THEN {" + ".join(f"CASE WHEN abs(n{x} - {x}) > 1E-10 THEN -abs(n{x} - {x}) * ln(abs(n{x} - {x})) ELSE 0 END" for x in _AXES)} ELSE 0 END AS entropy,
            CASE WHEN ma IS NOT NULL AND frame < last - 2 THEN {_absolute("m$ - 2 * n$ + $")} ELSE 0 END AS wobble
        FROM {{neighbours}} JOIN (SELECT run_id AS r, max(frame) AS last FROM {{neighbours}} GROUP BY run_id) e ON e.r = run_id WHERE own) s
    GROUP BY run_id""",
    doc="second differences, prediction errors, spread of three points and step entropies of the embedded path, as means over its points",
)
PHASE_RISK = Op(
    "phase_risk",
    """
    SELECT run_id, 0.5E0 * greatest(0.0E0, least(1.0E0, attractor)) + 0.5E0 * greatest(0.0E0, least(1.0E0, recurrence)) AS risk
    FROM (
        SELECT c.run_id,
            CASE WHEN abs(l.exponent) > 0.1E0 THEN 0.3E0 ELSE 0 END + abs(f.measure - 0.5E0) * 0.2E0 + CASE WHEN c.dimension < 1 OR c.dimension > 3 THEN 0.2E0 ELSE 0 END + abs(c.dimension - i.dimension) * 0.1E0 AS attractor,
            CASE WHEN r.determinism < 0.7E0 THEN (1 - r.determinism) * 0.3E0 ELSE 0 END + CASE WHEN r.entropy > 2 THEN least(r.entropy / 5, 0.3E0) ELSE 0 END
                + CASE WHEN r.laminarity < 0.5E0 THEN (1 - r.laminarity) * 0.2E0 ELSE 0 END + CASE WHEN r.trapping > 10 THEN 0.2E0 ELSE 0 END AS recurrence
        FROM {dimension} c JOIN {lyapunov} l ON l.run_id = c.run_id JOIN {fractal} f ON f.run_id = c.run_id JOIN {information} i ON i.run_id = c.run_id JOIN {rqa} r ON r.run_id = c.run_id) x""",
    doc="how odd the attractor and its recurrences are, 0 to 1",
)
INTEGRATED = Op(
    "integrated",
    """
    SELECT s.run_id, s.frame, (0.7E0 * s.score + 0.3E0 * r.risk - m.mean) / (m.sd + 1E-10) AS score
    FROM {trajectory} s JOIN {risk} r ON r.run_id = s.run_id
    JOIN (SELECT s.run_id, avg(0.7E0 * s.score + 0.3E0 * r.risk) AS mean, stddev_pop(0.7E0 * s.score + 0.3E0 * r.risk) AS sd FROM {trajectory} s JOIN {risk} r ON r.run_id = s.run_id GROUP BY s.run_id) m ON m.run_id = s.run_id""",
)
DFT_POWER = Op(
    "dft_power",
    """
    SELECT f.run_id, k.k, power(sum((f.v - k.m) * cos(2 * pi() * k.k * f.frame / k.n)), 2) + power(sum((f.v - k.m) * sin(2 * pi() * k.k * f.frame / k.n)), 2) AS power
    FROM {series} f JOIN (SELECT run_id, m, n, RANGE(1, CAST(floor(n / 2) AS INT))RANGE AS k FROM (SELECT run_id, avg(v) AS m, count(*) AS n FROM {series} GROUP BY run_id) c) k ON k.run_id = f.run_id
    GROUP BY f.run_id, k.k""",
    doc="power of every frequency as plain sums; n^2 / 2 products a run, for runs of some thousand frames (long ones go by FFT, see periodicity)",
)
PERIODIC = Op(
    "periodic",
    """
    SELECT run_id, k AS frequency, power / m AS strength, 1 / (1 + exp(5 - power / m)) AS score
    FROM (SELECT run_id, k, power, avg(power) OVER (PARTITION BY run_id) AS m, row_number() OVER (PARTITION BY run_id ORDER BY round(power, 6) DESC, k) AS r FROM {power}) p WHERE r = 1""",
    doc="a run has n / 2 frequencies",
)
GRADUAL = Op("gradual", "SELECT g.run_id, g.frame, CASE WHEN s.sd > 1E-10 THEN abs(g.g - s.m) / s.sd ELSE 0 END AS z FROM {gradient} g JOIN (SELECT run_id, avg(g) AS m, stddev_pop(g) AS sd FROM {gradient} GROUP BY run_id) s ON s.run_id = g.run_id")
DRIFT_WINDOW = Op("drift_window", """SELECT run_id, frame, avg(d) OVER (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN <h> PRECEDING AND <h1> FOLLOWING) AS drift, own FROM (SELECT s.run_id, s.frame, s.blk, s.own, abs(s.v - r.ref) / (abs(r.ref) + 1E-10) AS d FROM {series} s JOIN (SELECT run_id, avg(v) AS ref FROM {series} WHERE own AND frame < <reference> GROUP BY run_id) r ON r.run_id = s.run_id) x""", {"h": 25, "h1": 24, "reference": 100}, halo=("series", "h"))
DRIFT_EXTENDED = Op("drift_extended", "SELECT run_id, frame, drift FROM {x} WHERE own")
CONTRACTION = Op("contraction", "SELECT g.run_id, g.frame, CASE WHEN g.g < 0 THEN 2 ELSE 1 END * abs(g.g) / (r.mean + 1E-10) AS score FROM {gradient} g JOIN {rolling} r ON r.run_id = g.run_id AND r.frame = g.frame")
