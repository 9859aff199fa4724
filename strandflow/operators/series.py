"""Generic operators on series (run_id, frame, v): gradients, windows, filters and normalisation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators.windows import window_filter, window_moments
from strandflow.plans.op import Function, Op

GRADIENT = Op("gradient", """SELECT run_id, frame, CASE WHEN p IS NULL AND n IS NULL THEN 0.0E0 WHEN p IS NULL THEN n - v WHEN n IS NULL THEN v - p ELSE (n - p) / 2 END AS g FROM (
    SELECT run_id, frame, own, v, lag(v) OVER w AS p, lead(v) OVER w AS n FROM {series} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame)) f WHERE own""", halo=("series", "1"))
COVARIANCE_MATRIX = Op("covariance_matrix", """SELECT a.run_id AS i, b.run_id AS j, covar_samp(a.v, b.v) AS cov,
    CASE WHEN stddev_pop(a.v) > 1E-10 AND stddev_pop(b.v) > 1E-10 THEN covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) ELSE 0 END AS corr
    FROM {series} a JOIN {series} b ON b.frame = a.frame AND a.run_id <= b.run_id GROUP BY a.run_id, b.run_id""")
SLIDING = Op("sliding", """SELECT run_id, frame, mean, std, var, mx, mn, total FROM (SELECT run_id, frame, own, count(*) OVER w AS k, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS std, var_pop(v) OVER w AS var, max(v) OVER w AS mx, min(v) OVER w AS mn, sum(v) OVER w AS total
    FROM {series} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN CURRENT ROW AND <w1> FOLLOWING)) f WHERE own AND k = <w1> + 1 AND frame % <step> = 0""", {"w1": 23, "step": 1}, halo=("series", "w1"), doc="forward windows [i, i + w), valid ones only")
SLIDING_MEDIAN = Op("sliding_median", """SELECT run_id, frame, med FROM (SELECT run_id, frame, own, count(*) OVER w AS k, PCT(v, 0.5) OVER w AS med
    FROM {series} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN CURRENT ROW AND <w1> FOLLOWING)) f WHERE own AND k = <w1> + 1""", {"w1": 23}, halo=("series", "w1"))


def rolling(series: DataFrame, w: int, block: int | None = None) -> DataFrame:
    return window_moments(series, ("run_id",), ("v",), w, w, block).selectExpr("run_id", "frame", "m_v AS mean", "sqrt(var_v) AS std")


ROLLING = Function("rolling", """SELECT run_id, frame, mean, std FROM (SELECT run_id, frame, own, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS std
    FROM {series} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN <w> PRECEDING AND <w> FOLLOWING)) f WHERE own""", {"w": 12}, halo=("series", "w"), run=rolling)
LOCAL_STD = ROLLING
EDGE_PADDED = """SELECT s.run_id, s.frame, k.k, coalesce(t.v, CASE WHEN s.frame + k.k < 0 THEN e.first_v ELSE e.last_v END) AS v
    FROM {series} s CROSS JOIN (SELECT RANGE(-<reach>, <reach>)RANGE AS k) k LEFT JOIN {series} t ON t.run_id = s.run_id AND t.frame = s.frame + k.k
    JOIN (SELECT run_id, min_by(v, frame) AS first_v, max_by(v, frame) AS last_v FROM {series} GROUP BY run_id) e ON e.run_id = s.run_id"""
MOVING_AVERAGE = Op("moving_average", f"SELECT run_id, frame, sum(CASE WHEN k < <reach> THEN v ELSE 0 END) / (2 * <reach>) AS mean FROM ({EDGE_PADDED}) p GROUP BY run_id, frame", {"reach": 12}, doc="window of 2 x reach, edge padded")
GAUSSIAN_SMOOTH = Op("gaussian_smooth", f"SELECT run_id, frame, sum(v * exp(-k * k / (2.0E0 * <sigma> * <sigma>))) / sum(exp(-k * k / (2.0E0 * <sigma> * <sigma>))) AS v FROM ({EDGE_PADDED}) p GROUP BY run_id, frame", {"sigma": 4.0, "reach": 12}, doc="edge padded, width 6 sigma + 1")


def gaussian_filter(series: DataFrame, sigma: float, reach: int, block: int | None = None) -> DataFrame:
    """(run_id, frame, v): a block's frames as one array, with the mirror images of the frames near the run's ends as rows of their own."""
    n = series.groupBy("run_id").agg((F.max("frame") + 1).alias("n"))
    places = F.expr(f"filter(array(frame, if(frame < {reach}, -1 - frame, null), if(frame >= n - {reach}, 2 * n - 1 - frame, null)), f -> f is not null)")
    seen = series.select("run_id", "frame", "v").join(n, "run_id").select("run_id", "v", "n", F.explode(places).alias("frame"))
    k = np.arange(-reach, reach + 1)
    return window_filter(seen, np.exp(-k * k / (2.0 * sigma * sigma)), block)


GAUSSIAN_FILTER = Function("gaussian_filter", """SELECT s.run_id, s.frame, sum(t.v * exp(-k.k * k.k / (2.0E0 * <sigma> * <sigma>))) / sum(exp(-k.k * k.k / (2.0E0 * <sigma> * <sigma>))) AS v
    FROM {series} s CROSS JOIN (SELECT RANGE(-<reach>, <reach>)RANGE AS k) k JOIN (SELECT run_id, max(frame) + 1 AS n FROM {series} GROUP BY run_id) c ON c.run_id = s.run_id
    JOIN {series} t ON t.run_id = s.run_id AND t.frame = CASE WHEN s.frame + k.k < 0 THEN -1 - s.frame - k.k WHEN s.frame + k.k >= c.n THEN 2 * c.n - 1 - s.frame - k.k ELSE s.frame + k.k END
    GROUP BY s.run_id, s.frame""", {"sigma": 4.0, "reach": 16}, run=gaussian_filter, doc="reflected edges, cut at four sigma; series longer than the reach")
CONVOLVE = Op("convolve", """SELECT run_id, frame, c FROM (SELECT run_id, frame, own, (lag(v) OVER w) * <k0> + v * <k1> + (lead(v) OVER w) * <k2> AS c FROM {series} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame)) f
    WHERE own AND c IS NOT NULL""", {"k0": 0.25, "k1": 0.5, "k2": 0.25}, halo=("series", "1"), doc="valid part of a three-point convolution")
CONVOLVE_2D = Op(
    "convolve_2d",
    """
    SELECT a.run_id, a.i, a.j, sum(b.v * CASE WHEN a.di = 0 AND a.dj = 0 THEN 0.5E0 ELSE 0.0625E0 END) AS c, count(*) AS cells
    FROM (SELECT run_id, i, j, CAST(k % 3 - 1 AS INT) AS di, CAST(floor(k / 3) - 1 AS INT) AS dj FROM {grid} CROSS JOIN (SELECT RANGE(0, 8)RANGE AS k) k) a
    JOIN {grid} b ON b.run_id = a.run_id AND b.i = a.i + a.di AND b.j = a.j + a.dj GROUP BY a.run_id, a.i, a.j""",
    doc="3 x 3 kernel over every run's grid, cut at its edges; each cell meets its nine neighbours by equality",
)
Z_NORMALISE = Op("z_normalise", """SELECT s.run_id, s.frame, CASE WHEN c.sd < 1E-10 THEN coalesce(s.v, c.m) - c.m ELSE greatest(-5.0E0, least(5.0E0, (coalesce(s.v, c.m) - c.m) / c.sd)) END AS z
    FROM {series} s JOIN (SELECT run_id, avg(v) AS m, stddev_pop(v) AS sd FROM {series} GROUP BY run_id) c ON c.run_id = s.run_id""")


def local_z(series: DataFrame, w: int, block: int | None = None) -> DataFrame:
    return window_moments(series, ("run_id",), ("v",), w, w, block).selectExpr("run_id", "frame", "CASE WHEN sqrt(var_v) > 1E-10 THEN abs(v - m_v) / sqrt(var_v) ELSE 0 END AS z")


LOCAL_Z = Function("local_z", """SELECT run_id, frame, CASE WHEN sd > 1E-10 THEN abs(v - m) / sd ELSE 0 END AS z FROM (SELECT run_id, frame, own, v, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd
    FROM {series} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN <w> PRECEDING AND <w> FOLLOWING)) f WHERE own""", {"w": 50}, halo=("series", "w"), run=local_z)
TOTALS = Op(
    "totals",
    """
    SELECT q.run_id, q.frame, coalesce(b.before_, 0) + sum(q.v) OVER (PARTITION BY q.run_id, q.part ORDER BY q.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
    FROM (SELECT run_id, frame, v, floor(frame / 10000) AS part FROM {series}) q
    JOIN (SELECT run_id, part, sum(s) OVER (PARTITION BY run_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_
        FROM (SELECT run_id, floor(frame / 10000) AS part, sum(v) AS s FROM {series} GROUP BY 1, 2) p) b ON b.run_id = q.run_id AND b.part = q.part""",
    doc="prefix sums in two levels: blocks, then within a block",
)


def gaussian_reach(sigma: float, cut: float = 4.0) -> int:
    return int(math.floor(cut * sigma + 0.5))
