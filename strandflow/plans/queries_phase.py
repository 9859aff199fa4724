"""Queries on phase space and extended detectors, and those of the sequential operators (which no SQL expresses)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators import detect as dt
from strandflow.operators import ordered as o
from strandflow.operators import phase as p
from strandflow.operators import sequential as q
from strandflow.operators import series as s
from strandflow.operators import spectrum
from strandflow.operators.quantiles import MEDIAN
from strandflow.plans import queries_core as c
from strandflow.plans import queries_detect as d
from strandflow.plans import queries_network as n
from strandflow.plans.op import Op, Plan
from strandflow.plans.query import Query, tables
from strandflow.sources.adapters import HOURLY, TRAJ

#: Distances, radii and thresholds are those of a series of mean 0 and deviation 1.
SERIES = d.as_series(Plan(s.Z_NORMALISE, {"series": HOURLY}), "z")
POINTS = Plan(p.EMBED, {"series": SERIES})
MI = Plan(p.MUTUAL_INFORMATION, {"series": SERIES})
DIST = Plan(p.DISTANCES, {"points": POINTS})
KNN = Plan(p.KNN, {"points": POINTS})
CDIM = Plan(p.CORRELATION_DIMENSION, {"distances": DIST})
REC = Plan(p.RECURRENCE, {"points": POINTS})
DELAY = Plan(p.BEST_DELAY, {"mi": MI})
SHARES = Plan(p.FALSE_SHARES, {"series": SERIES, "delays": DELAY})
RQA = Plan(p.RQA, {"recurrence": REC, "points": POINTS})
NEXT = Plan(p.NEIGHBOURS, {"points": POINTS})
DYN = Plan(p.DYNAMICS, {"neighbours": NEXT})
LYAP = Plan(p.LYAPUNOV, {"median": Plan(MEDIAN, {"series": Plan(p.LYAPUNOV_RATES, {"points": POINTS})})})
MEASURE = Plan(p.FRACTAL_MEASURE, {"dimension": CDIM})
INFO = Plan(p.INFORMATION_DIMENSION, {"series": SERIES})
PATH = Plan(p.TRAJECTORY_ANOMALY, {"neighbours": NEXT, "knn": KNN})
RISK = Plan(p.PHASE_RISK, {"dimension": CDIM, "lyapunov": LYAP, "fractal": MEASURE, "information": INFO, "rqa": RQA})
POWER = Plan(p.DFT_POWER, {"series": SERIES})
SMOOTH = Plan(s.GAUSSIAN_SMOOTH, {"series": SERIES})

QUERIES_ = {
    "phs1_embed": Query(POINTS, "run_id frame ~a ~b ~c"),
    "phs2_mutual_information": Query(MI, "run_id lag ~mi"),
    "phs2_best_delay": Query(DELAY, "run_id tau"),
    "phs3_false_shares": Query(SHARES, "run_id m n ~share"),
    "phs3_dimension": Query(Plan(p.EMBEDDING, {"series": SERIES, "delays": DELAY, "shares": SHARES}), "run_id tau m"),
    "phs3_false_neighbours": Query(Plan(p.FALSE_NEIGHBOURS, {"points": POINTS}), "run_id ~share"),
    "phs4_correlation_dimension": Query(CDIM, "run_id ~dimension"),
    "phs5_lyapunov": Query(LYAP, "run_id ~exponent"),
    "phs6_attractor_volume": Query(Plan(p.ATTRACTOR_VOLUME, {"points": POINTS}), "run_id ~volume voxels", digits=9),
    "phs7_fractal_measure": Query(MEASURE, "run_id ~measure"),
    "phs8_information_dimension": Query(INFO, "run_id ~dimension"),
    "phs9_recurrence": Query(REC, "run_id i j"),
    "phs10_rqa": Query(RQA, "run_id ~rate ~determinism longest ~entropy ~laminarity ~trapping"),
    "phs11_trajectory_anomaly": Query(PATH, "run_id frame ~score"),
    "phs12_dynamics": Query(DYN, "run_id ~chaos ~predictability ~complexity ~entropy_rate ~stability"),
    "phs13_periodic": Query(Plan(p.PERIODIC, {"power": POWER}), "run_id frequency ~strength ~score"),
    "phs14_risk": Query(RISK, "run_id ~risk"),
    "phs14_integrated": Query(Plan(p.INTEGRATED, {"trajectory": PATH, "risk": RISK}), "run_id frame ~score"),
    "ext1_dft_power": Query(POWER, "run_id k ~power", digits=3),
    "ext2_gradual": Query(Plan(p.GRADUAL, {"gradient": Plan(s.GRADIENT, {"series": SMOOTH})}), "run_id frame ~z"),
    "ext3_drift": Query(Plan(p.DRIFT_EXTENDED, {"x": Plan(p.DRIFT_WINDOW, {"series": d.RHO})}), "run_id frame ~drift"),
    "ext4_contraction": Query(Plan(p.CONTRACTION, {"gradient": Plan(s.GRADIENT, {"series": d.RG}), "rolling": Plan(s.ROLLING, {"series": d.RG})}), "run_id frame ~score"),
    "cau5_granger": Query(Plan(o.granger(2), {"lagged": Plan(o.lagged(2), {"series": d.GROUP_ANOM})}), "i j ~f", digits=4),
    "ext5_knn_anomaly": Query(Plan(p.KNN_ANOMALY, {"knn": KNN}), "run_id frame ~z"),
}


def bnd6_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.peaks(d.CAND.spark(spark, sf_dir))


RISES = Plan(Op("rises", "SELECT run_id, frame, v FROM {x} WHERE v > high"), {"x": Plan(dt.PEAK_CANDIDATES, {"series": HOURLY})})


def bnd7_simple_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.left_to_right(RISES.spark(spark, sf_dir), distance=5)


def bnd1_box_fractal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the tension and of every type's hourly means."""
    both = d.RHO.spark(spark, sf_dir).unionByName(HOURLY.read(spark, sf_dir).select("run_id", "frame", "v"))
    return o.box_fractal(both).withColumn("fd", F.round("fd", 5))


def ext1_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.periodicity(HOURLY.read(spark, sf_dir)).withColumn("amplitude", F.round("amplitude", 4))


def prj10_greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.greedy_clusters(TRAJ.read(spark, sf_dir).where("frame = 0"), least=4, most=5)


def net13_strongest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.strongest_path(n.LINKS.spark(spark, sf_dir), "0")


def grp4_group_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five peaks of each group, in frame order."""
    from pyspark.sql import Window

    found = q.peaks(Plan(dt.PEAK_CANDIDATES, {"series": d.GROUP_ANOM}).spark(spark, sf_dir), least_distance=5)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("frame"))).where("place <= 5")


QUERIES, ORACLES = tables(QUERIES_)
QUERIES |= {f.__name__: f for f in (bnd1_box_fractal, bnd6_peaks, bnd7_simple_peaks, ext1_periodicity, prj10_greedy_clusters, net13_strongest_path, grp4_group_peaks)}

ORACLES["bnd7_simple_peaks"] = f"""
SELECT run_id, unnest(kept).f::INT AS frame, unnest(kept).v AS v FROM (SELECT run_id, list_reduce(list_prepend(CAST([] AS STRUCT(f BIGINT, v DOUBLE)[]), list([{{'f': frame::BIGINT, 'v': v}}] ORDER BY frame)),
  lambda a, x: CASE WHEN len(a) > 0 AND x[1].f - a[-1].f < 5 THEN a ELSE list_concat(a, x) END) AS kept FROM ({RISES.statement()}) GROUP BY run_id)"""
ORACLES["bnd1_box_fractal"] = f"""
WITH s AS (SELECT run_id, frame, v FROM ({d.RHO.statement()}) UNION ALL SELECT run_id, frame, v FROM ({HOURLY.sql})),
w AS (SELECT run_id, frame, list(v) OVER (PARTITION BY run_id ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS x FROM s),
b AS (SELECT *, list_min(x) AS lo, list_max(x) - list_min(x) AS span, list_transform(range(2, 11), lambda k: 1 + len(list_filter(range(2, len(x) + 1), lambda t: floor((x[t] - list_min(x)) / ((list_max(x) - list_min(x)) / k) + 1e-9) <> floor((x[t - 1] - list_min(x)) / ((list_max(x) - list_min(x)) / k) + 1e-9)))) AS n FROM w)
SELECT run_id, frame, CASE WHEN span < 1e-10 THEN 1.0 ELSE round(greatest(1, least(3, -list_sum(list_transform(n, lambda c: ln(c))) / list_sum(list_transform(range(2, 11), lambda k: ln(span / k))))), 5) END AS fd FROM b"""
ORACLES["ext1_periodicity"] = f"""
WITH s AS MATERIALIZED (SELECT run_id, frame, v - avg(v) OVER (PARTITION BY run_id) AS v, count(*) OVER (PARTITION BY run_id) AS n FROM ({HOURLY.sql})),
a AS MATERIALIZED (SELECT run_id, k, sqrt(power(sum(v * cos(2 * pi() * k * frame / n)), 2) + power(sum(v * sin(2 * pi() * k * frame / n)), 2)) AS amp FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM s) GROUP BY ALL),
m AS (SELECT run_id, median(amp) AS mid FROM a GROUP BY run_id),
l AS (SELECT run_id, any_value(mid) + 3 * median(abs(amp - mid)) AS line FROM a JOIN m USING (run_id) GROUP BY run_id),
p AS (SELECT run_id, k, amp FROM (SELECT *, lag(amp) OVER w AS b, lead(amp) OVER w AS c FROM a WINDOW w AS (PARTITION BY run_id ORDER BY k)) JOIN l USING (run_id) WHERE amp > line AND amp > b AND amp > c)
SELECT run_id, unnest(kept).k::INT AS frequency, round(unnest(kept).amp, 4) AS amplitude FROM (SELECT run_id, list_reduce(list_prepend(CAST([] AS STRUCT(k BIGINT, amp DOUBLE)[]), list([{{'k': k::BIGINT, 'amp': amp}}] ORDER BY amp DESC, k)),
  lambda x, y: CASE WHEN len(list_filter(x, lambda z: abs(z.k - y[1].k) < 5)) > 0 THEN x ELSE list_concat(x, y) END) AS kept FROM p GROUP BY run_id)"""
