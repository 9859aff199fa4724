"""Displacement flow and windowed structure of a centre's path. `path` is (run_id, frame, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandflow.operators.windows import window_moments
from strandflow.plans.op import Function, Op

FLOW = Op("flow", """SELECT run_id, frame, lf_x, lf_y, lf_z, sqrt(lf_x * lf_x + lf_y * lf_y + lf_z * lf_z) AS lf_mag FROM (
    SELECT run_id, frame, own, (lead(x) OVER w) - x AS lf_x, (lead(y) OVER w) - y AS lf_y, (lead(z) OVER w) - z AS lf_z FROM {path} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame)) f
    WHERE own AND lf_x IS NOT NULL""", halo=("path", "1"))
ACCELERATION = Op("acceleration", """SELECT run_id, frame, ax, ay, az, sqrt(ax * ax + ay * ay + az * az) AS lff_mag FROM (
    SELECT run_id, frame, own, (lead(lf_x) OVER w) - lf_x AS ax, (lead(lf_y) OVER w) - lf_y AS ay, (lead(lf_z) OVER w) - lf_z AS az FROM {flow} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame)) f
    WHERE own AND ax IS NOT NULL""", halo=("flow", "1"))


def tension(path: DataFrame, w: int, block: int | None = None) -> DataFrame:
    return window_moments(path, ("run_id",), ("x", "y", "z"), w, w, block).selectExpr("run_id", "frame", "var_x + var_y + var_z AS rho_t")


TENSION = Function("tension", """SELECT run_id, frame, rho_t FROM (SELECT run_id, frame, own, var_pop(x) OVER w + var_pop(y) OVER w + var_pop(z) OVER w AS rho_t
    FROM {path} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN <w> PRECEDING AND <w> FOLLOWING)) f WHERE own""", {"w": 50}, halo=("path", "w"), run=tension)
ROTATION = Op("rotation", """SELECT run_id, frame, CASE WHEN px IS NULL OR m < 1E-10 OR pm < 1E-10 THEN 0 ELSE
      CASE WHEN px * lf_y - py * lf_x >= 0 THEN 1 ELSE -1 END * acos(greatest(-1.0E0, least(1.0E0, (px * lf_x + py * lf_y + pz * lf_z) / (m * pm)))) / (2 * pi()) END AS q FROM (
    SELECT run_id, frame, own, lf_x, lf_y, lf_z, lf_mag AS m, lag(lf_x) OVER w AS px, lag(lf_y) OVER w AS py, lag(lf_z) OVER w AS pz, lag(lf_mag) OVER w AS pm
    FROM {flow} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame)) f WHERE own""", halo=("flow", "1"))
CUMULATIVE_ROTATION = Op("cumulative_rotation", """SELECT q.run_id, q.frame, q.q, coalesce(b.before_, 0) + sum(q.q) OVER (PARTITION BY q.run_id, q.part ORDER BY q.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q_cum
    FROM (SELECT *, floor(frame / 10000) AS part FROM {rotation}) q JOIN (SELECT run_id, part, sum(s) OVER (PARTITION BY run_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_
      FROM (SELECT run_id, floor(frame / 10000) AS part, sum(q) AS s FROM {rotation} GROUP BY 1, 2) p) b ON b.run_id = q.run_id AND b.part = q.part""", doc="prefix sums in two levels: blocks, then within a block")


def synchrony(pair: DataFrame, w: int, block: int | None = None) -> DataFrame:
    held = window_moments(pair, ("run_id",), ("rmsd", "rg"), w, w, block, together=True)
    return held.selectExpr("run_id", "frame", "CASE WHEN sqrt(var_rmsd) > 1E-10 AND sqrt(var_rg) > 1E-10 THEN abs(cov / (sqrt(var_rmsd) * sqrt(var_rg))) ELSE 0 END AS sigma_s")


SYNCHRONY = Function("synchrony", """SELECT run_id, frame, CASE WHEN sa > 1E-10 AND sb > 1E-10 THEN abs(c / (sa * sb)) ELSE 0 END AS sigma_s FROM (
    SELECT run_id, frame, own, stddev_pop(rmsd) OVER w AS sa, stddev_pop(rg) OVER w AS sb, covar_pop(rmsd, rg) OVER w AS c
    FROM {pair} WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN <w> PRECEDING AND <w> FOLLOWING)) f WHERE own""", {"w": 50}, halo=("pair", "w"), run=synchrony)
RMSD_RG = Op("rmsd_rg", "SELECT a.run_id, a.frame, a.rmsd, b.rg FROM {rmsd} a JOIN {rg} b ON b.run_id = a.run_id AND b.frame = a.frame")
COHERENCE = Op("coherence", """SELECT f.run_id, f.frame, CASE WHEN f.frame >= <w> AND f.frame < n.n - <w> AND k > 0 AND sqrt(mx * mx + my * my + mz * mz) > 1E-10
      THEN (ux * mx + uy * my + uz * mz) / (sqrt(mx * mx + my * my + mz * mz) * k) ELSE <default> END AS coherence FROM (
    SELECT run_id, frame, own, count(u) OVER w AS k, avg(lf_x) OVER w AS mx, avg(lf_y) OVER w AS my, avg(lf_z) OVER w AS mz, sum(lf_x / u) OVER w AS ux, sum(lf_y / u) OVER w AS uy, sum(lf_z / u) OVER w AS uz
    FROM (SELECT *, CASE WHEN lf_mag > 1E-10 THEN lf_mag END AS u FROM {flow}) v WINDOW w AS (PARTITION BY run_id, blk ORDER BY frame ROWS BETWEEN <w> PRECEDING AND <w1> FOLLOWING)) f
    JOIN (SELECT run_id, max(frame) + 1 AS n FROM {flow} GROUP BY run_id) n ON n.run_id = f.run_id WHERE own""", {"w": 50, "w1": 49, "default": 0.0}, halo=("flow", "w"), doc="sum of cosines to the mean direction by algebra: no second pass over a window")
ADAPTIVE_WINDOWS = Op("adaptive_windows", """SELECT run_id, CAST(n AS INT) AS n_frames, scale, CAST(greatest(10, least(floor(b * scale), floor(n / 4))) AS INT) AS tension, CAST(greatest(3, least(floor(b * scale / 2), floor(n / 8))) AS INT) AS fast,
      CAST(greatest(10, least(floor(b * scale * 2), floor(n / 2))) AS INT) AS slow FROM (
    SELECT r.run_id, n, least(100, floor(n / 10)) AS b, CASE WHEN rv > 0.2 THEN 0.7E0 WHEN rv < 0.05 THEN 1.5E0 ELSE 1.0E0 END * CASE WHEN fv > 1.0 THEN 0.8E0 WHEN fv < 0.3 THEN 1.3E0 ELSE 1.0E0 END AS scale FROM
    (SELECT run_id, count(*) AS n, CASE WHEN avg(rmsd) > 1E-10 THEN stddev_pop(rmsd) / avg(rmsd) ELSE 0 END AS rv FROM {rmsd} GROUP BY run_id) r JOIN
    (SELECT run_id, CASE WHEN avg(lf_mag) > 1E-10 THEN stddev_pop(lf_mag) / avg(lf_mag) ELSE 0 END AS fv FROM {flow} GROUP BY run_id) f ON f.run_id = r.run_id) s""")
FIXED_WINDOWS = Op("fixed_windows", """SELECT run_id, least(<most>, CAST(floor(n / 10) AS INT)) AS primary_w, greatest(1, CAST(floor(least(<most>, floor(n / 10)) / 2) AS INT)) AS fast_w, CAST(least(<most>, floor(n / 10)) * 2 AS INT) AS slow_w
    FROM (SELECT run_id, count(*) AS n FROM {rmsd} GROUP BY run_id) c""", {"most": 100})
GROUP_FLOW = Op("group_flow", """SELECT run_id, kind, group_id, frame, fx, fy, fz, sqrt(fx * fx + fy * fy + fz * fz) AS lf_mag FROM (
    SELECT run_id, kind, group_id, frame, own, coalesce(x - lag(x) OVER w, 0) AS fx, coalesce(y - lag(y) OVER w, 0) AS fy, coalesce(z - lag(z) OVER w, 0) AS fz
    FROM {centres} WINDOW w AS (PARTITION BY run_id, kind, group_id, blk ORDER BY frame)) f WHERE own""", halo=("centres", "1"))


def group_tension(centres: DataFrame, h: int, block: int | None = None) -> DataFrame:
    return window_moments(centres, ("run_id", "kind", "group_id"), ("x", "y", "z"), h, h, block).selectExpr("run_id", "kind", "group_id", "frame", "var_x + var_y + var_z AS rho_t")


GROUP_TENSION = Function("group_tension", """SELECT run_id, kind, group_id, frame, rho_t FROM (SELECT run_id, kind, group_id, frame, own, var_pop(x) OVER w + var_pop(y) OVER w + var_pop(z) OVER w AS rho_t
    FROM {centres} WINDOW w AS (PARTITION BY run_id, kind, group_id, blk ORDER BY frame ROWS BETWEEN <h> PRECEDING AND <h> FOLLOWING)) f WHERE own""", {"h": 25}, halo=("centres", "h"), run=group_tension)
RESIDUE_COUPLING = Op("residue_coupling", "SELECT run_id, frame, i, j, 1 / (1 + d) AS coupling FROM {distances}")
CLUSTER_COUPLING = Op("cluster_coupling", "SELECT run_id, frame, i, j, exp(-d / <scale>) AS coupling FROM {distances}", {"scale": 5.0})
