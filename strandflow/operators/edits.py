"""What events do to a material's series: stress edited event after event, scores, failure mode and extra strain.

`events` is (run_id, event_id, start_frame, end_frame, kind); kinds are told apart by the words in them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.plans.op import Function, Op

STRESS = Op(
    "ramberg_stress",
    """
    SELECT run_id, frame, CASE WHEN eps <= eps_y THEN e_gpa * eps WHEN eps - eps_y > 1E-6 THEN least(ultimate_gpa, yield_gpa + 1.1E0 * ultimate_gpa * power(eps - eps_y, <n>)) ELSE least(ultimate_gpa, yield_gpa) END AS v
    FROM (SELECT s.run_id, s.frame, s.v * <unit> AS eps, m.yield_gpa / m.e_gpa AS eps_y, m.* FROM {strain} s CROSS JOIN (SELECT e_gpa, yield_gpa, ultimate_gpa FROM {materials} WHERE code = '<code>') m) x""",
    {"code": "SUJ2", "n": 0.2, "unit": 1.0},
    doc="linear to the yield strain, then yield + 1.1 ultimate (plastic strain)^n, at most the ultimate stress",
)


def edited(stress: DataFrame, events: DataFrame, modulus: float = 210.0, lattice: float = 2.87, fatigue: float = 0.7, hardening: float = 0.2) -> DataFrame:
    """(run_id, frame, v): the stress after all events in order of start and id.

    An event multiplies or raises the stress of its frames, or of all from its start on. Between two bounds of events all frames get
    the same edits, so a segment's edits are one step v -> m v + c, and its frames' sum and number tell what an event that asks
    for a mean needs. One sweep over the events makes the segments' steps; it sees events and segments, never frames.
    """
    e = events.select("run_id", F.col("start_frame").cast("long").alias("start"), (F.col("end_frame") + 1).cast("long").alias("end"), "event_id", "kind")
    span = stress.groupBy("run_id").agg(F.min("frame").cast("long").alias("lo"), (F.max("frame") + 1).cast("long").alias("hi"))
    cuts = e.select("run_id", F.explode(F.array("start", "end")).alias("at")).join(span, "run_id").where("at > lo and at < hi").select("run_id", "at")
    bounds = cuts.unionByName(span.select("run_id", F.col("lo").alias("at"))).unionByName(span.select("run_id", F.col("hi").alias("at"))).groupBy("run_id").agg(F.array_sort(F.collect_set("at")).alias("at"))
    segments = bounds.select("run_id", F.explode(F.expr("transform(sequence(1, size(at) - 1), k -> named_struct('a', at[k - 1], 'b', at[k]))")).alias("s")).select("run_id", "s.a", "s.b")
    frames = segments.select("run_id", "a", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("frame")).join(stress.withColumn("frame", F.col("frame").cast("long")), ["run_id", "frame"])
    sums = segments.join(frames.groupBy("run_id", "a").agg(F.sum("v").alias("total"), F.count("*").alias("n")), ["run_id", "a"], "left").na.fill(0)

    def sweep(s: pd.DataFrame, ev: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("a").reset_index(drop=True)
        m, c, hi = pd.Series(1.0, s.index), pd.Series(0.0, s.index), s["b"].max() if len(s) else 0
        whole = s["n"].sum()
        for r in ev.sort_values(["start", "event_id"]).itertuples():
            if r.start >= hi:
                continue
            end = min(r.end, hi)
            after, inside = s["a"] >= r.start, (s["a"] >= r.start) & (s["a"] < end)
            if "crack" in r.kind:
                m[after] *= (cut := 1 - min(0.5, (end - r.start) / 100))
                c[after] *= cut
            elif "plastic" in r.kind:
                m[inside] *= 1 + 0.02 * hardening
                c[inside] *= 1 + 0.02 * hardening
            elif "dislocation" in r.kind:
                c[inside] += 0.001 * modulus * lattice / max(1, end - r.start)
            elif "fatigue" in r.kind and (n := s["n"][inside].sum()) and (m * s["total"] + c * s["n"])[inside].sum() / n > fatigue:
                m[after] *= (cut := max(0.3, 1 - 0.1 * (end - r.start) / whole))
                c[after] *= cut
        return pd.DataFrame({"run_id": s["run_id"], "a": s["a"], "m": m, "c": c})

    own = e.select(*[F.col(c).alias(c) for c in e.columns])  # columns of their own: the sums stem from the events, too
    steps = sums.groupBy("run_id").cogroup(own.groupBy("run_id")).applyInPandas(sweep, "run_id string, a long, m double, c double")
    return frames.join(steps, ["run_id", "a"]).select("run_id", F.col("frame").cast("int").alias("frame"), (F.col("m") * F.col("v") + F.col("c")).alias("v"))


EDITED = Function(
    "edited_stress",
    """
    WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY start_frame, event_id) AS k FROM {events}),
    steps(run_id, k, v) AS (
        SELECT run_id, CAST(0 AS BIGINT), list(v ORDER BY frame) FROM {stress} GROUP BY run_id
        UNION ALL SELECT s.run_id, o.k, CASE
            WHEN o.kind LIKE '%crack%' THEN list_transform(s.v, lambda x, i: CASE WHEN i > o.start_frame THEN x * (1 - least(0.5, (least(o.end_frame + 1, len(s.v)) - o.start_frame) / 100.0)) ELSE x END)
            WHEN o.kind LIKE '%plastic%' THEN list_transform(s.v, lambda x, i: CASE WHEN i > o.start_frame AND i <= o.end_frame + 1 THEN x * (1 + 0.02 * 0.2) ELSE x END)
            WHEN o.kind LIKE '%dislocation%' THEN list_transform(s.v, lambda x, i: CASE WHEN i > o.start_frame AND i <= o.end_frame + 1 THEN x + 0.001 * 210 * 2.87 / (o.end_frame + 1 - o.start_frame) ELSE x END)
            WHEN o.kind LIKE '%fatigue%' AND list_avg(s.v[o.start_frame + 1:o.end_frame + 1]) > 0.7 THEN list_transform(s.v, lambda x, i: CASE WHEN i > o.start_frame THEN x * greatest(0.3, 1 - 0.1 * (o.end_frame + 1 - o.start_frame) / len(s.v)) ELSE x END)
            ELSE s.v END
        FROM steps s JOIN ordered o ON o.run_id = s.run_id AND o.k = s.k + 1)
    SELECT run_id, CAST(unnest(range(0, len(v))) AS INT) AS frame, unnest(v) AS v FROM (SELECT run_id, v FROM steps QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY k DESC) = 1) l""",
    run=edited,
    doc="by a sweep over segments; the check's form edits whole lists, event after event",
)
_FRAMES = "(SELECT run_id, kind, RANGE(start_frame, end_frame)RANGE AS frame FROM {events})"
EVENT_SCORES = Op(
    "event_scores",
    f"""
    SELECT s.run_id, s.frame, 1 + coalesce(e.strain, 0) AS strain, 1 + coalesce(e.coordination, 0) AS coordination, coalesce(e.damage, 0) AS damage,
        greatest(1, 0.5E0 * (1 + coalesce(e.strain, 0)) + 0.5E0 * coalesce(e.damage, 0)) AS combined
    FROM {{series}} s LEFT JOIN (
        SELECT run_id, frame, sum(CASE WHEN kind LIKE '%crack%' THEN 2.0E0 WHEN kind LIKE '%plastic%' THEN 1.5E0 WHEN kind LIKE '%dislocation%' THEN 0.5E0 ELSE 0 END) AS strain,
            sum(CASE WHEN kind LIKE '%crack%' OR kind LIKE '%plastic%' THEN 0.0E0 WHEN kind LIKE '%dislocation%' THEN 1.0E0 ELSE 0 END) AS coordination,
            sum(CASE WHEN kind LIKE '%crack%' THEN 3.0E0 WHEN kind LIKE '%plastic%' THEN 1.0E0 ELSE 0 END) AS damage
        FROM {_FRAMES} f GROUP BY run_id, frame) e ON e.run_id = s.run_id AND e.frame = s.frame""",
    doc="what the events of a frame add; scores only rise, so the combined one is that of the last event",
)
FAILURE_MODE = Op(
    "failure_mode",
    """
    SELECT r.run_id, CASE WHEN e.cracks > 0 THEN 'brittle_fracture' WHEN e.plastic > 5 THEN 'ductile_fracture' WHEN e.fatigue > 0 THEN 'fatigue_failure' ELSE 'elastic_deformation' END AS mode, e.first_ * 1.0E0 / r.n * 100 AS time_to_failure
    FROM (SELECT run_id, count(*) AS n FROM {series} GROUP BY run_id) r LEFT JOIN (
        SELECT run_id, sum(CASE WHEN kind LIKE '%crack%' THEN 1 ELSE 0 END) AS cracks, sum(CASE WHEN kind LIKE '%plastic%' THEN 1 ELSE 0 END) AS plastic, sum(CASE WHEN kind LIKE '%fatigue%' THEN 1 ELSE 0 END) AS fatigue,
            min(CASE WHEN kind LIKE '%crack%' OR kind LIKE '%failure%' THEN start_frame END) AS first_ FROM {events} GROUP BY run_id) e ON e.run_id = r.run_id""",
    doc="mode by the kinds of events, time as the first crack's place in the run, in percent",
)
STRAIN_FIELD = Op(
    "event_strain_field",
    f"""
    SELECT t.atom_id, greatest(0.0E0, least(0.5E0, avg(t.step) / m.lattice + coalesce(sum(CASE WHEN e.frame IS NOT NULL THEN t.step END), 0) / m.lattice * 0.5E0)) AS strain
    FROM (
        SELECT run_id, frame, atom_id, own, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)) AS step
        FROM {{traj}} WINDOW w AS (PARTITION BY run_id, blk, atom_id ORDER BY frame)) t
    LEFT JOIN (SELECT DISTINCT run_id, frame FROM {_FRAMES} f WHERE kind LIKE '%plastic%' OR kind LIKE '%dislocation%' OR kind LIKE '%crack%') e ON e.run_id = t.run_id AND e.frame = t.frame
    CROSS JOIN (SELECT lattice FROM {{materials}} WHERE code = '<code>') m
    WHERE t.own AND t.step IS NOT NULL GROUP BY t.atom_id, m.lattice""",
    {"code": "SUJ2"},
    halo=("traj", "1"),
    doc="mean step by lattice constant, and half of each step inside plastic events, dislocations and cracks",
)
