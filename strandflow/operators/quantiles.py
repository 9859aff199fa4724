"""Exact quantiles by selection: no task, buffer or driver holds a group's values.

`percentile` keeps every distinct value of a group in one aggregate's state. Here a group's distinct values are counted once
and the rank that is wanted is closed in on: values in reach are cut into bins at approximate quantiles (a sketch of bounded size), rows
are counted by bin exactly, and only the bin that holds the rank is looked at again. A bin holds about one value in `bins` of those
before it, so a thousand million distinct values take four rounds. Cuts only steer; ranks come from exact counts.

Defined results: null values are left out, and a group of them alone gives no row; a null group is a group; NaN is greater than any number;
between two values the quantile is interpolated, as `percentile` does; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.plans.op import Function
from strandflow.store import drop, written

#: Accuracy of the sketch: up to so many distinct values its cuts are exact, so small bins always come apart.
ACCURACY = 10_000


def _narrowed(values: DataFrame, targets: DataFrame, bins: int) -> DataFrame:
    """The targets with lo, hi and below of the bin that holds their rank."""
    near = values.join(targets, "key").where("v >= lo and v <= hi")
    cuts = near.groupBy("key", "rank").agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], F.lit(ACCURACY)).alias("cuts"))
    at = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    counts = near.join(cuts, ["key", "rank"]).groupBy("key", "rank", "below", at.alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("below", F.col("below") + before).where("rank >= below and rank < below + n")
    return counts.select("key", "rank", "lo", "hi", "below")


def quantiles(df: DataFrame, group: list[str], value: str, probs: list[float], bins: int = 256) -> DataFrame:
    """(group, p, q): the exact quantiles of `value` in each group, a row for each of `probs`."""
    named = df.select(F.struct(*group).alias("key"), F.col(value).cast("double").alias("v")).where("v is not null")
    values = written(named.groupBy("key", "v").agg(F.count("*").alias("n")), "distinct_values")
    place = F.col("p") * (F.col("total") - 1)
    span = values.groupBy("key").agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = span.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    ranks = F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank")
    asked = written(span.select("key", "p", "total", "lo", "hi", ranks), "ranks")
    targets = asked.select("key", "rank", "lo", "hi", F.lit(0).cast("long").alias("below")).distinct()
    held: list[DataFrame] = []
    while True:
        targets = written(targets, "targets")
        held.append(targets)
        # lo and hi are values of the data: where they are equal, the rank's value is found.
        if targets.where("lo < hi").isEmpty():
            break
        targets = _narrowed(values, targets.where("lo < hi"), bins).unionByName(targets.where("not lo < hi"))
    found = asked.select("key", "p", "total", "rank").join(targets.select("key", "rank", F.col("lo").alias("v")), ["key", "rank"])
    ends = found.groupBy("key", "p", "total").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    part = place - F.floor(place)
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    out = written(ends.select("key.*", "p", q.alias("q")), "quantiles")
    drop(values, asked, *held)
    return out


def _quartiles(series: DataFrame) -> DataFrame:
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("q")))
    return quantiles(series, ["run_id"], "v", [0.25, 0.5, 0.75]).groupBy("run_id").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def _median(series: DataFrame) -> DataFrame:
    return quantiles(series, ["run_id"], "v", [0.5]).select("run_id", F.col("q").alias("med"))


QUARTILES = Function(
    "quartiles",
    "SELECT run_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM {series} GROUP BY run_id",
    run=_quartiles,
)
MEDIAN = Function("median", "SELECT run_id, quantile_cont(v, 0.5) AS med FROM {series} WHERE v IS NOT NULL GROUP BY run_id", run=_median)
