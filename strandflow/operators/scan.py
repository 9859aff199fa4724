"""Recurrences that saturate, as an associative scan over blocks.

A step x -> min(c, a x + b) with a >= 0 stays of this form under composition, so a block of steps is one step. Blocks are composed
on their own, the blocks' steps are scanned in the same way (level by level, until one block is left), and every block then
runs from the value it begins with. No task holds more than `block` steps of a series, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.store import written

BLOCK = 512
_STEP = "(s, e) -> named_struct('a', e.a * s.a, 'b', e.a * s.b + e.b, 'c', least(e.c, e.a * s.c + e.b))"


def _composed(steps: str) -> Column:
    return F.expr(f"aggregate({steps}, named_struct('a', 1D, 'b', 0D, 'c', double('infinity')), {_STEP})")


def before(steps: DataFrame, keys: list[str], last: int, start: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(*keys, at, a, b, c, x): steps (*keys, at, a, b, c), at from 0 to last, with the value x before each."""
    blocks = steps.groupBy(*keys, F.floor(F.col("at") / block).alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "a", "b", "c"))).alias("steps"))
    if last < block:
        blocks = blocks.withColumn("x", F.lit(float(start)))
    else:
        blocks = written(blocks, "blocks")
        outer = blocks.withColumn("s", F.when(F.size("steps") > 0, _composed("steps"))).select(*keys, F.col("part").alias("at"), "s.a", "s.b", "s.c")
        blocks = blocks.join(before(outer, keys, last // block, start, block).select(*keys, F.col("at").alias("part"), "x"), [*keys, "part"])
    ran = F.expr("aggregate(steps, named_struct('x', x, 'seen', cast(array() as array<double>)), (s, e) -> named_struct('x', least(e.c, e.a * s.x + e.b), 'seen', array_append(s.seen, s.x)), s -> s.seen)")
    rows = blocks.select(*keys, F.explode(F.arrays_zip("steps", ran.alias("seen"))).alias("r"))
    return rows.select(*keys, "r.steps.at", "r.steps.a", "r.steps.b", "r.steps.c", F.col("r.seen").alias("x"))


def cumulative_damage(damage: DataFrame, recovery: float = 0.01, fatigue: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(run_id, cluster_id, frame, damage): each frame's damage d added to what is left of the sum before, at most 1; the first frame's as it is."""
    keys = ["run_id", "cluster_id"]
    ends = damage.groupBy(*keys).agg(F.min("frame").alias("first"))
    last = damage.agg(F.max("frame")).first()[0]
    begins = F.col("frame") == F.col("first")
    steps = damage.join(ends, keys).select(*keys, F.col("frame").cast("long").alias("at"), F.when(begins, 0.0).otherwise(1.0 - recovery).alias("a"), (F.col("d") * fatigue).alias("b"), F.when(begins, float("inf")).otherwise(1.0).alias("c"))
    out = before(steps, keys, int(last or 0), 0.0, block)
    return out.select(*keys, F.col("at").cast("int").alias("frame"), F.expr("least(c, a * x + b)").alias("damage"))
