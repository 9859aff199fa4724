"""Exact nearest neighbours of points by tiles: no join of all pairs.

Equal points are folded first, so that a value that a series often has is one point with a weight. The points of a run are cut into
slabs along the first axis, each slab along the second, and each of those along the third, at quantiles that aim at CELL points a
tile (the quantiles only balance the tiles, results never depend on them). A tile still larger, whose points agree on these axes, is
dealt to parts. A point's k-th distance inside its own tile bounds how far its neighbours can be; with that radius it goes to every
tile that its ball meets, found by the slabs' bounds and equality joins, and the best k over these tiles are its neighbours.

Points are (run_id, frame, x), x an array without nulls, of one length in a run. Ties go to the point that comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.store import written

CELL, FINE, AXES = 1024, 256, 3
_KEYS = ["run_id", *(f"s{k}" for k in range(AXES)), "part"]


def _axis(k: int) -> str:
    """The axis that level k is cut along; points of fewer axes are cut along their last one again."""
    return f"x[least({k}, size(x) - 1)]"


def _slab(bounds: str, value: str) -> F.Column:
    """How many of the ascending bounds are at most the value."""
    return F.expr(f"size(filter({bounds}, b -> b <= {value}))")


def cut(points: DataFrame, cell: int) -> tuple[DataFrame, list[DataFrame]]:
    """(points with their tile s0, s1, s2, bounds by level: (run_id, s0.., bounds))."""
    levels, own = [], points
    for k in range(AXES):
        keys = ["run_id", *(f"s{i}" for i in range(k))]
        fine = [i / FINE for i in range(1, FINE)]
        level = own.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx(F.expr(_axis(k)), fine, F.lit(10_000)).alias("fine"))
        slabs = F.least(F.lit(FINE), F.ceil(F.pow(F.col("n") / cell, F.lit(1 / (AXES - k))))).cast("int")
        level = level.withColumn("q", slabs).withColumn("bounds", F.expr(f"if(q > 1, array_distinct(transform(sequence(1, q - 1), i -> fine[cast(i * {FINE} / q as int) - 1])), array())")).select(*keys, "bounds")
        own = own.join(level, keys).withColumn(f"s{k}", _slab("bounds", _axis(k))).drop("bounds")
        levels.append(level)
    return own, levels


def _tiled(points: DataFrame, cell: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(points with tile and part, (tile, parts), levels)."""
    own, levels = cut(points, cell)
    keys = _KEYS[:-1]
    parts = own.groupBy(*keys).agg(F.ceil(F.count("*") / (2.0 * cell)).cast("int").alias("parts"))
    own = own.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("first"), F.col("parts")).cast("int")).drop("parts")
    return own, parts, levels


def _reached(queries: DataFrame, levels: list[DataFrame], parts: DataFrame) -> DataFrame:
    """Queries (run_id, first, n, x, r) with every tile and part that their ball meets."""
    out = queries
    for k, level in enumerate(levels):
        keys = ["run_id", *(f"s{i}" for i in range(k))]
        out = out.join(level, keys).withColumn(f"s{k}", F.explode(F.sequence(_slab("bounds", f"{_axis(k)} - r"), _slab("bounds", f"{_axis(k)} + r")))).drop("bounds")
    return out.join(parts, _KEYS[:-1]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(out)


def _stacked(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float)


def _radii(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """A tile's points with the distance that holds k others of it, by weight; infinite if it has fewer."""
    x, n = _stacked(pdf["x"]), pdf["n"].to_numpy()
    r = np.full(len(pdf), np.inf)
    for lo in range(0, len(x), 256):
        d = _distances(x[lo : lo + 256], x)
        order = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
        held = np.cumsum(n[order], axis=1) >= k + 1
        has = held.any(axis=1)
        rows = np.flatnonzero(has)
        r[lo + rows] = d[rows, order[rows, held[rows].argmax(axis=1)]]
    return pdf[["run_id", "first", "n", "x"]].assign(r=r * (1 + 1e-9) + 1e-12)


def _matches(queries: pd.DataFrame, tile: pd.DataFrame, k: int | None) -> Iterator[pd.DataFrame]:
    """(run_id, first, n, d, to, times): of each query the k nearest points of the tile within its radius (None: all), itself left out."""
    if queries.empty or tile.empty:
        return
    x, first, times = _stacked(tile["x"]), tile["first"].to_numpy(), tile["n"].to_numpy()
    q, own, r = _stacked(queries["x"]), queries["first"].to_numpy(), queries["r"].to_numpy()
    for lo in range(0, len(q), 256):
        d = _distances(q[lo : lo + 256], x)
        near = (d <= r[lo : lo + 256, None]) & (first[None, :] != own[lo : lo + 256, None])
        i, j = np.nonzero(near)
        if k is not None:
            order = np.lexsort((first[j], np.round(d[i, j], 12), i))
            i, j = i[order], j[order]
            start = np.searchsorted(i, np.arange(len(near)))
            stay = np.arange(len(i)) - start[i] < k
            i, j = i[stay], j[stay]
        rows = queries.iloc[lo + i]
        yield pd.DataFrame({"run_id": rows["run_id"].to_numpy(), "first": rows["first"].to_numpy(), "n": rows["n"].to_numpy(), "d": d[i, j], "to": first[j], "times": times[j]})


def folded(points: DataFrame) -> DataFrame:
    """(run_id, x, n, first): distinct points, how often and when first."""
    return points.groupBy("run_id", "x").agg(F.count("*").alias("n"), F.min("frame").cast("long").alias("first"))


def _match(queries: DataFrame, tiles: DataFrame, k: int | None) -> DataFrame:
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = list(_matches(a, b, k))
        return pd.concat(found) if found else pd.DataFrame({"run_id": [], "first": [], "n": [], "d": [], "to": [], "times": []})

    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of their own: both sides may stem from one table
    return queries.groupBy(*_KEYS).cogroup(tiles.groupBy(*_KEYS)).applyInPandas(run, "run_id string, first long, n long, d double, to long, times long")


def nearest(points: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """(run_id, first, n, near): distinct points with their k nearest others in order, an array of (by, to, d, times); only those with another point."""
    tiles, parts, levels = _tiled(folded(points), max(cell, 4 * k))
    radii = tiles.groupBy(*_KEYS).applyInPandas(lambda pdf: _radii(pdf, k), "run_id string, first long, n long, x array<double>, r double")
    found = _match(_reached(radii, levels, parts), tiles, k)
    near = F.slice(F.array_sort(F.collect_list(F.struct(F.round("d", 12).alias("by"), F.col("to").alias("to"), F.col("d").alias("d"), F.col("times").alias("times")))), 1, k)
    return found.groupBy("run_id", "first", "n").agg(near.alias("near"))


def knn_mean(points: DataFrame, k: int = 20, cell: int = CELL) -> DataFrame:
    """(run_id, frame, mean_distance) to the k nearest other points of (run_id, frame, a, b, c), or to all others if fewer."""
    x = points.select("run_id", "frame", F.array("a", "b", "c").alias("x"))
    near = nearest(x, k, cell)
    others = F.aggregate("near", F.struct(F.least(F.col("n") - 1, F.lit(k)).cast("long").alias("held"), F.lit(0.0).alias("sum")), lambda a, e: F.struct(F.least(a["held"] + e["times"], F.lit(k).cast("long")).alias("held"), (a["sum"] + e["d"] * F.least(e["times"], F.lit(k) - a["held"])).alias("sum")))
    mean = near.select("run_id", "first", others.alias("o")).select("run_id", "first", (F.col("o.sum") / F.col("o.held")).alias("mean_distance"))
    alone = folded(x).join(mean, ["run_id", "first"], "left").where("n > 1 or mean_distance is not null").select("run_id", "x", F.coalesce("mean_distance", F.lit(0.0)).alias("mean_distance"))
    return x.join(alone, ["run_id", "x"]).select("run_id", "frame", "mean_distance")


def within(points: DataFrame, radius: float = 0.1, cell: int = CELL) -> DataFrame:
    """(run_id, i, j): pairs of frames whose points (a, b, c) are closer than radius, both ways; as many rows as there are such pairs."""
    x = points.select("run_id", "frame", F.array("a", "b", "c").alias("x"))
    distinct = folded(x)
    tiles, parts, levels = _tiled(distinct, cell)
    found = _match(_reached(distinct.withColumn("r", F.lit(float(radius))), levels, parts), tiles, None).where(F.col("d") < radius).select("run_id", "first", "to")
    frames = x.join(distinct.select("run_id", "x", "first"), ["run_id", "x"]).select("run_id", "first", "frame")
    pairs = found.unionByName(distinct.where("n > 1").select("run_id", "first", F.col("first").alias("to")))
    left = pairs.join(frames.withColumnRenamed("frame", "i"), ["run_id", "first"]).drop("first")
    return left.join(frames.select("run_id", F.col("first").alias("to"), F.col("frame").alias("j")), ["run_id", "to"]).where("i <> j").select("run_id", "i", "j")


def delayed(series: DataFrame, delays: DataFrame, most: int) -> DataFrame:
    """(run_id, frame, x): x[k] is the value k delays later, to most of them, cut where the run ends. delays: (run_id, tau)."""
    rows = series.join(delays, "run_id").select("run_id", "frame", "v", "tau", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("k"))
    rows = rows.select("run_id", (F.col("frame") - F.col("k") * F.col("tau")).alias("frame"), "k", "v").where("frame >= 0")
    held = rows.groupBy("run_id", "frame").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(most + 1)])
    return held.select("run_id", "frame", F.filter(F.array(*[f"v{k}" for k in range(most + 1)]), lambda v: v.isNotNull()).alias("x")).where("size(x) > 0")


def false_shares(series: DataFrame, delays: DataFrame, most: int = 10, ratio: float = 10.0, cell: int = CELL) -> DataFrame:
    """(run_id, m, n, share): of the points in m dimensions those whose nearest neighbour parts from them by more than ratio in the next one."""
    rows = delayed(series, delays, most).select("run_id", "frame", "x", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("x")))).alias("m"))
    rows = rows.select(F.concat_ws("|", "m", "run_id").alias("run_id"), F.col("run_id").alias("run"), "m", "frame", F.slice("x", F.lit(1), F.col("m")).alias("x"), F.get("x", F.col("m")).alias("next"))
    rows = written(rows, "delayed")  # a run for each dimension, so that one pass of the index serves all
    near = nearest(rows.select("run_id", "frame", "x"), 1, cell).where("n = 1").select("run_id", F.col("first").alias("frame"), F.col("near")[0]["d"].alias("d"), F.col("near")[0]["to"].alias("to"))
    nexts = rows.select("run_id", F.col("frame").alias("to"), F.col("next").alias("other"))
    false = near.join(rows.select("run_id", "frame", "next"), ["run_id", "frame"]).join(nexts, ["run_id", "to"]).where((F.col("d") > 1e-10) & (F.abs(F.col("next") - F.col("other")) > ratio * F.col("d")))
    share = rows.groupBy("run_id", "run", "m").agg(F.count("*").alias("n")).join(false.groupBy("run_id").agg(F.count("*").alias("k")), "run_id", "left")
    return share.select(F.col("run").alias("run_id"), "m", "n", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("share"))
