"""Sliding means, deviations, filters and lagged products of a block of frames, by arrays: the engine's own sliding windows visit every row of a window anew for every row.

Spark deals the frames to blocks (`halo_blocks`) and shuffles them; a task holds one block of one run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.plans.op import halo_blocks

#: Windows laid out at a time.
CHUNK = 1024


def floats(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are not null); a null's value is 0, and NaN stays a value."""
    return column.fill_null(0.0).to_numpy(), ~column.is_null().to_numpy()


def moments(x: np.ndarray, there: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean, population variance) over the rows from `before` earlier to `after` later, nulls left out; sums go in the order of rows, as the engines' do, so that means round alike; deviations are taken from the row's own value first, so that equal values have variance 0."""
    width = before + after + 1
    views = [np.lib.stride_tricks.sliding_window_view(np.pad(a, (before, after)), width) for a in (x, there)]
    own = np.where(there & np.isfinite(x), x, 0.0)
    n, total, var = np.zeros(len(x), dtype=int), np.zeros(len(x)), np.empty(len(x))
    padded = np.pad(x, (before, after))
    for k in range(width):
        total += padded[k : k + len(x)]
    with np.errstate(invalid="ignore", divide="ignore"):
        for lo in range(0, len(x), CHUNK):
            part = slice(lo, lo + CHUNK)
            held = views[1][part]
            n[part] = held.sum(1)
            off = np.where(held, views[0][part] - own[part, None], 0.0)
            m = off.sum(1) / n[part]
            off = np.where(held, off - m[:, None], 0.0)
            var[part] = (off * off).sum(1) / n[part]
        return n, total / n, var


def covariances(x: np.ndarray, y: np.ndarray, both: np.ndarray, before: int, after: int) -> np.ndarray:
    """The population covariance over the same rows, those left out where either is null; NaN where none is left."""
    width, out = before + after + 1, np.empty(len(x))
    views = [np.lib.stride_tricks.sliding_window_view(np.pad(a, (before, after)), width) for a in (x, y, both)]
    with np.errstate(invalid="ignore", divide="ignore"):
        for lo in range(0, len(x), CHUNK):
            part = slice(lo, lo + CHUNK)
            held = views[2][part]
            n, offs = held.sum(1), []
            for a, view in ((x, views[0]), (y, views[1])):
                own = np.where(both[part] & np.isfinite(a[part]), a[part], 0.0)
                off = np.where(held, view[part] - own[:, None], 0.0)
                offs.append(np.where(held, off - (off.sum(1) / n)[:, None], 0.0))
            out[part] = (offs[0] * offs[1]).sum(1) / n
    return out


def window_moments(df: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], before: int, after: int, block: int | None = None, together: bool = False) -> DataFrame:
    """(keys, frame, columns, m_<column>, var_<column>) of each run `keys`, over rows in the order of frames; null where a window has no value. together: and `cov` of the two columns."""
    held = halo_blocks(df.select(*keys, "frame", *[F.col(c).cast("double").alias(c) for c in columns]), max(before, after), block=block)
    made = [f"{k}_{c}" for c in columns for k in ("m", "var")] + ["cov"] * together

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        out = {c: table[c] for c in (*keys, "frame", *columns)}
        for c in columns:
            n, mean, var = moments(*floats(table[c]), before, after)
            out |= {f"m_{c}": pa.array(mean, mask=n == 0), f"var_{c}": pa.array(var, mask=n == 0)}
        if together:
            (x, here), (y, there) = (floats(table[c]) for c in columns)
            none = np.convolve(here & there, np.ones(before + after + 1))[after : after + len(x)] < 0.5
            out["cov"] = pa.array(covariances(x, y, here & there, before, after), mask=none)
        return pa.table(out).filter(table["own"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name not in ("blk", "own"))
    return held.groupBy(*keys, "blk").applyInArrow(run, schema + "".join(f", {c} double" for c in made))


def filtered(frame: np.ndarray, x: np.ndarray, there: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of weights x values over the frames around, null ones left out, by the sum of weights of the frames that are there; whether any value was there)."""
    at, reach = frame - frame[0], len(weights) // 2
    value, known, row = np.zeros(at[-1] + 1), np.zeros(at[-1] + 1), np.zeros(at[-1] + 1)
    for into, what in ((value, x), (known, there), (row, 1.0)):
        np.add.at(into, at, what)
    total, some, weight = (np.convolve(a, w)[reach : reach + len(a)] for a, w in ((value, weights), (known, np.ones(len(weights))), (row, weights)))
    return total[at] / weight[at], some[at] > 0.5


def window_filter(df: DataFrame, weights: np.ndarray, block: int | None = None) -> DataFrame:
    """(run_id, frame, v) by symmetric weights; columns `run_id, frame, v, n`, frames outside 0 to n - 1 are read but not returned."""
    held = halo_blocks(df.select("run_id", "frame", F.col("v").cast("double").alias("v"), "n"), len(weights) // 2, block=block)
    kind = held.schema["run_id"].dataType.simpleString(), held.schema["frame"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        frame, n = table["frame"].to_numpy(), table["n"].to_numpy()
        v, some = filtered(frame.astype(np.int64), *floats(table["v"]), weights)
        out = pa.table({"run_id": table["run_id"], "frame": table["frame"], "v": pa.array(v, mask=~some)})
        return out.filter(pa.array(table["own"].to_numpy() & (frame >= 0) & (frame < n)))

    return held.groupBy("run_id", "blk").applyInArrow(run, f"run_id {kind[0]}, frame {kind[1]}, v double")


def _off(x: np.ndarray) -> tuple[float, np.ndarray]:
    """(mean, deviations from it); equal values have none."""
    if not len(x):
        return 0.0, x
    at = x[0] if np.isfinite(x[0]) else 0.0
    d = x - at
    return at + d.mean(), d - d.mean()


def lagged_sums(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], lag: int) -> tuple[float, ...]:
    """Rows that meet at a lag, then of a, of b and of both where neither is null: count, mean and squared deviations, or both means and products of deviations. a, b: values, not null, there (of a: own)."""
    end = len(a[0]) - lag
    if end <= 0 or not (met := a[2][:end] & b[2][lag:]).any():
        return (0,) * 11
    x, y, known, late = a[0][:end][met], b[0][lag:][met], a[1][:end][met], b[1][lag:][met]
    with np.errstate(invalid="ignore"):
        (mx, dx), (my, dy) = _off(x[known]), _off(y[late])
        both = known & late
        (px, ex), (py, ey) = ((mx, dx), (my, dy)) if both.all() else (_off(x[both]), _off(y[both]))
        return len(x), len(dx), mx, (dx * dx).sum(), len(dy), my, (dy * dy).sum(), len(ex), px, py, (ex * ey).sum()


LAGGED = ("n", "na", "ma", "sa", "nb", "mb", "sb", "nc", "pa", "pb", "sc")


def packed(rows: DataFrame) -> DataFrame:
    """(run_id, frame_blk, frames, vs, flags) of rows (run_id, frame_blk, frame, v, own): a block's rows as bytes, so that a pair's blocks are shuffled and sorted as one row each."""

    def run(table: pa.Table) -> pa.Table:
        v, known = floats(table["v"])
        flags = known + 2 * table["own"].to_numpy().astype(np.uint8)
        held = (table["frame"].to_numpy().astype(np.int64), v, flags.astype(np.uint8))
        return pa.table({"run_id": table["run_id"][:1], "frame_blk": table["frame_blk"][:1], **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("frames", "vs", "flags"), held, strict=True)}})

    return rows.groupBy("run_id", "frame_blk").applyInArrow(run, "run_id string, frame_blk int, frames binary, vs binary, flags binary")


def block_lags(pairs: DataFrame, lags: range, both: bool = True) -> DataFrame:
    """(i, j, lag, sums LAGGED) of each block and pair, in both directions or with j later only; two rows (i, j, frame_blk, later, frames, vs, flags) each, `later` tells the two series apart."""

    def run(table: pa.Table) -> pa.Table:
        rows = {r["later"]: (np.frombuffer(r["frames"], np.int64), np.frombuffer(r["vs"]), np.frombuffer(r["flags"], np.uint8)) for r in table.to_pylist()}
        if len(rows) < 2:
            return none
        lo = min(r[0].min() for r in rows.values())
        size = max(r[0].max() for r in rows.values()) - lo + 1
        series = []
        for k in (False, True):
            frame, v, flags = rows[k]
            held = [np.zeros(size), *(np.zeros(size, dtype=bool) for _ in range(3))]
            for into, what in zip(held, (v, flags % 2 == 1, flags >= 2, True), strict=True):
                into[frame - lo] = what
            series.append(held)
        i, j, out = table["i"][0].as_py(), table["j"][0].as_py(), []
        for names, x, y in (((i, j), *series), ((j, i), *reversed(series)))[: 1 + both]:
            for lag in lags:
                found = lagged_sums((x[0], x[1], x[2]), (y[0], y[1], y[3]), lag)
                if found[0]:
                    out.append((*names, lag, *(float(f) for f in found)))
        return pa.table({c: pa.array([r[k] for r in out], kind) for k, (c, kind) in enumerate(kinds.items())})

    kinds = {"i": pa.string(), "j": pa.string(), "lag": pa.int32(), **dict.fromkeys(LAGGED, pa.float64())}
    none = pa.table({c: pa.array([], kind) for c, kind in kinds.items()})
    return pairs.groupBy("i", "j", "frame_blk").applyInArrow(run, "i string, j string, lag int, " + ", ".join(f"{c} double" for c in LAGGED))
