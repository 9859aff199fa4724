"""Fourier transforms of long runs in two shuffles.

A run of n = p q frames is read as a table of p rows and q columns. Columns are transformed (first shuffle), turned by their twiddle
factors, and rows are transformed (second shuffle); a task holds a few columns or rows of about sqrt(n) values, never a run. A
length without a divisor near its root goes by a chirp: a circular convolution of twice the length, rounded up to a power of two.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators.quantiles import quantiles
from strandflow.operators.sequential import pick_peaks
from strandflow.store import written

TOGETHER = 65_536


def divisor(n: int) -> int:
    """The divisor of n next below its root."""
    p = int(n**0.5)
    while n % p:
        p -= 1
    return p


def transform(values: DataFrame, lengths: dict[int, int], inverse: bool = False, together: int = TOGETHER) -> DataFrame:
    """(run_id, n, k, re, im) from (run_id, n, t, re, im), t from 0 to n - 1; absent places are 0. lengths: n -> divisor p."""
    sign = 2j if inverse else -2j
    rows = F.lit(1)
    for n, p in lengths.items():
        rows = F.when(F.col("n") == n, p).otherwise(rows)
    v = values.withColumn("p", rows.cast("long")).withColumn("q", (F.col("n") / F.col("p")).cast("long"))

    def along(pdf: pd.DataFrame, length: int, line: str, place: str) -> tuple[np.ndarray, np.ndarray]:
        lines, at = np.unique(pdf[line].to_numpy(), return_inverse=True)
        x = np.zeros((len(lines), length), complex)
        x[at, pdf[place].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        return lines, (np.fft.ifft(x, axis=1) * length if inverse else np.fft.fft(x, axis=1))

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        n, p, q = (int(pdf[c].iloc[0]) for c in ("n", "p", "q"))
        lines, y = along(pdf, p, "column", "row")
        y *= np.exp(sign * np.pi * (lines[:, None] * np.arange(p)[None, :] % n) / n)
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "n": n, "p": p, "q": q, "row": np.tile(np.arange(p), len(lines)), "column": np.repeat(lines, p), "re": y.real.ravel(), "im": y.imag.ravel()})

    def rows_(pdf: pd.DataFrame) -> pd.DataFrame:
        n, p, q = (int(pdf[c].iloc[0]) for c in ("n", "p", "q"))
        lines, y = along(pdf, q, "row", "column")
        k = lines[:, None] + p * np.arange(q)[None, :]
        scale = 1 / n if inverse else 1
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "n": n, "k": k.ravel(), "re": y.real.ravel() * scale, "im": y.imag.ravel() * scale})

    cells = v.select("run_id", "n", "p", "q", F.floor(F.col("t") / F.col("q")).alias("row"), (F.col("t") % F.col("q")).alias("column"), "re", "im")
    first = cells.groupBy("run_id", "n", F.floor(F.col("column") * F.col("p") / together).alias("batch")).applyInPandas(columns, "run_id string, n long, p long, q long, row long, column long, re double, im double")
    return first.groupBy("run_id", "n", F.floor(F.col("row") * F.col("q") / together).alias("batch")).applyInPandas(rows_, "run_id string, n long, k long, re double, im double")


def fourier(series: DataFrame, together: int = TOGETHER, odd: int = 16) -> DataFrame:
    """(run_id, n, k, re, im): the discrete Fourier transform of every run of (run_id, frame, v), frames from 0 without gaps."""
    sizes = series.groupBy("run_id").agg(F.count("*").alias("n"))
    lengths = {r.n: divisor(r.n) for r in sizes.select("n").distinct().collect()}  # one number a length
    plain = {n: p for n, p in lengths.items() if p * odd >= n**0.5}
    v = series.join(sizes, "run_id").select("run_id", "n", F.col("frame").cast("long").alias("t"), F.col("v").alias("re"), F.lit(0.0).alias("im"))
    out = transform(v.where(F.col("n").isin(list(plain))), plain, together=together)
    rest = {n: 1 << (2 * n - 1).bit_length() for n in lengths if n not in plain}
    if not rest:
        return out
    wide = F.lit(1)
    for n, m in rest.items():
        wide = F.when(F.col("size") == n, m).otherwise(wide)
    power = {m: divisor(m) for m in rest.values()}
    angle = lambda t: F.lit(np.pi) * ((t * t) % (2 * F.col("size"))) / F.col("size")
    v = v.where(~F.col("n").isin(list(plain))).withColumnRenamed("n", "size").withColumn("n", wide.cast("long"))
    a = v.select("run_id", "size", "n", "t", (F.col("re") * F.cos(angle(F.col("t")))).alias("re"), (-F.col("re") * F.sin(angle(F.col("t")))).alias("im"))
    b = v.select("run_id", "size", "n", F.explode(F.array_distinct(F.array("t", (F.col("n") - F.col("t")) % F.col("n")))).alias("t"), "t").toDF("run_id", "size", "n", "t", "s")
    b = b.select("run_id", "size", "n", "t", F.cos(angle(F.col("s"))).alias("re"), F.sin(angle(F.col("s"))).alias("im"))
    both = transform(a.unionByName(b.withColumn("run_id", F.concat(F.lit("chirp|"), "run_id"))).drop("size"), power, together=together)
    x = both.where("run_id not like 'chirp|%'")
    y = both.where("run_id like 'chirp|%'").select(F.substring("run_id", 7, 1 << 20).alias("run_id"), "k", F.col("re").alias("c"), F.col("im").alias("s"))
    product = x.join(y, ["run_id", "k"]).select("run_id", "n", F.col("k").alias("t"), (F.col("re") * F.col("c") - F.col("im") * F.col("s")).alias("re"), (F.col("re") * F.col("s") + F.col("im") * F.col("c")).alias("im"))
    back = transform(product, power, inverse=True, together=together).drop("n").join(sizes.withColumnRenamed("n", "size"), "run_id").where("k < size")
    c, s = F.cos(angle(F.col("k"))), F.sin(angle(F.col("k")))
    return out.unionByName(back.select("run_id", F.col("size").alias("n"), "k", (F.col("re") * c + F.col("im") * s).alias("re"), (F.col("im") * c - F.col("re") * s).alias("im")))


def periodicity(series: DataFrame, distance: int = 5, together: int = TOGETHER) -> DataFrame:
    """(run_id, frequency, amplitude): spectral peaks over median + 3 MAD of the amplitudes, the highest first removing all nearer than `distance`."""
    mean = series.groupBy("run_id").agg(F.avg("v").alias("mean"))
    centred = series.join(mean, "run_id").select("run_id", "frame", (F.col("v") - F.col("mean")).alias("v"))
    spectrum = fourier(centred, together).where("k <= n / 2").select("run_id", F.col("k").cast("int").alias("frequency"), F.hypot("re", "im").alias("amplitude"))
    spectrum = written(spectrum, "spectrum")
    median = lambda rows, name: quantiles(rows, ["run_id"], "amplitude", [0.5]).select("run_id", F.col("q").alias(name))
    middle = median(spectrum, "mid")
    off = spectrum.join(middle, "run_id").select("run_id", F.abs(F.col("amplitude") - F.col("mid")).alias("amplitude"))
    spread = middle.join(median(off, "mad"), "run_id").select("run_id", (F.col("mid") + 3 * F.col("mad")).alias("line"))
    high = spectrum.join(spread, "run_id").where("amplitude > line").select("run_id", "frequency", "amplitude")
    near = lambda step, name: spectrum.select("run_id", (F.col("frequency") + step).alias("frequency"), F.col("amplitude").alias(name))
    peaks = high.join(near(1, "before_"), ["run_id", "frequency"]).join(near(-1, "after_"), ["run_id", "frequency"]).where("amplitude > before_ and amplitude > after_")

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frequency")
        return pdf.iloc[pick_peaks(pdf["frequency"].to_numpy(), pdf["amplitude"].to_numpy(), distance)][["run_id", "frequency", "amplitude"]]

    return peaks.select("run_id", "frequency", "amplitude").groupBy("run_id").applyInPandas(thin, "run_id string, frequency int, amplitude double")
