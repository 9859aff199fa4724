"""Fourier transforms in two shuffles against numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from strandflow.operators import spectrum


def frame(spark, v, run):
    return spark.createDataFrame(pd.DataFrame({"run_id": run, "frame": np.arange(len(v), dtype="int32"), "v": np.asarray(v, dtype=float)}), "run_id string, frame int, v double")


@pytest.mark.parametrize("together", [65_536, 64])
def test_transforms_of_all_lengths(spark, together):
    g = np.random.default_rng(2)
    runs = {f"n{n}": g.normal(size=n) for n in (1, 2, 12, 360, 1021, 2 * 997)}
    series = None
    for run, v in runs.items():
        series = frame(spark, v, run) if series is None else series.unionByName(frame(spark, v, run))
    got = spectrum.fourier(series.repartition(4), together).toPandas()
    for run, v in runs.items():
        mine = got[got.run_id == run].sort_values("k")
        assert mine.k.tolist() == list(range(len(v)))
        assert np.allclose(mine.re + 1j * mine.im, np.fft.fft(v))


def test_a_long_run_is_never_in_one_task(spark):
    v = np.random.default_rng(3).normal(size=1 << 16)
    got = spectrum.fourier(frame(spark, v, "r").repartition(4), 2048).toPandas().sort_values("k")
    assert np.allclose(got.re + 1j * got.im, np.fft.fft(v))


def test_periods_stand_out(spark):
    t = np.arange(720)
    v = np.sin(2 * np.pi * t / 24) + 0.5 * np.sin(2 * np.pi * t / 7.2) + 0.05 * np.random.default_rng(1).normal(size=720)
    got = spectrum.periodicity(frame(spark, v, "r")).toPandas().sort_values("amplitude", ascending=False)
    assert got.frequency.tolist()[:2] == [30, 100]
