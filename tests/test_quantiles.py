"""Quantiles by selection against numpy and `percentile`."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandflow.operators.quantiles import quantiles

PROBS = [0.0, 0.025, 0.25, 0.5, 0.75, 1.0]


def _values(kind: str) -> np.ndarray:
    g = np.random.default_rng(5)
    return {
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        "ties": g.integers(0, 3, 5001).astype(float),
        "heavy_tail": np.exp(g.normal(0, 40, 20_011)),
        "signs": np.concatenate([-np.exp(g.normal(0, 9, 5000)), g.normal(0, 1, 5000), np.zeros(2000)]),
    }[kind]


@pytest.mark.parametrize("bins", [4, 256])
def test_quantiles_are_those_of_numpy(spark, bins):
    kinds = ["one", "two", "ties", "heavy_tail", "signs"]
    rows = pd.concat([pd.DataFrame({"g": k, "x": _values(k)}) for k in kinds])
    df = spark.createDataFrame(rows).repartition(7)
    got = quantiles(df, ["g"], "x", PROBS, bins).toPandas().set_index(["g", "p"])["q"]
    assert len(got) == len(kinds) * len(PROBS)
    for k in kinds:
        assert np.allclose([got[k, p] for p in PROBS], np.quantile(_values(k), PROBS), rtol=1e-12), k


def test_hot_group_equals_percentile(spark):
    df = spark.range(60_000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 11 as string)) as a", "id % 2 as b", "if(id % 17 = 0, null, round(sin(id) * 1e6, 2)) as x", "1 as v", "2 as n", "3 as rank")
    want = {(r.a, r.b): list(r.q) for r in df.groupBy("a", "b").agg(F.percentile("x", [0.1, 0.5]).alias("q")).collect()}
    got = {(r.a, r.b, r.p): r.q for r in quantiles(df, ["a", "b"], "x", [0.1, 0.5]).collect()}
    assert len(got) == 2 * len(want)
    assert all(abs(got[(*k, p)] - v) < 1e-9 for k, q in want.items() for p, v in zip((0.1, 0.5), q, strict=True))


def test_nulls_nan_and_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", float("nan")), ("b", 2.0), (None, 1.0), (None, 2.0)], "g string, x double")
    assert {(r.g, r.q) for r in quantiles(df, ["g"], "x", [0.5]).collect()} == {("b", 2.0), (None, 1.5)}
    assert quantiles(df.where("false"), ["g"], "x", [0.5]).count() == 0
