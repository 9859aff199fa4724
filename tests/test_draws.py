"""Draws in arrays against the statements that the check runs: hashes, permutations, shuffles, bootstraps, in blocks and tiles and where a threshold lies outside its bounds."""

from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandflow.operators import draws, network
from strandflow.plans.op import plain_sql


@pytest.fixture(scope="module")
def held():
    """Frames from 3 on, a run that ends early, nulls; one run is constant."""
    g = np.random.default_rng(5)
    rows = [(f"g{k}", f, None if (k, f % 9) == (2, 0) else 1.0 if k == 4 else float(g.normal() + 0.1 * k)) for k in range(5) for f in range(3, 143) if k != 3 or f < 101]
    return pd.DataFrame(rows, columns=["run_id", "frame", "v"]).astype({"run_id": object, "frame": "int32"})


@pytest.fixture(scope="module")
def series(spark, held, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('draws')}/series"
    spark.createDataFrame([(r.run_id, int(r.frame), None if pd.isna(r.v) else float(r.v)) for r in held.itertuples()], "run_id string, frame int, v double").write.parquet(at)
    return spark.read.parquet(at)


def plain(op, held, **params) -> pd.DataFrame:
    with duckdb.connect() as db:
        db.register("held", held)
        return db.sql(plain_sql(op.render(params)).replace("{series}", "held")).df()


def same(got: pd.DataFrame, want: pd.DataFrame, keys: list[str]) -> None:
    assert len(want) > 0
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want[list(got.columns)], check_dtype=False)


def test_hashes_are_md5():
    n = np.array([*range(1200), 9999, 10000, 99999, 100000, 1234567, 4294967295])
    for names in ([b"42|1|", b"42|7|"], [b"42|10|", b"42|99|"], [b"42|10000|"]):
        want = [[int(hashlib.md5(p + str(k).encode()).hexdigest()[:8], 16) for k in n] for p in names]
        assert (draws.Hashes(n)(names) == np.array(want)).all()


@pytest.mark.parametrize("given", [{}, {"size": 33}, {"size": 33, "reach": 0.5}])
def test_permutation_against_its_statement(series, held, given):
    same(network.PERMUTATION(series=series, reps=120, **given).toPandas(), plain(network.PERMUTATION, held, reps=120), ["i", "j"])


def test_permutation_has_no_row_for_each_replicate_and_frame(series):
    plan = network.PERMUTATION(series=series, reps=120)._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"\bWindow \[|md5\(", plan)


@pytest.mark.parametrize("given", [{}, {"size": 33, "span": 20, "tile": 48}])
def test_null_p_value_against_its_statement(series, held, given):
    same(network.NULL_P_VALUE(series=series, reps=120, **given).toPandas(), plain(network.NULL_P_VALUE, held, reps=120), ["g"])


def test_shuffles_make_no_row_for_each_replicate_and_frame(series):
    plan = network.NULL_P_VALUE(series=series, reps=120)._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"\bWindow \[|md5\(", plan)


@pytest.mark.parametrize("given", [{}, {"size": 33}, {"size": 33, "reach": 0.3}])
def test_bootstrap_statistics_against_their_statement(series, held, given):
    same(network.BOOTSTRAP_STATISTICS(series=series, reps=120, **given).toPandas(), plain(network.BOOTSTRAP_STATISTICS, held, reps=120), ["g", "stat"])


def test_bootstrap_makes_no_row_for_each_replicate_and_frame(series):
    plan = network.BOOTSTRAP_STATISTICS(series=series, reps=120)._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"\bWindow \[|md5\(", plan)


def test_draws_of_nothing(spark):
    none = spark.createDataFrame([], "run_id string, frame int, v double")
    for op in (network.PERMUTATION, network.NULL_P_VALUE, network.BOOTSTRAP_STATISTICS):
        assert op(series=none, reps=3).count() == 0


def test_nan_counts_as_the_highest_value(spark):
    g = np.random.default_rng(6)
    rows = pd.DataFrame([(k, f, float("nan") if (k, f) == ("b", 7) else float(g.normal())) for k in "abc" for f in range(40)], columns=["run_id", "frame", "v"]).astype({"run_id": object, "frame": "int32"})
    series = spark.createDataFrame([(r.run_id, int(r.frame), r.v) for r in rows.itertuples()], "run_id string, frame int, v double")
    with duckdb.connect() as db:
        db.sql("CREATE TABLE held (run_id VARCHAR, frame INTEGER, v DOUBLE)")
        db.executemany("INSERT INTO held VALUES (?, ?, ?)", [(r.run_id, int(r.frame), r.v) for r in rows.itertuples()])
        want = db.sql(plain_sql(network.PERMUTATION.render({"reps": 30})).replace("{series}", "held")).fetchall()
    got = [tuple(r) for r in network.PERMUTATION(series=series, reps=30).collect()]
    assert [r[:2] for r in sorted(got)] == [r[:2] for r in sorted(want)] and np.allclose([r[2:] for r in sorted(got)], [r[2:] for r in sorted(want)], equal_nan=True)
    most = {r.g: r.estimate for r in network.BOOTSTRAP_STATISTICS(series=series, reps=30).where("stat = 'max'").collect()}
    assert np.isnan(most["b"]) and most["a"] == rows[rows.run_id == "a"].v.max()
