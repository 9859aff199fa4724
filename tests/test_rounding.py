"""Rounded columns against the check's engine, at ties that a decimal reading of the number and a scaled one decide differently."""

from __future__ import annotations

import math

import duckdb

from strandflow.plans.op import Op, Plan, Source
from strandflow.plans.query import Query

VALUES = [1.0355625, 1.0268475, 0.8082374999999999, 1.0129875, 0.9010994999999999, -1.0371825, -0.0, 1e301, 2.5e-7, 123456789.1234565]


def test_ties_are_rounded_as_in_the_statement(spark):
    rows = [(k, v) for k, v in enumerate(VALUES)] + [(90, math.nan), (91, math.inf), (92, None)]
    sql = "SELECT * FROM (VALUES " + ", ".join(f"({k}, {'NULL' if v is None else repr(str(v))}::DOUBLE)" for k, v in rows) + ") t(k, v)"
    query = Query(Plan(Op("as_is", "SELECT k, v FROM {x}"), {"x": Source("rows_", lambda s, _: s.createDataFrame(rows, "k int, v double"), sql)}), "k ~v")
    got = {r.k: r.v for r in query.spark(spark, "").collect()}
    want = dict(duckdb.sql(query.oracle()).fetchall())
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
