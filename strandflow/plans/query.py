"""Named queries: a plan and the columns it returns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strandflow.plans.op import Plan


@dataclass(frozen=True)
class Query:
    """columns: names, apart by blanks; `~name` is rounded to `digits`, `#name` is a count (BIGINT). sql: an independent statement for the check."""

    plan: Plan
    columns: str
    digits: int = 6
    sql: str | None = None

    def exprs(self) -> list[str]:
        form = {"~": lambda c: f"round({c}, {self.digits}) + 0.0E0 AS {c}", "#": lambda c: f"CAST({c} AS BIGINT) AS {c}"}
        return [form[c[0]](c[1:]) if c[0] in form else c for c in self.columns.split()]

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rounds as the check's engine does, by scaling: Spark's own `round` goes by a number's decimal digits, and the two part at ties."""
        unit = f"1E{self.digits}"
        scaled = lambda c: f"if(abs({c}) < 1E300, round({c} * {unit}) / {unit}, {c}) + 0.0E0 AS {c}"
        return self.plan.spark(spark, sf_dir).selectExpr(*[scaled(c[1:]) if c[0] == "~" else e for c, e in zip(self.columns.split(), self.exprs(), strict=True)])

    def oracle(self) -> str:
        return f"SELECT {', '.join(self.exprs())} FROM ({self.sql or self.plan.statement()}) result_"


def tables(queries: dict[str, Query]) -> tuple[dict, dict]:
    """(callables, SQL) by name."""
    return {k: q.spark for k, q in queries.items()}, {k: q.oracle() for k, q in queries.items()}
