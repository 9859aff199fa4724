"""Operators as SQL over named inputs, and query plans made of them.

An operator is one SELECT with `{input}` places for its inputs and `<param>` places for its scalars. Called with DataFrames it
is a Spark DataFrame function, which Catalyst optimises together with everything around it. A Plan is a tree of
operators over sources. It runs in Spark, and for checking it can be written out as one SQL statement for another engine.
A step that is read more than once, by several operators or several times by one, is computed once and written to the shared
folder, so a deep plan scans its sources a few times however often its steps are used.

Windowed operators name one input as `halo`. In Spark its rows are dealt to blocks of `block` frames, with the rows within reach
of a block's edge copied to the neighbour, so a long run is not sorted by one task; results equal those without blocks. Such
operators partition their windows by run_id and blk and keep rows where `own` holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.store import written

BLOCK = 10_000


def halo_blocks(df: DataFrame, reach: int, order: str = "frame", block: int | None = None) -> DataFrame:
    """df with blk and own: rows within `reach` of a block's edge are in both blocks, owned by their own."""
    size = max(block or BLOCK, 2 * reach + 1)
    b = lambda c: F.floor(c / size).cast("int")
    o = F.col(order)
    blocks = F.array_distinct(F.array(b(o - reach), b(o), b(o + reach)))
    return df.withColumn("blk", F.explode(blocks)).withColumn("own", F.col("blk") == b(o))


def spark_sql(text: str) -> str:
    """Dialect places for Spark: PCT( is the interpolated percentile, RANGE(a, b)RANGE a row for each number, HASH32[x] 32 bits of x's MD5."""
    text = re.sub(r"\bPCT\(", "percentile(", text)
    text = re.sub(r"\bHASH32\[([^\]]*)\]", r"CAST(conv(substr(md5(CAST(\1 AS STRING)), 1, 8), 16, 10) AS BIGINT)", text)
    return re.sub(r"\bRANGE\(", "explode(sequence(", text).replace(")RANGE", "))")


def plain_sql(text: str) -> str:
    """The same places for the checking engine."""
    text = re.sub(r"\bPCT\(", "quantile_cont(", text)
    text = re.sub(r"\bHASH32\[([^\]]*)\]", r"CAST('0x' || substr(md5(CAST(\1 AS VARCHAR)), 1, 8) AS BIGINT)", text)
    return re.sub(r"\bRANGE\(", "unnest(generate_series(", text).replace(")RANGE", "))")


@dataclass(frozen=True)
class Op:
    """name, SQL, defaults of its parameters, and (input, reach) if windowed; reach may be a parameter's name or an expression of them."""

    name: str
    sql: str
    params: dict = field(default_factory=dict)
    halo: tuple[str, str] | None = None
    order: str = "frame"
    doc: str = ""
    #: A projection of one input: cheaper to repeat than to write.
    light: bool = False
    #: The Spark form, where it is not the check's. Spark joins by conditions first, in any order: a list of shifts that is
    #: crossed in would be joined last, after all pairs of a run's frames. A row for each shift in the SELECT keeps the order.
    spark: str = ""

    def render(self, params: dict, text: str = "") -> str:
        text = text or self.sql
        for k, v in {**self.params, **params}.items():
            text = text.replace(f"<{k}>", str(v))
        return text

    def reach(self, params: dict) -> int:
        """The halo's reach: a number, a parameter's name, or `factor * name`."""
        given = {**self.params, **params}
        out = 1
        for term in self.halo[1].split("*"):
            out *= int(given.get(term.strip(), term))
        return out

    def __call__(self, **given) -> DataFrame:
        frames = {k: v for k, v in given.items() if isinstance(v, DataFrame)}
        params = {k: v for k, v in given.items() if k not in frames and k != "block"}
        if self.halo:
            which = self.halo[0]
            frames[which] = halo_blocks(frames[which], self.reach(params), self.order, given.get("block"))
        spark = next(iter(frames.values())).sparkSession
        return spark.sql(spark_sql(self.render(params, self.spark)), **frames)


@dataclass(frozen=True)
class Function(Op):
    """An operator whose Spark form is a function of DataFrames and parameters; `sql` is its form for the checking engine."""

    run: Callable[..., DataFrame] | None = None

    def __call__(self, **given) -> DataFrame:
        return self.run(**{**self.params, **given})


@dataclass(frozen=True)
class Source:
    """A named input: how Spark reads it, and its SQL over the driver's tables."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    sql: str


@dataclass(frozen=True)
class Plan:
    op: Op
    inputs: dict
    params: dict = field(default_factory=dict)

    def readers(self) -> dict[int, int]:
        """How often each step below is read, by id; a light step passes its readers on. A recursion reads its inputs anew in every round."""
        order, seen = [], set()

        def visit(x) -> None:
            if id(x) not in seen:
                seen.add(id(x))
                for y in x.inputs.values() if isinstance(x, Plan) else ():
                    visit(y)
                order.append(x)

        visit(self)
        read = {id(x): 0 for x in order} | {id(self): 1}
        for x in reversed(order):
            for k, y in x.inputs.items() if isinstance(x, Plan) else ():
                text = x.op.spark or x.op.sql
                again = 2 if "WITH RECURSIVE" in text else 1
                read[id(y)] += text.count("{" + k + "}") * again * (read[id(x)] if x.op.light else 1)
        return read

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The result in Spark: steps with several readers are written once."""
        read, made = self.readers(), {}

        def make(x) -> DataFrame:
            if id(x) not in made:
                if isinstance(x, Source):
                    made[id(x)] = x.read(spark, sf_dir)
                else:
                    df = x.op(**{k: make(y) for k, y in x.inputs.items()}, **x.params)
                    made[id(x)] = written(df, x.op.name) if x is not self and read[id(x)] > 1 and not x.op.light else df
            return made[id(x)]

        return make(self)

    def statement(self) -> str:
        """One SQL statement with a common table expression for every step."""
        names: dict[int, str] = {}
        steps: list[str] = []

        def visit(x) -> str:
            if id(x) not in names:
                if isinstance(x, Source):
                    body, name = x.sql, x.name
                else:
                    body, name = body_of(x), f"{x.op.name}_{len(steps)}"
                names[id(x)] = name
                steps.append(f"{name} AS ({body})")
            return names[id(x)]

        def body_of(p: Plan) -> str:
            places = {k: visit(x) for k, x in p.inputs.items()}
            if p.op.halo:
                which = p.op.halo[0]
                name = f"{places[which]}_h{len(steps)}"
                steps.append(f"{name} AS (SELECT *, 0 AS blk, TRUE AS own FROM {places[which]})")
                places[which] = name
            text = p.op.plain(p.params) if hasattr(p.op, "plain") else plain_sql(p.op.render(p.params))
            for k, name in places.items():
                text = text.replace("{" + k + "}", name)
            return text

        last = body_of(self)
        return "WITH RECURSIVE " + ",\n".join(steps) + f"\nSELECT * FROM ({last}) last_"

    def with_params(self, **params) -> Plan:
        return replace(self, params={**self.params, **params})
