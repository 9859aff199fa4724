"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets come from weights, stopped at `most` times a source's size with the excess reshared (a water level over
sources in order of size per weight). Equal-token blocks go to sources by highest quotients target / (2 seats + 1),
then each source's blocks go to its shards the same way, so every (source, shard) cell has an integer quota. In a
cell the documents stand in seeded order as one stream of words; whole passes are taken first, then blocks from a
seeded block on, round the end. Word counts are taken per document without listing blocks.

Defined results: null text has no words and is never taken; a null source is a source, last in order; repeated rows
are rows; all-empty input takes nothing; other columns are not read; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm._store import written
from strandflow.llm.sharding import hash32

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, rank, source_size, target) from (source, source_size), source not null: one row a source, so a global window is small."""
    order = Window.orderBy(F.col("source"))
    t = sizes.withColumn("rank", F.row_number().over(order))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = t.withColumn("w", pick.cast("long")).withColumn("cap", most * F.col("source_size"))
    every = Window.partitionBy()
    t = t.withColumn("all_w", F.sum("w").over(every)).withColumn("all_size", F.sum("source_size").over(every))
    rising = Window.orderBy((F.col("cap").cast("double") / F.col("w")), "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("w0", F.coalesce(F.sum("w").over(rising), F.lit(0))).withColumn("c0", F.coalesce(F.sum("cap").over(rising), F.lit(0)))
    t = t.withColumn("full", F.col("cap") * (F.col("all_w") - F.col("w0")) <= F.col("w") * (F.col("all_size") - F.col("c0")))
    t = t.withColumn("full_w", F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(every)).withColumn("full_c", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every))
    level = (F.col("w") * (F.col("all_size") - F.col("full_c"))).cast("double") / (F.col("all_w") - F.col("full_w"))
    return t.select("source", "rank", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """`parties` with `quota`: the seats of each group by highest quotients votes / (2 n + 1), ties by key.

    Rounding votes over a divisor that is a little too large gives seats that the method certainly gives; only
    the few that may follow (at most 3 a party on average) are listed as quotients and ranked.
    """
    g = Window.partitionBy(*group)
    p = parties.withColumn("v_", F.sum(F.col(votes).cast("double")).over(g)).withColumn("k_", F.count("*").over(g).cast("double"))
    sure = F.floor(F.col(votes).cast("double") * (F.col(seats) - F.col("k_") / 2) / F.col("v_") + 0.5)
    p = p.withColumn("sure_", F.when((F.col("v_") > 0) & (F.col(seats) > F.col("k_") / 2), sure).otherwise(F.lit(0)).cast("long"))
    p = p.withColumn("left_", F.col(seats) - F.sum("sure_").over(g))
    more = F.when(F.col("v_") > 0, F.least(F.floor(F.col(votes).cast("double") * F.greatest(F.col("k_"), F.col("left_").cast("double")) / F.col("v_")) + 2, F.col("left_"))).otherwise(F.lit(0))
    q = p.where(more > 0).select(*group, key, "left_", F.explode(F.sequence(F.col("sure_"), F.col("sure_") + more.cast("long") - 1)).alias("n_"), F.col(votes).cast("double").alias("x_"))
    q = q.withColumn("q_", F.col("x_") / (2 * F.col("n_") + 1))
    q = q.withColumn("r_", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("q_"), key, "n_"))).where("r_ <= left_ and q_ > 0")
    won = q.groupBy(*group, key).agg(F.count("*").alias("won_"))
    out = p.alias("p").join(won.alias("won"), [F.col(f"p.{c}") == F.col(f"won.{c}") for c in [*group, key]], "left")
    return out.select(*[F.col(f"p.{c}") for c in parties.columns], (F.col("p.sure_") + F.coalesce("won.won_", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 32, shards: int = 16, seed: str = "mix", size: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, shard, taken, copies) for every row of docs (doc_id, source, text).

    copies: the passes that take the document's first word, for callers that move whole documents. carry: columns passed on.
    """
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)) if size is None else size
    bucket = F.pmod(hash32(seed, F.col("doc_id")), F.lit(BUCKETS)).cast("int")
    # A key without nulls, in the order of sources: joins stay plain equalities and the null source comes last.
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    d = written(docs.select("doc_id", source.alias("source"), words.cast("long").alias("size"), bucket.alias("bucket"), order.alias("order_"), *carry), "mix")
    per = BUCKETS // shards
    cells = d.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    cells = cells.withColumn("shard", F.floor(F.col("bucket") / per).cast("int"))
    in_cell = Window.partitionBy("source", "shard")
    cells = cells.withColumn("start", F.coalesce(F.sum("n").over(in_cell.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("cell", F.sum("n").over(in_cell))
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    everything = targets.withColumn("seats", F.floor(F.sum("source_size").over(Window.partitionBy()) / block))
    by_source = apportion(everything, [], "rank", "target", "seats").withColumnRenamed("quota", "blocks")
    parts = cells.select("source", "shard", "cell").distinct()
    parts = parts.join(by_source, "source").select("source", "rank", "source_size", "target", "blocks", "shard", "cell")
    quota = apportion(parts, ["rank"], "shard", "cell", "blocks")
    quota = quota.withColumn("take", F.least(F.col("quota") * block, most * F.col("cell")))
    first = F.pmod(hash32(seed, F.col("rank"), F.col("shard")), F.greatest(F.ceil(F.col("cell") / block), F.lit(1))) * block
    quota = quota.withColumn("passes", F.when(F.col("cell") > 0, F.floor(F.col("take") / F.col("cell"))).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.col("take") - F.col("passes") * F.col("cell")).withColumn("from_", first)
    plan = cells.select("source", "bucket", "shard", "start").join(quota.select("source", "shard", "cell", "source_size", "target", "passes", "rest", "from_"), ["source", "shard"])
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("order_", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = d.withColumn("before", before).join(plan, ["source", "bucket"])
    a, e = F.col("start") + F.col("before"), F.col("start") + F.col("before") + F.col("size")
    stop = F.col("from_") + F.col("rest")
    part = F.greatest(F.lit(0), F.least(e, stop) - F.greatest(a, F.col("from_"))) + F.greatest(F.lit(0), F.least(e, stop - F.col("cell")) - a)
    first_in = ((a >= F.col("from_")) & (a < stop)) | (a < stop - F.col("cell"))
    return out.select("doc_id", F.when(F.col("source") != "~", F.substring("source", 2, 1 << 30)).alias("source"), "size", "source_size", "target", "shard", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"), F.when(F.col("size") > 0, F.col("passes") + first_in.cast("int")).otherwise(1).cast("int").alias("copies"), *carry)
