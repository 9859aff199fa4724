"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots. Bytes are aggregated per slot, and a
versioned slot-to-shard map, a table of at most `slots` rows, places whole slots. Rebalancing edits the
map; records keep their slots for ever. All of it is DataFrame functions. The map is a stored table: `save_map` adds a version as
a folder of Parquet, `load_map` reads one or the latest, and `grow` reads the latest, gives slots to one more shard and stores
the result as the next version.

Defined results: null text has 0 bytes (its record still counts the fixed overhead) and CRC-32 0; a null
key hashes as the empty string; repeated rows share a slot and get places of their own; an empty table
gives an empty map and no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.llm._store import shared_dir, written

SLOTS = 4096
OVERHEAD = 16


def hash32(*parts: Column | str) -> Column:
    """The first 32 bits of an MD5, as a long: the same in any SQL engine."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(hash32(key), F.lit(slots)).cast("int")


def slot_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, records) of every slot that has records: partial sums before the shuffle, `slots` rows after."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    return docs.select(slot_of(F.col(key), slots).alias("slot"), size.alias("bytes")).groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("records"))


def _ordered(slot_sizes: DataFrame, *more: str) -> DataFrame:
    """One row: the slots as an array, largest first. At most `slots` entries, whatever the data's size."""
    fields = ", ".join(["'down', -bytes", "'slot', slot", *(f"'{c}', {c}" for c in more)])
    return slot_sizes.agg(F.array_sort(F.collect_list(F.expr(f"named_struct({fields})"))).alias("s"))


def new_map(slot_sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map (version, slot, shard, bytes): the largest slot left goes to the lightest shard."""
    fold = f"""
        aggregate(s, named_struct('loads', array_repeat(0L, {shards}), 'to', cast(array() as array<int>)),
            (a, x) -> named_struct(
                'loads', transform(a.loads, (v, j) -> if(j = array_position(a.loads, array_min(a.loads)) - 1, v - x.down, v)),
                'to', array_append(a.to, cast(array_position(a.loads, array_min(a.loads)) - 1 as int))),
            a -> a.to)"""
    return _ordered(slot_sizes).select(F.explode(F.arrays_zip("s", F.expr(fold).alias("shard"))).alias("p")).select(F.lit(1).alias("version"), F.col("p.s.slot").alias("slot"), F.col("p.shard").alias("shard"), (-F.col("p.s.down")).alias("bytes"))


def add_shard(slot_map: DataFrame, slot_sizes: DataFrame, shards: int) -> DataFrame:
    """The next version for shards + 1: the new shard takes slots from shards above the new mean, nothing else moves."""
    fresh = slot_sizes.select("slot", "bytes").join(F.broadcast(slot_map.select("slot", "shard", "version")), "slot", "left")
    fresh = fresh.select("slot", "bytes", F.coalesce("shard", F.pmod("slot", F.lit(shards))).alias("shard"), F.coalesce("version", F.lit(0)).alias("version"))
    one = _ordered(fresh, "shard", "version").withColumn("total", F.expr("aggregate(s, 0L, (t, y) -> t - y.down)"))
    one = one.withColumn("loads", F.expr(f"aggregate(s, array_repeat(0L, {shards + 1}), (a, y) -> transform(a, (v, j) -> if(j = y.shard, v - y.down, v)))"))
    fold = f"""
        aggregate(s, named_struct('loads', loads, 'to', cast(array() as array<int>)),
            (a, x) -> if(a.loads[x.shard] * {shards + 1} > total and (a.loads[{shards}] - x.down) * {shards + 1} <= total,
                named_struct('loads', transform(a.loads, (v, j) -> case when j = x.shard then v + x.down when j = {shards} then v - x.down else v end), 'to', array_append(a.to, {shards})),
                named_struct('loads', a.loads, 'to', array_append(a.to, x.shard))),
            a -> a.to)"""
    return one.select(F.explode(F.arrays_zip("s", F.expr(fold).alias("to"))).alias("p")).select((F.col("p.s.version") + 1).alias("version"), F.col("p.s.slot").alias("slot"), F.col("p.to").alias("shard"), (-F.col("p.s.down")).alias("bytes"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Stores the map's version beside those that are there; a version is never overwritten."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, or the latest."""
    held = spark.read.schema("slot int, shard int, bytes long, version int").parquet(path)
    return held.where(F.col("version") == version) if version else held.join(F.broadcast(held.agg(F.max("version").alias("version"))), "version")


def grow(slot_sizes: DataFrame, path: str, shards: int) -> None:
    """Stores the next version of the map at `path`, with shards + 1 shards."""
    save_map(written(add_shard(load_map(slot_sizes.sparkSession, path), slot_sizes, shards), "slot_map"), path)


def place(docs: DataFrame, slot_map: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, virtual_slot, version, shard, place): place is gapless from 0 in each shard.

    The map has at most `slots` rows, so it is broadcast. Rows are numbered within their virtual slot, and
    slots within their shard, so no task needs a whole shard.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long")
    rows = docs.select(F.col(key), size.alias("size"), crc.alias("text_crc32"), slot_of(F.col(key), slots).alias("virtual_slot"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("virtual_slot").orderBy(key, "text_crc32")))
    counts = slot_map.select("version", "slot", "shard", "records")
    before = F.sum("records").over(Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).withColumnRenamed("slot", "virtual_slot")
    out = rows.join(F.broadcast(counts), "virtual_slot")
    return out.select(key, "size", "text_crc32", "virtual_slot", "version", "shard", (F.col("before") + F.col("at") - 1).alias("place"))


def stored_map(docs: DataFrame, shards: int, key: str, text: str, slots: int, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes, map): the slots' bytes, written once, and version 1 of the map as stored at path (a folder of its own where none is given)."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/slot_map-{uuid.uuid4().hex}"
    sizes = written(slot_bytes(docs, key, text, slots), "slot_bytes")
    save_map(new_map(sizes, shards), path)
    return sizes, load_map(spark, path)


def assign(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """docs with virtual_slot and shard as last columns (in place of any of these names)."""
    _, slot_map = stored_map(docs, shards, key, text, slots, path)
    rows = docs.drop("virtual_slot", "shard").withColumn("virtual_slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(slot_map.select(F.col("slot").alias("virtual_slot"), "shard")), "virtual_slot").select(*[c for c in rows.columns if c != "virtual_slot"], "virtual_slot", "shard")


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Slots, stored map and places in one call."""
    sizes, slot_map = stored_map(docs, shards, key, text, slots, path)
    return place(docs, slot_map.join(F.broadcast(sizes.select("slot", "records")), "slot"), key, text, slots)
