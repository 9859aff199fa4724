"""Engine tables over the generic tables at hand (embeddings as a trajectory, events and lineitem as series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.plans.op import Source

SCALE = 40.0
ATOMS = 21
CODES = ("SUJ2", "AL7075", "Ti6Al4V", "SS316L", "unlisted")
_IDS = "(SELECT unnest(range(0, max(len(embedding)) // 3)) AS a FROM embeddings) r"


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is a frame of 21 atoms."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: (F.get("embedding", F.col("atom_id") * 3 + k).cast("double") * SCALE)
    rows = e.select(F.col("vec_id").cast("int").alias("frame"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(ATOMS - 1))).alias("atom_id"))
    return rows.select(F.lit("run0").alias("run_id"), "frame", "atom_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def _atom_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): the atoms of the longest embedding."""
    longest = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.floor(F.max(F.size("embedding")) / 3).cast("int").alias("n"))
    return longest.select(F.explode(F.expr("if(n > 0, sequence(0, n - 1), array())")).alias("id"))


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three atoms."""
    return _atom_ids(spark, sf_dir).select(F.lit("residue").alias("kind"), F.floor(F.col("id") / 3).cast("int").alias("group_id"), F.col("id").alias("atom_id"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine atoms as the healthy region 0, then groups of four."""
    gid = F.when(F.col("id") < 9, 0).otherwise(1 + F.floor((F.col("id") - 9) / 4)).cast("int")
    return _atom_ids(spark, sf_dir).select(F.lit("cluster").alias("kind"), gid.alias("group_id"), F.col("id").alias("atom_id"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types Fe, C and Cr by position; every third atom is backbone."""
    kind = F.when(F.col("id") < 15, "Fe").when(F.col("id") < 18, "C").otherwise("Cr")
    return _atom_ids(spark, sf_dir).select(F.lit("run0").alias("run_id"), F.col("id").alias("atom_id"), kind.alias("atom_type"), (F.col("id") % 3 == 0).alias("is_backbone"))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, code): the material that a part asks for, by its size; some are unknown."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS part", f"element_at(array({', '.join(repr(c) for c in CODES)}), cast(p_size % {len(CODES)} as int) + 1) AS code")


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinetic-to-potential ratios per day and cluster from lineitem; cells without rows are 1."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("d"), (F.col("l_suppkey") % 5).cast("int").alias("cluster_id"), F.col("l_quantity").cast("double").alias("q"))
    first = l.agg(F.min("d").alias("first"), F.max("d").alias("last"))
    cells = first.select(F.explode(F.sequence(F.lit(0), F.datediff("last", "first"))).alias("frame"), "first").crossJoin(spark.range(5).select(F.col("id").cast("int").alias("cluster_id")))  # five ids
    mean = l.groupBy("d", "cluster_id").agg((F.avg("q") / 20).alias("kv"))
    out = cells.withColumn("d", F.date_add("first", F.col("frame"))).join(mean, ["d", "cluster_id"], "left")
    return out.select(F.lit("run0").alias("run_id"), "frame", "cluster_id", F.coalesce("kv", F.lit(1.0)).alias("kv_ratio"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means and counts of events per type, from the day of the first event to the end of the day of the last; hours without events are 0. A run per type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    span = e.agg(F.date_trunc("day", F.min("ts")).alias("start"), F.date_trunc("day", F.max("ts")).alias("end"))
    hours = span.select("start", ((F.unix_timestamp("end") - F.unix_timestamp("start")) / 3600 + 24).cast("int").alias("hours"))
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp("start")) / 3600).cast("int")
    h = e.crossJoin(F.broadcast(hours)).groupBy("event_type", hour.alias("frame")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))  # one row
    grid = e.select("event_type").distinct().crossJoin(F.broadcast(hours)).select("event_type", F.explode(F.sequence(F.lit(0), F.col("hours") - 1)).alias("frame"))
    out = grid.join(h, ["event_type", "frame"], "left")
    return out.select(F.col("event_type").alias("run_id"), "frame", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


TRAJ = Source("traj", trajectory, f"SELECT 'run0' AS run_id, vec_id::INT AS frame, atom_id::INT AS atom_id, embedding[3 * atom_id + 1]::DOUBLE * {SCALE} AS x, embedding[3 * atom_id + 2]::DOUBLE * {SCALE} AS y, embedding[3 * atom_id + 3]::DOUBLE * {SCALE} AS z FROM embeddings, range({ATOMS}) r(atom_id)")
RESIDUES = Source("residue_atoms", residues, f"SELECT 'residue' AS kind, (a // 3)::INT AS group_id, a::INT AS atom_id FROM {_IDS}")
CLUSTERS = Source("cluster_atoms", clusters, f"SELECT 'cluster' AS kind, (CASE WHEN a < 9 THEN 0 ELSE 1 + (a - 9) // 4 END)::INT AS group_id, a::INT AS atom_id FROM {_IDS}")
ATOMS_DIM = Source("atoms_dim", atoms, f"SELECT 'run0' AS run_id, a::INT AS atom_id, CASE WHEN a < 15 THEN 'Fe' WHEN a < 18 THEN 'C' ELSE 'Cr' END AS atom_type, a % 3 = 0 AS is_backbone FROM {_IDS}")
WANTED = Source("wanted_codes", wanted, f"SELECT p_partkey AS part, ([{', '.join(repr(c) for c in CODES)}])[p_size % {len(CODES)} + 1] AS code FROM part")
KV = Source("kv_table", kv, """SELECT 'run0' AS run_id, f::INT AS frame, c::INT AS cluster_id, coalesce(m.kv, 1.0) AS kv_ratio
    FROM (SELECT unnest(range(0, (datediff('day', a, b) + 1)::BIGINT)) AS f, a FROM (SELECT min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS b FROM lineitem)) g, range(5) r(c)
    LEFT JOIN (SELECT l_shipdate::DATE AS d, l_suppkey % 5 AS k, avg(l_quantity::DOUBLE) / 20 AS kv FROM lineitem GROUP BY 1, 2) m ON m.d = a + f::INT AND m.k = c""")
HOURLY = Source("hourly_series", hourly, """SELECT t.event_type AS run_id, f::INT AS frame, coalesce(h.v, 0.0) AS v, coalesce(h.n, 0)::BIGINT AS n
    FROM (SELECT DISTINCT event_type FROM events) t, (SELECT unnest(range(0, 24 * (datediff('day', min(ts::TIMESTAMP), max(ts::TIMESTAMP)) + 1)::BIGINT)) AS f FROM events) r
    LEFT JOIN (SELECT event_type, floor((epoch(ts::TIMESTAMP) - epoch(date_trunc('day', m.first))) / 3600)::INT AS hr, avg(value::DOUBLE) AS v, count(*) AS n FROM events, (SELECT min(ts::TIMESTAMP) AS first FROM events) m GROUP BY 1, 2) h ON h.event_type = t.event_type AND h.hr = f""")
