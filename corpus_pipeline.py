"""The corpus pipeline: five stages of the llm subpackage over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. No SQL expresses the language
model or the latent search, so the pipeline is tested against brute force. Stages tell rows apart by a row number, so rows
that share a doc_id, or have none, are judged by their own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm._store import written
from strandflow.llm.jaccard_join import similar_documents
from strandflow.llm.langid_ppm import identify, train
from strandflow.llm.latent_decontamination import leaks
from strandflow.llm.mixing import mix
from strandflow.llm.sharding import assign

MIN_SCORE = 0.5
SHARDS = 40
ROW = "pipeline_row_"
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a posterior of MIN_SCORE; the model learns from their labels."""
    aside = {c: f"{c}_of_docs_" for c in docs.columns if c in ("lang_pred", "score")}
    out = identify(docs.withColumnsRenamed(aside), train(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return out.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number ROW that every scan repeats: a hash of file and place where docs is a plain scan of files, else written."""
    if docs._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            return docs.withColumn(ROW, F.xxhash64("_metadata.file_path", "_metadata.row_index"))
        except AnalysisException:  # not of files
            pass
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of the smallest doc_id of each group of similar ones; rows without a doc_id stay and remove none."""
    rows = numbered(docs)
    found = similar_documents(rows.where("doc_id is not null"), key=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    found = written(found.join(rows.select(ROW, "doc_id"), ROW), "found")
    stay = found.groupBy("component_id").agg(F.min(F.struct("doc_id", ROW)).getField(ROW).alias(ROW)).select(ROW)
    gone = found.select(ROW).join(stay, ROW, "left_anti")
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = numbered(docs)
    found = leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=ROW).select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(found, ROW, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its first word; whole documents move."""
    rows = numbered(docs)
    times = f"{ROW}times"
    plan = mix(rows, carry=(ROW,)).where("copies > 0").select(ROW, F.col("copies").alias(times))
    out = rows.join(plan, ROW).withColumn(times, F.explode(F.sequence(F.lit(1), times)))
    return out.select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard."""
    return assign(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_duplicates", one_of_similar),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
