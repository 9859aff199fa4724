"""Queries op3, op4 and op9: no SQL expresses them, so they are tested by brute force and held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm._session import table
from strandflow.llm.langid_ppm import identify, train
from strandflow.llm.latent_decontamination import leaks
from strandflow.llm.pii_disclosure import all_spans, spans_text


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item: all documents against all items."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 3).alias("cosine"), "lcs", "answer")


def op4_langid_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op9_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's entities and the terms that reveal them."""
    found = all_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans_text("spans").alias("spans"))


QUERIES = {"op3_latent_decontamination": op3_latent_decontamination, "op4_langid_ppm": op4_langid_ppm, "op9_pii_disclosure": op9_pii_disclosure}
ORACLES: dict[str, str] = {}
