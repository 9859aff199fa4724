"""Reading and writing the engine's tables in the formats trajectories come in."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.schema import SCHEMAS


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """A trajectory from .npy files of shape (frames, atoms, 3), one run a file; each task unpacks one file. Object arrays are refused."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != 3 or a.shape[2] != 3:
                    raise ValueError(f"{name}: the shape must be (frames, atoms, 3), not {a.shape}")
                run = name.rsplit("/", 1)[-1].removesuffix(".npy")
                for at in range(0, len(a), 1000):
                    part = a[at : at + 1000].astype(np.float64)
                    n, m = part.shape[:2]
                    yield pd.DataFrame({"run_id": run, "frame": np.repeat(np.arange(at, at + n, dtype="int32"), m), "atom_id": np.tile(np.arange(m, dtype="int32"), n), "x": part[:, :, 0].ravel(), "y": part[:, :, 1].ravel(), "z": part[:, :, 2].ravel()})

    return files.mapInPandas(unpack, SCHEMAS["trajectory"])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document of run metadata."""
    return spark.read.json(path, multiLine=True)


def read_groups(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """group_atoms from JSON maps of group id to a list of atom ids."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<int>>").alias("m"))
    return rows.select(F.explode("m").alias("g", "atoms")).select(F.lit(kind).alias("kind"), F.col("g").cast("int").alias("group_id"), F.explode("atoms").alias("atom_id"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Atom ids, one a line, to keep by a semi join."""
    return spark.read.text(path).select(F.col("value").cast("int").alias("atom_id")).where("atom_id is not null")


def keep_atoms(trajectory: DataFrame, atoms: DataFrame) -> DataFrame:
    return trajectory.join(atoms.select("atom_id").distinct(), "atom_id", "left_semi")


def write_links(links: DataFrame, path: str) -> None:
    """Edge lists, a folder per event where events are known."""
    out = links.write.mode("overwrite")
    (out.partitionBy("event_id") if "event_id" in links.columns else out).json(path)


def write_series(series: DataFrame, path: str) -> None:
    """Per-frame series as CSV with a header."""
    series.write.mode("overwrite").option("header", True).csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def write_view(trajectory: DataFrame, path: str, frames: int = 100) -> None:
    """The first frames as one JSON object per frame, for viewers."""
    first = trajectory.where(F.col("frame") < frames)
    packed = first.groupBy("run_id", "frame").agg(F.array_sort(F.collect_list(F.struct("atom_id", "x", "y", "z"))).alias("atoms"))
    packed.write.mode("overwrite").json(path)


def random_walk(spark: SparkSession, frames: int, atoms: int, seed: int = 42) -> DataFrame:
    """A seeded random walk: normal start of spread 10 and normal steps of spread 0.1, summed along each atom."""
    from pyspark.sql import Window

    cells = spark.range(frames * atoms).select((F.col("id") / atoms).cast("int").alias("frame"), (F.col("id") % atoms).cast("int").alias("atom_id"))
    w = Window.partitionBy("atom_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    steps = cells.select("frame", "atom_id", *[(F.randn(seed + k) * F.when(F.col("frame") == 0, 10.0).otherwise(0.1)).alias(c) for k, c in enumerate("xyz")])
    return steps.select(F.lit("walk").alias("run_id"), "frame", "atom_id", *[F.sum(c).over(w).alias(c) for c in "xyz"])
