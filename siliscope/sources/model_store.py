"""Versioned store of encoders: weights, input scale and the wafers an encoder is to be compared with, as two tables.

``<path>/reference/version=N`` holds a version's reference embeddings, ``<path>/model/version=N`` one row with its arrays. A version's
model is written after its reference, so a version that can be seen is whole; a version is never written twice, so of two
programs that publish at once one fails and nothing is mixed.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siliscope.operators.models import Encoder

MODEL_VERSION = "encoder/v1"
ARRAYS = ("mean", "scale", "w1", "b1", "w2", "b2", "wc", "bc")
FIELDS = "format string, labels array<string>, output_size int, input int, hidden int, embedding int, " + ", ".join(f"{n} array<double>" for n in ARRAYS)
REFERENCE = "id string, embedding array<double>, y array<int>"


def _exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    if not _exists(spark, f"{path}/model"):
        return []
    return sorted(r[0] for r in spark.read.schema(f"{FIELDS}, version int").parquet(f"{path}/model").select("version").distinct().collect())


def save(spark: SparkSession, model: Encoder, path: str, reference: DataFrame | None = None, output_size: int = 0) -> int:
    """Publish an encoder as the next version and return its number.

    ``reference`` holds (id, embedding, y) of the wafers that new ones are to be compared with; ``output_size`` is the side of the
    grid its input tensor was pooled to (0 if the input is no tensor).
    """
    version = max(versions(spark, path), default=0) + 1
    dims = (int(output_size), model.w1.shape[0], model.w1.shape[1], model.w2.shape[1])
    row = (MODEL_VERSION, list(model.labels), *map(int, dims), *[getattr(model, n).ravel().astype(float).tolist() for n in ARRAYS])
    if reference is not None:
        reference.select(F.col("id").cast("string").alias("id"), "embedding", F.col("y").cast("array<int>").alias("y")).write.mode(
            "errorifexists").parquet(f"{path}/reference/version={version}")
    spark.createDataFrame([row], FIELDS).write.mode("errorifexists").parquet(f"{path}/model/version={version}")
    return version


def _row(spark: SparkSession, path: str, version: int | None):
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {version or ''} of a model at {path}".replace("  ", " "))
    row = spark.read.schema(FIELDS).parquet(f"{path}/model/version={version or known[-1]}").first()
    if row is None or row["format"] != MODEL_VERSION:
        raise ValueError("unknown model version")
    return row


def load(spark: SparkSession, path: str, version: int | None = None) -> Encoder:
    """A published encoder, the latest unless a version is named; arrays of unexpected size are refused."""
    row = _row(spark, path, version)
    i, h, e, c = row["input"], row["hidden"], row["embedding"], len(row["labels"])
    shapes = {"mean": (i,), "scale": (i,), "w1": (i, h), "b1": (h,), "w2": (h, e), "b2": (e,), "wc": (e, c), "bc": (c,)}
    wrong = [n for n, s in shapes.items() if row[n] is None or len(row[n]) != int(np.prod(s))]
    if wrong:
        raise ValueError(f"model arrays of unexpected size: {wrong}")
    return Encoder(**{n: np.array(row[n]).reshape(s) for n, s in shapes.items()}, labels=tuple(row["labels"]))


def output_size(spark: SparkSession, path: str, version: int | None = None) -> int:
    return _row(spark, path, version)["output_size"]


def load_reference(spark: SparkSession, path: str, model: Encoder, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The reference set of a version and its rows of unexpected width; both empty if it was published without one."""
    folder = f"{path}/reference/version={version or max(versions(spark, path), default=0)}"
    ref = spark.read.schema(REFERENCE).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], REFERENCE)
    odd = F.coalesce((F.size("embedding") != model.w2.shape[1]) | (F.size("y") != len(model.labels)), F.lit(True))
    return ref.filter(~odd), ref.filter(odd)
