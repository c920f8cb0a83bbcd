"""Small helpers that the operators of this subpackage share."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: texts go to Python workers in batches of about so many bytes, so that neither side holds many long texts at once
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The whole text; a missing one is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(df: DataFrame) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES; a lower one is kept."""
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def tasks(df: DataFrame) -> int:
    """How many tasks the session deals a shuffle to."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo a divisor: the fold of a record."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys in sorted rows."""
    n = len(keys[0])
    if not n:
        return
    change = np.zeros(n, bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(change)
    yield from zip(starts.tolist(), [*starts[1:].tolist(), n])


def pieces(count: int, size: int) -> int:
    return max(1, math.ceil(count / size))
