"""Materialise an intermediate table on shared storage, so a lost executor does not recompute its whole lineage."""
from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir.

    Only a session on one machine may go without one and gets a temporary folder; executors of a cluster could not share it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="siliscope-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared one, removed when the session's program ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.add(folder)
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    if folder not in _FOLDERS:
        return
    _FOLDERS.discard(folder)
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, slim: bool = False) -> DataFrame:
    """Write a table as Parquet into the shared folder, once, and read it back: columns not asked for are not read again.

    A ``slim`` table, a few bytes for each row of a wide one, is gathered into as few files as its size needs.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "stage")
    (df.hint("rebalance") if slim else df).write.parquet(folder)
    staged = spark.read.schema(df.schema).parquet(folder)
    staged._staged_folder = folder
    return staged


def release(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        folder = getattr(table, "_staged_folder", None)
        if folder:
            _remove(table.sparkSession, folder)


def stage_by(df: DataFrame, *keys: str) -> DataFrame:
    """Stage a table hash-partitioned by its keys, so that later grouping and joining on them needs no shuffle.

    The table is staged adaptively first, which settles how many partitions its size needs. A plan run adaptively does
    not pass its partitioning on to the staged table, so the placing by key then runs with a fixed plan of that width.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sized = stage(df.repartition(*keys))
    placed = sized.repartition(max(1, sized.rdd.getNumPartitions()), *keys)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        return placed.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        release(sized)
