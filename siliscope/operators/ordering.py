"""Running totals, row numbers and exact quantiles over groups of any size.

A window that orders a whole group puts it into one task. Here equal values are counted first, the counts are range
partitioned, each range is summed on its own and shifted by the totals of the ranges before it, so a group that holds
most of the data is spread over many tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siliscope.sources.staging import stage


def running_totals(df: DataFrame, group: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Add ``<name>_before``: the sum of each column over the earlier rows of its group.

    ``order`` must be unique within the group.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(partitions, *group, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and group: ranges are few, and a group spans consecutive ones
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("_range", *group).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums]).select(
        "_range", *group, *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in sums])
    local = ranged.withColumns({f"_l_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    joined = local.join(shifts, ["_range", *group])
    return joined.select(*df.columns, *[(F.col(f"_l_{c}") + F.col(f"_s_{c}")).alias(f"{c}_before") for c in sums])


def row_index(df: DataFrame, order: list[str], name: str = "idx", group: list[str] | None = None) -> DataFrame:
    """Dense zero-based position in the given unique order."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("long")), group or [], order, ["_one"])
    return counted.withColumnRenamed("_one_before", name).drop("_one")


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group, exact; one output column per entry of ``probs``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, group, ["_v"], ["_n"])
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    rows = placed.join(sizes, group)

    def at(position: Column) -> Column:
        held = (F.col("_n_before") <= position) & (position < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(held, F.col("_v")))

    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        share = F.max(pos - F.floor(pos))
        out.append((low + (high - low) * share).alias(name))
    return rows.groupBy(*group).agg(*out)
