"""Connected components of a link table, for tables of any size."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siliscope.sources.staging import stage

ROUNDS = 60


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that can be reached, for every node of the undirected links.

    Large-star and small-star steps in turn: every node hands its smallest neighbour to the others until each node is linked to
    the smallest of its component alone. Minima are combined before the shuffle; links are staged after each turn, so a lost
    executor costs one turn. Links with a null end or from a node to itself are left out.
    """
    x, y = F.col(a), F.col(b)
    now = stage(links.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(
        F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    mark = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(
            F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p")).select(
            F.col("p.v").alias("u"), F.col("p.m").alias("v")).filter("u <> v").distinct()
        now = stage(small)
        was, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
