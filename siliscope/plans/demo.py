"""Wafer tables that Spark derives from the star-schema tables by integer arithmetic.

One wafer per 3,750 line items (sixteen at least), 24x24 pixels, 4x4-pixel chips on a 6x6 grid. The defect pattern of a
wafer follows from its number, the noise from its line items, so the wafer tables grow with ``lineitem``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siliscope.functions.columns import flag
from siliscope.plans.registry import part

SIDE, CHIP, GRID = 24, 4, 6
GEOMETRY = {"height": SIDE, "width": SIDE, "chip_h": CHIP, "chip_w": CHIP, "rows": GRID, "cols": GRID, "net_die": 32}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wafer_count(spark: SparkSession, sf: str) -> int:
    return max(16, table(spark, sf, "lineitem").count() // 3750)


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel table: masks, grade, class flags and the squared wafer extent (in quarter pixels)."""
    n = wafer_count(spark, sf)
    area = SIDE * SIDE
    empty = spark.range(n * area).select(
        F.floor(F.col("id") / area).cast("long").alias("w"),
        F.floor((F.col("id") % area) / SIDE).cast("int").alias("y"),
        (F.col("id") % SIDE).cast("int").alias("x"),
        F.lit(0).cast("long").alias("h"),
    )
    hits = table(spark, sf, "lineitem").select(
        F.pmod(F.col("l_orderkey"), F.lit(n)).cast("long").alias("w"),
        F.pmod(F.col("l_partkey"), F.lit(SIDE)).cast("int").alias("y"),
        F.pmod(3 * F.col("l_suppkey") + F.col("l_linenumber"), F.lit(SIDE)).cast("int").alias("x"),
        (F.col("l_quantity").cast("long") + F.col("l_partkey")).alias("h"),
    )
    w, y, x, h = F.col("w"), F.col("y"), F.col("x"), F.col("h")
    r, c, chip_d2, d2 = F.col("chip_row"), F.col("chip_col"), F.col("chip_d2"), F.col("d2")
    # step by step, so that what several flags need is worked out once: code of more than 8,000 bytes is never compiled by the JVM
    placed = (
        empty.unionByName(hits).groupBy("w", "y", "x").agg(F.sum("h").alias("h"))
        .select("w", "y", "x", "h", F.floor(y / CHIP).cast("int").alias("chip_row"), F.floor(x / CHIP).cast("int").alias("chip_col"))
        .select("*", ((2 * r - 5) * (2 * r - 5) + (2 * c - 5) * (2 * c - 5)).alias("chip_d2"),
                ((2 * y - 23) * (2 * y - 23) + (2 * x - 23) * (2 * x - 23)).cast("int").alias("d2")))
    base = (
        placed
        .select("w", "y", "x", "h", "chip_row", "chip_col",
                flag(chip_d2 <= 36).alias("in_wafer"), "d2",
                flag((F.pmod(3 * w, F.lit(5)) < 2) & (x - y == 4) & x.between(8, 20)).alias("scratch"),
                flag((F.pmod(5 * w + 1, F.lit(7)) < 3) & d2.between(100, 196)).alias("ring"),
                flag((F.pmod(7 * w + 2, F.lit(5)) < 2) & (chip_d2 >= 25) & (c >= 3)).alias("edge"),
                flag((F.pmod(2 * w + 3, F.lit(3)) < 2) & (r == 1 + F.pmod(w, F.lit(3)))
                     & (c == 2 + F.pmod(w, F.lit(2)))).alias("local"),
                flag((F.pmod(w + 1, F.lit(4)) < 2) & (F.pmod(r, F.lit(3)) == 2)
                     & (F.pmod(c, F.lit(2)) == 0)).alias("shot_grid"),
                flag((chip_d2 <= 36) & (F.pmod(7 * w + 5 * r + 3 * c, F.lit(17)) == 0)
                     & (F.pmod(w, F.lit(4)) != 0)).alias("stby"))
    )
    anyp = F.greatest("scratch", "ring", "edge", "local", "shot_grid")
    valid = (F.col("in_wafer") == 1) & (F.col("stby") == 0)
    noise = F.when(F.pmod(h, F.lit(3)) == 0, F.pmod(h, F.lit(8))).otherwise(F.lit(0))
    return base.select(
        F.concat(F.lit("W"), F.lpad(w.cast("string"), 9, "0")).alias("sample_id"), "w",
        F.floor(w / 4).cast("long").alias("lot_id"), "y", "x", "h", "chip_row", "chip_col", "in_wafer",
        flag(valid).alias("valid"), "stby",
        F.when(valid, F.least(F.lit(7), noise + 3 * anyp)).otherwise(F.lit(0)).cast("int").alias("severity"),
        "scratch", "ring", "edge", "local", F.lit(0).alias("random"), "shot_grid",
        F.col("stby").alias("stby_pattern"), "d2",
        F.lit(WAFER_EXTENT).alias("wafer_extent"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"),
    )


# squared distance of the farthest in-wafer pixel, in quarter pixels; a property of the product geometry
WAFER_EXTENT = max(
    (2 * y - 23) ** 2 + (2 * x - 23) ** 2
    for y in range(SIDE) for x in range(SIDE)
    if (2 * (y // CHIP) - 5) ** 2 + (2 * (x // CHIP) - 5) ** 2 <= 36
)

part("nw", "SELECT greatest(16, count(*) // 3750)::BIGINT AS n FROM lineitem")
part("hits", """
SELECT l_orderkey % n AS w, (l_partkey % 24)::INT AS y, ((3 * l_suppkey + l_linenumber) % 24)::INT AS x,
       sum(l_quantity::BIGINT + l_partkey)::BIGINT AS h
FROM lineitem, nw GROUP BY 1, 2, 3""", ("nw",))
part("grid", """
SELECT a.w, b.y::INT AS y, c.x::INT AS x
FROM (SELECT unnest(range(n)) AS w FROM nw) a, (SELECT unnest(range(24)) AS y) b, (SELECT unnest(range(24)) AS x) c
""", ("nw",))
part("px0", """
SELECT g.w, g.y, g.x, coalesce(t.h, 0) AS h, g.y // 4 AS chip_row, g.x // 4 AS chip_col,
       ((2*(g.y//4)-5)*(2*(g.y//4)-5) + (2*(g.x//4)-5)*(2*(g.x//4)-5)) AS cd2,
       ((2*g.y-23)*(2*g.y-23) + (2*g.x-23)*(2*g.x-23)) AS d2
FROM grid g LEFT JOIN hits t ON t.w = g.w AND t.y = g.y AND t.x = g.x""", ("grid", "hits"))
part("px1", """
SELECT *, (cd2 <= 36)::INT AS in_wafer,
  (cd2 <= 36 AND (7*w + 5*chip_row + 3*chip_col) % 17 = 0 AND w % 4 <> 0)::INT AS stby,
  ((3*w) % 5 < 2 AND x - y = 4 AND x BETWEEN 8 AND 20)::INT AS scratch,
  ((5*w + 1) % 7 < 3 AND d2 BETWEEN 100 AND 196)::INT AS ring,
  ((7*w + 2) % 5 < 2 AND cd2 >= 25 AND chip_col >= 3)::INT AS edge,
  ((2*w + 3) % 3 < 2 AND chip_row = 1 + w % 3 AND chip_col = 2 + w % 2)::INT AS local,
  ((w + 1) % 4 < 2 AND chip_row % 3 = 2 AND chip_col % 2 = 0)::INT AS shot_grid
FROM px0""", ("px0",))
part("px", """
SELECT 'W' || lpad(w::VARCHAR, 9, '0') AS sample_id, w, w // 4 AS lot_id, y, x, h, chip_row, chip_col, in_wafer,
  (in_wafer = 1 AND stby = 0)::INT AS valid, stby,
  CASE WHEN in_wafer = 1 AND stby = 0 THEN least(7, (CASE WHEN h % 3 = 0 THEN h % 8 ELSE 0 END)
     + 3 * greatest(scratch, ring, edge, local, shot_grid))::INT ELSE 0 END AS severity,
  scratch, ring, edge, local, 0 AS random, shot_grid, stby AS stby_pattern, d2,
  max(CASE WHEN in_wafer = 1 THEN d2 END) OVER (PARTITION BY w) AS wafer_extent, 24 AS height, 24 AS width
FROM px1""", ("px1",))
part("pol", """
SELECT *, least(sqrt(d2::DOUBLE) / greatest(sqrt(wafer_extent::DOUBLE), 2.0), 0.999) AS radius,
  fmod(atan2(x - 11.5, -(y - 11.5)) + 2*pi(), 2*pi()) / (2*pi()) AS theta
FROM px""", ("px",))
