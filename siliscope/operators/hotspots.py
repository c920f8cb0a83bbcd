"""Positions that fail again and again within a lot, with control of the false-discovery rate."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling series after shifting the argument above ten."""
    x = x.astype(float).copy()
    shift = np.zeros_like(x)
    while True:
        small = x < 10.0
        if not small.any():
            break
        shift[small] -= np.log(x[small])
        x[small] += 1.0
    i2 = 1.0 / (x * x)
    series = (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188)))) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h *= step
        if np.all(np.abs(step - 1.0) < 1e-15):
            return h
    raise ArithmeticError("the continued fraction has not settled after 100,000 terms")


def binomial_tail(observed: np.ndarray, trials: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """P(X >= observed) of a binomial, by the incomplete beta function: cost does not grow with the lot size."""
    k, n, p = observed.astype(float), trials.astype(float), rate.astype(float)
    out = np.where(k <= 0, 1.0, 0.0)
    inside = (k > 0) & (k <= n)
    if inside.any():
        a, b, x = k[inside], n[inside] - k[inside] + 1.0, p[inside]
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
        left = x < (a + 1.0) / (a + b + 2.0)
        value = np.empty_like(x)
        if left.any():
            value[left] = front[left] * _beta_fraction(a[left], b[left], x[left]) / a[left]
        if (~left).any():
            r = ~left
            value[r] = 1.0 - front[r] * _beta_fraction(b[r], a[r], 1.0 - x[r]) / b[r]
        out[inside] = np.clip(value, 0.0, 1.0)
    return out


def benjamini_hochberg(rows: DataFrame, group: str, p: str, tests: str, tie: list[str]) -> DataFrame:
    """q-values per group. ``tests`` is the number of tests of the group; tests that are not listed have p = 1.

    A group here is the cells of one map, so its ordered windows are bounded by the map size.
    """
    up = Window.partitionBy(group).orderBy(F.col(p), *tie)
    down = (Window.partitionBy(group).orderBy(F.col(p).desc(), *[F.col(t).desc() for t in tie])
            .rowsBetween(Window.unboundedPreceding, 0))
    return (rows.withColumn("_k", F.row_number().over(up))
            .withColumn("q_value", F.least(F.lit(1.0), F.min(F.col(p) * F.col(tests) / F.col("_k")).over(down)))
            .drop("_k"))


def hot_cells(pixels: DataFrame, block: int, hot_grade: int, exclude: str | None = None) -> DataFrame:
    """Blocks with at least one hot pixel, one row per wafer and block; excluded pixels never count as hot."""
    hot = F.col("severity") >= hot_grade
    if exclude is not None:
        hot = hot & (F.col(exclude) == 0)
    return (pixels.filter(hot).groupBy("lot_id", "sample_id", F.floor(F.col("y") / block).cast("int").alias("cy"),
                                       F.floor(F.col("x") / block).cast("int").alias("cx")).agg(F.lit(1).alias("hot")))


def hotspot_cells(pixels: DataFrame, height: int, width: int, block: int = 4, hot_grade: int = 4,
                  exclude: str | None = None) -> DataFrame:
    """Per lot and block that is hot at least once in the lot: count, rate elsewhere, lift, z, tail and q-value."""
    wafers = pixels.select("lot_id", "sample_id").distinct()
    sizes = wafers.groupBy("lot_id").agg(F.count(F.lit(1)).alias("n_lot"))
    total = wafers.agg(F.count(F.lit(1))).scalar()
    cells = (height // block) * (width // block)
    seen = hot_cells(pixels, block, hot_grade, exclude).groupBy("lot_id", "cy", "cx").agg(F.count(F.lit(1)).alias("observed"))
    everywhere = seen.groupBy("cy", "cx").agg(F.sum("observed").alias("all_hot"))
    obs, n = F.col("observed"), F.col("n_lot")
    elsewhere = F.when(F.col("total") - n > 0, (F.col("all_hot") - obs) / (F.col("total") - n)).otherwise(F.lit(0.0))
    base = F.least(F.greatest(elsewhere, F.lit(1e-4)), F.lit(0.99))

    @F.pandas_udf("double")
    def tail(k: pd.Series, trials: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series(binomial_tail(k.to_numpy(), trials.to_numpy(), rate.to_numpy()))

    rows = (seen.join(sizes, "lot_id").join(everywhere, ["cy", "cx"]).withColumn("total", total)
            .withColumn("baseline_rate", base))
    b = F.col("baseline_rate")
    rated = rows.select(
        "lot_id", "cy", "cx", "observed", "n_lot", "baseline_rate", (obs / n).alias("observed_rate"), (obs / n / b).alias("lift"),
        ((obs - n * b) / F.sqrt(n * b * (1.0 - b) + 1e-4)).alias("z_score"), tail(obs, n, b).alias("p_value"),
        F.lit(cells).alias("tests"))
    return benjamini_hochberg(rated, "lot_id", "p_value", "tests", ["cy", "cx"]).drop("tests")


def repeating_hotspots(cells: DataFrame, height: int, width: int, block: int, top: int = 20, min_count: int = 5,
                       min_share: float = 0.25, min_lift: float = 3.0, max_q: float = 0.05) -> DataFrame:
    """The significant cells of all lots in order of q, lift and rate, with their place on the wafer."""
    enough = F.col("observed") >= F.greatest(F.lit(min_count), F.floor(F.col("n_lot") * min_share))
    kept = cells.filter(enough & (F.col("lift") >= min_lift) & (F.col("q_value") <= max_q))
    px, py = (F.floor(F.col(c) * block + block / 2.0).cast("int") for c in ("cx", "cy"))
    dx, dy = px - width / 2.0, py - height / 2.0
    return (kept.withColumns({"x_pixel": px, "y_pixel": py, "radius_pixel": F.sqrt(dx * dx + dy * dy),
                              "theta_deg": F.degrees(F.atan2(dy, dx))})
            .orderBy(F.round("q_value", 12), F.round("lift", 9).desc(), F.col("observed_rate").desc(), "lot_id", "cy", "cx").limit(top))
