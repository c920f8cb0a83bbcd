"""Wafer and chip geometry: polar positions, chip grids, wafer masks and chip numbering."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siliscope.functions.columns import clock_turn, flag


@dataclass(frozen=True)
class Geometry:
    """Size of the map; each field is a number, or the name of a column when products are mixed."""

    height: int | str
    width: int | str
    chip_h: int | str
    chip_w: int | str
    rows: int | str
    cols: int | str
    net_die: int | str = 0

    def col(self, field: str) -> Column:
        value = getattr(self, field)
        return F.col(value) if isinstance(value, str) else F.lit(value)


def with_wafer_extent(pixels: DataFrame, mask: str = "in_wafer") -> DataFrame:
    """Add the squared distance (quarter pixels) of the farthest masked pixel of each wafer.

    Sources emit this column while they hold the whole wafer; this is the way for tables that lack it.
    """
    w = Window.partitionBy("sample_id")
    d2 = quarter_d2(F.col("y"), F.col("x"), F.col("height"), F.col("width"))
    return (pixels.withColumn("d2", d2)
            .withColumn("wafer_extent", F.max(F.when(F.col(mask) == 1, F.col("d2"))).over(w)))


def quarter_d2(y: Column, x: Column, height: Column, width: Column) -> Column:
    dy, dx = 2 * y - (height - 1), 2 * x - (width - 1)
    return (dy * dy + dx * dx).cast("int")


def pixel_dx(width: Column | None = None) -> Column:
    return F.col("x") - (F.col("width") - 1) / 2.0


def pixel_dy() -> Column:
    return F.col("y") - (F.col("height") - 1) / 2.0


def scaled_radius(d2: Column, extent: Column) -> Column:
    """Distance over the largest distance; lengths are doubled pixels, so the floor of one pixel is 2."""
    return F.sqrt(d2.cast("double")) / F.greatest(F.sqrt(F.coalesce(extent, F.lit(4)).cast("double")), F.lit(2.0))


def with_polar(pixels: DataFrame) -> DataFrame:
    """Pixel radius in [0, 0.999] and clockwise angle in turns."""
    df = pixels if "wafer_extent" in pixels.columns else with_wafer_extent(pixels)
    return df.select(
        "*",
        F.least(scaled_radius(F.col("d2"), F.col("wafer_extent")), F.lit(0.999)).alias("radius"),
        clock_turn(pixel_dx(), pixel_dy()).alias("theta"),
    )


def chip_of_pixel(pixels: DataFrame, geo: Geometry) -> DataFrame:
    return pixels.withColumns({
        "chip_row": F.floor(F.col("y") / geo.col("chip_h")).cast("int"),
        "chip_col": F.floor(F.col("x") / geo.col("chip_w")).cast("int"),
    })


def chips(pixels: DataFrame, geo: Geometry) -> DataFrame:
    """One row per chip: counts, mean grade over tested pixels, and the doubled offset from the wafer centre.

    The pixel rows are combined before the shuffle, so a wafer moves as its few hundred chips.
    """
    valid, wafer = F.col("valid") == 1, F.col("in_wafer") == 1
    keyed = pixels.withColumns({
        "dx2": (geo.col("chip_w") * (2 * F.col("chip_col") + 1) - (F.col("width") - 1)).cast("int"),
        "dy2": (geo.col("chip_h") * (2 * F.col("chip_row") + 1) - (F.col("height") - 1)).cast("int"),
        "grid_rows": geo.col("rows"), "grid_cols": geo.col("cols"),
    })
    return (
        keyed.groupBy("sample_id", "chip_row", "chip_col", "dx2", "dy2", "grid_rows", "grid_cols")
        .agg(
            F.count(F.lit(1)).alias("n_px"),
            F.count_if(wafer).alias("n_wafer"),
            F.count_if(valid).alias("n_valid"),
            F.count_if(wafer & (F.col("stby") == 1)).alias("n_stby"),
            F.count_if(valid & (F.col("severity") > 0)).alias("n_fail"),
            F.sum(F.when(valid, F.col("severity")).otherwise(0)).alias("sev_sum"),
        )
        .withColumn("value", F.when(F.col("n_valid") > 0, F.col("sev_sum") / (F.lit(7.0) * F.col("n_valid")))
                    .otherwise(F.lit(0.0)))
        .withColumn("d2", (F.col("dx2") * F.col("dx2") + F.col("dy2") * F.col("dy2")).cast("int"))
    )


def by_wafer(chip_rows: DataFrame) -> DataFrame:
    """Bring each wafer's chips together once; every chip-level family below reuses this exchange."""
    return chip_rows.repartition("sample_id")


def with_chip_polar(chip_rows: DataFrame, mask: str) -> DataFrame:
    """Chip-centre radius over the farthest masked chip (not clipped) and angle in turns."""
    w = Window.partitionBy("sample_id")
    extent = F.max(F.when(F.col(mask) > 0, F.col("d2"))).over(w)
    return (chip_rows.withColumn("chip_extent", extent)
            .withColumn("radius", scaled_radius(F.col("d2"), F.col("chip_extent")))
            .withColumn("theta", clock_turn(F.col("dx2") / 2.0, F.col("dy2") / 2.0)))


def chip_grid(geometry: DataFrame) -> DataFrame:
    """All chip slots of each product; the geometry table has one row per product."""
    return (geometry
            .select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("chip_row"))
            .select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("chip_col")))


def inferred_wafer_chips(geometry: DataFrame) -> DataFrame:
    """Which chip slots belong to the wafer: the net-die nearest slots, or those inside the unit ellipse.

    Ranked within one product's grid, so a window never holds more rows than a wafer has chips.
    """
    y = ((F.col("chip_row") + 0.5) / F.col("rows") - 0.5) * 2.0
    x = ((F.col("chip_col") + 0.5) / F.col("cols") - 0.5) * 2.0
    order = Window.partitionBy("product").orderBy("r2", "chip_row", "chip_col")
    ranked = (chip_grid(geometry).withColumn("r2", x * x + y * y)
              .withColumn("nearest", F.row_number().over(order)))
    chosen = (F.when(F.col("mask_strategy") == "full_grid_from_png", F.lit(True))
              .when(F.col("net_die") > 0, F.col("nearest") <= F.col("net_die"))
              .otherwise(F.col("r2") <= 1.0))
    return ranked.withColumn("in_wafer", flag(chosen)).drop("nearest")


def chip_numbers(chip_rows: DataFrame, active: str, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Row-major running number of the active chips, -1 for the others."""
    order = Window.partitionBy(*keys, active).orderBy("chip_row", "chip_col")
    number = F.when(F.col(active) > 0, F.row_number().over(order) - 1).otherwise(F.lit(-1))
    return chip_rows.withColumn("chip_id", number)
