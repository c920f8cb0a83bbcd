"""Gray images of wafers to pixel tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siliscope.functions.columns import flag, gray_to_grade
from siliscope.operators.geometry import chip_of_pixel, Geometry, inferred_wafer_chips, quarter_d2
from siliscope.operators.validation import full_gray_chips
from siliscope.sources import catalog, png

COLUMNS = Geometry("height", "width", "chip_h", "chip_w", "rows", "cols", "net_die")


def assemble(raw: DataFrame, geometry: DataFrame) -> DataFrame:
    """Pixel table of raw gray values: grade, untested chips, inferred wafer mask and chip numbers.

    ``geometry`` has one row per product, so its chip grid is a small table whatever the number of wafers. Readers that
    know the geometry emit ``stby`` themselves; otherwise the whole-chip test costs one shuffle of the pixels by chip.
    """
    sized = chip_of_pixel(raw.join(geometry, "product"), COLUMNS)
    slots = inferred_wafer_chips(geometry).select("product", "chip_row", "chip_col", "in_wafer", "rows", "cols", "chip_h", "chip_w")
    # the farthest masked pixel of a product is a corner of one of its wafer chips
    corner = [F.greatest(F.abs(2 * F.col(p) * F.col(s) - (F.col(n) * F.col(s) - 1)),
                         F.abs(2 * ((F.col(p) + 1) * F.col(s) - 1) - (F.col(n) * F.col(s) - 1)))
              for p, s, n in (("chip_row", "chip_h", "rows"), ("chip_col", "chip_w", "cols"))]
    extent = slots.filter("in_wafer = 1").groupBy("product").agg(
        F.max(corner[0] * corner[0] + corner[1] * corner[1]).cast("int").alias("wafer_extent"))
    placed = (sized.join(slots.select("product", "chip_row", "chip_col", "in_wafer"), ["product", "chip_row", "chip_col"])
              .join(extent, "product"))
    if "stby" not in raw.columns:
        placed = placed.join(full_gray_chips(sized), ["sample_id", "chip_row", "chip_col"])
    return placed.withColumns({
        "severity": F.when(F.col("stby") == 1, F.lit(0)).otherwise(gray_to_grade(F.col("gray"))),
        "valid": flag((F.col("in_wafer") == 1) & (F.col("stby") == 0)),
        "d2": quarter_d2(F.col("y"), F.col("x"), F.col("height"), F.col("width"))})


def assembly_errors(raw: DataFrame, geometry: DataFrame) -> DataFrame:
    """(sample_id, product, error) of the images that ``assemble`` cannot place whole: no geometry, or a grid of another size."""
    images = raw.select("sample_id", "product", "height", "width").distinct().join(
        geometry.select("product", (F.col("rows") * F.col("chip_h")).alias("_h"), (F.col("cols") * F.col("chip_w")).alias("_w")), "product", "left")
    error = F.when(F.col("_h").isNull(), "product has no geometry").when(
        (F.col("_h") != F.col("height")) | (F.col("_w") != F.col("width")), "chip grid does not cover the image")
    return images.select("sample_id", "product", error.alias("error")).filter("error IS NOT NULL")


def unplaced_files(spark: SparkSession, root: str, geometry: DataFrame) -> DataFrame:
    """(path, product, error) of the images whose product has no geometry."""
    return catalog.discover(spark, root).join(geometry.select("product"), "product", "left_anti").select(
        "path", "product", F.lit("product has no geometry").alias("error"))


def read_wafers(spark: SparkSession, root: str, geometry: DataFrame, secret: str) -> DataFrame:
    """Pixel table of a folder of product folders: decode, opaque ids, untested chips, masks; pixels are never shuffled.

    ``geometry`` has one row per product folder: product, chip_h, chip_w, rows, cols, net_die, mask_strategy.
    """
    raw = png.read_gray(spark, root, geometry)
    sample = F.concat_ws("_", catalog.product_alias(F.col("product"), secret), catalog.wafer_alias(F.col("relative_path")))
    return assemble(raw.withColumn("sample_id", sample), geometry)
