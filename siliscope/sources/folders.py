"""Folders of gray images to pixel tables, with each product's chip grid stated or found out from its own images.

Two passes over the files. The first leaves a small row per file: its size, and where the product has no stated geometry the
chip size that its untested chips show. The rows of a product then agree on one grid, and the second pass decodes with
it. Every file below the root ends up in the pixel table or in the error table; pixels are never shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.operators import chipsize
from siliscope.operators.geometry import inferred_wafer_chips
from siliscope.sources import arrays, catalog, png
from siliscope.sources.staging import stage

GRADE_OF = np.full(256, -1)
GRADE_OF[list(C.GRADE_GRAYS)] = np.arange(len(C.GRADE_GRAYS))
#: what the first pass says of a file
MEASURED = "path string, product string, relative_path string, height int, width int, chip_h int, chip_w int, hint string, error string"
#: one row per product of stated geometry
STATED = "product string, chip_h int, chip_w int, rows int, cols int, net_die int, mask_strategy string"


class Wafers(NamedTuple):
    pixels: DataFrame  # arrays.PIXEL_SCHEMA
    errors: DataFrame  # path, product, sample_id, error
    geometry: DataFrame  # STATED and how many files showed it; one row per product that has one


def measured(files: DataFrame) -> DataFrame:
    """First pass over (path, product, relative_path, infer, and what ``png._planes`` reads): one MEASURED row per image.

    ``error`` is what makes the image unusable, ``hint`` why its chips do not show.
    """
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, (path, gray, error) in zip(pdf.itertuples(index=False), png._planes(pdf)):
                h = w = chip_h = chip_w = hint = None
                if error is None:
                    h, w = gray.shape
                    if (GRADE_OF[gray] < 0).any():
                        error = "unknown gray value"
                    elif row.infer:
                        try:
                            chip_h, chip_w = chipsize.chip_size(gray)
                        except ValueError as exc:
                            hint = str(exc)
                out.append((path, row.product, row.relative_path, h, w, chip_h, chip_w, hint, error))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in MEASURED.split(", ")])
            yield frame.astype({c: "Int32" for c in ("height", "width", "chip_h", "chip_w")})

    return files.mapInPandas(measure, MEASURED)


def agreed_geometry(sizes: DataFrame, strict: bool = False) -> DataFrame:
    """(product, chip_h, chip_w, rows, cols, votes, shown, rivals): the grid that most of a product's images show.

    Only images whose chips show have a vote; ``shown`` counts them and ``rivals`` the other grids. Two grids with equally
    many votes are no agreement and give no row; with ``strict`` any rival is none.
    """
    grid = ["chip_h", "chip_w", "rows", "cols"]
    votes = sizes.filter("chip_h IS NOT NULL").withColumns(
        {"rows": F.expr("height div chip_h").cast("int"), "cols": F.expr("width div chip_w").cast("int")}).groupBy("product", *grid).agg(
        F.count(F.lit(1)).alias("votes"))
    ranked = votes.groupBy("product").agg(
        F.max(F.struct("votes", *grid)).alias("g"), F.sum("votes").alias("shown"), (F.count(F.lit(1)) - 1).alias("rivals"),
        F.sort_array(F.collect_list("votes"), asc=False).alias("v"))  # as many entries as a product shows grids
    tied = (F.col("rivals") > 0) & (F.col("v")[0] == F.get("v", F.lit(1)))
    return ranked.filter(~tied & ((F.col("rivals") == 0) | F.lit(not strict))).select("product", *[f"g.{c}" for c in grid], "g.votes", "shown", "rivals")


def _decoded(rows: DataFrame) -> DataFrame:
    """Second pass: pixels of images with their product's grid and the flags of its chip slots."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, (_, gray, _) in zip(pdf.itertuples(index=False), png._planes(pdf)):
                stby = png.full_chips(gray, r.chip_h, r.chip_w)
                wafer = np.asarray(r.slots).reshape(r.rows, r.cols).repeat(r.chip_h, 0).repeat(r.chip_w, 1)
                yield from arrays.pixel_frames(r.sample_id, {
                    "severity": np.where(stby == 1, 0, GRADE_OF[gray]), "in_wafer": wafer, "stby": stby,
                    "valid": ((wafer > 0) & (stby == 0)).astype(int), "chip_id": arrays.numbered_chips(wafer, r.chip_h, r.chip_w),
                    "masks": np.zeros((len(C.PATTERN_CLASSES), *gray.shape), np.int8)})

    return rows.mapInPandas(decode, arrays.PIXEL_SCHEMA)


def read_folder(spark: SparkSession, root: str, secret: str, geometry: DataFrame | None = None, strict: bool = False,
                mask_strategy: str = "centered_ellipse_from_png") -> Wafers:
    """Read all images below a folder of product folders.

    ``geometry`` (STATED) names the grid of some products; all others go by ``agreed_geometry``, an unknown net die (0) and
    ``mask_strategy``. A file is an error row if it cannot be read, holds an unknown gray, belongs to a product without a
    grid, shows another grid than its product's, or is not as large as that grid. ``secret`` salts the opaque sample ids.
    """
    stated = geometry if geometry is not None else spark.createDataFrame([], STATED)
    stated = stated.select(*[c.split()[0] for c in STATED.split(", ")])
    images = catalog.placed_files(png._images(spark, root), root)
    by_header = catalog.placed_files(png.refused(png.headers(spark, root)), root)
    known = stated.select("product", F.lit(True).alias("known"))
    sizes = stage(measured(images.join(known, "product", "left").withColumn("infer", F.col("known").isNull()).drop("known")), slim=True)
    found = agreed_geometry(sizes.join(known, "product", "left_anti"), strict).select(
        "product", "chip_h", "chip_w", "rows", "cols", F.lit(0).alias("net_die"), F.lit(mask_strategy).alias("mask_strategy"), "votes")
    grids = stage(stated.withColumn("votes", F.lit(0).cast("bigint")).unionByName(found), slim=True)
    sample = F.concat_ws("_", catalog.product_alias(F.col("product"), secret), catalog.wafer_alias(F.col("relative_path")))
    own = sizes.withColumnsRenamed({"chip_h": "own_h", "chip_w": "own_w"}).join(grids, "product", "left").withColumn("sample_id", sample)
    other = (F.col("own_h") != F.col("chip_h")) | (F.col("own_w") != F.col("chip_w"))
    wrong_size = (F.col("height") != F.col("rows") * F.col("chip_h")) | (F.col("width") != F.col("cols") * F.col("chip_w"))
    error = (F.when(F.col("error").isNotNull(), F.col("error"))
             .when(F.col("chip_h").isNull(), F.concat_ws(": ", F.lit("product has no agreed geometry"), "hint"))
             .when(other, "chips differ from the product's").when(wrong_size, "chip grid does not cover the image"))
    judged = stage(own.withColumn("error", error), slim=True)
    errors = judged.filter("error IS NOT NULL").select("path", "product", "sample_id", "error").unionByName(
        by_header.select("path", "product", sample.alias("sample_id"), "error"))
    slots = inferred_wafer_chips(grids).groupBy("product").agg(
        F.array_sort(F.collect_list(F.struct("chip_row", "chip_col", "in_wafer"))).alias("s")).select(
        "product", F.transform("s", lambda s: s["in_wafer"].cast("int")).alias("slots"))
    fit = judged.filter("error IS NULL").select("path", "sample_id", "product", "chip_h", "chip_w", "rows", "cols").join(slots, "product").drop("product")
    pixels = _decoded(images.select("path", "content", "raw", "height", "width", "channels").join(fit, "path"))
    return Wafers(pixels, errors, grids)
