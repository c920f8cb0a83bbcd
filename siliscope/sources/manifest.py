"""Wafers that a manifest lists: every entry becomes pixels or an error row, whatever its source.

A manifest is a document: its entries are few enough to be resolved on the driver, their files are read and decoded in tasks.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.operators import chipsize
from siliscope.operators.geometry import inferred_wafer_chips
from siliscope.operators.validation import resolved_geometry
from siliscope.sources import arrays, catalog, png
from siliscope.sources.staging import stage

ERRORS = "sample_id string, errors array<string>"
GRADE_OF = np.full(256, -1)
GRADE_OF[list(C.GRADE_GRAYS)] = np.arange(len(C.GRADE_GRAYS))


def _error(rows: DataFrame, message) -> DataFrame:
    return rows.select("sample_id", F.array(message).alias("errors"))


def located(entries: DataFrame, folder: str) -> DataFrame:
    """Entries with the full path of their file; relative paths start at the manifest's folder."""
    kind = F.coalesce("source_type", F.lit(C.SOURCE_NPZ))
    given = F.when(kind == C.SOURCE_NPZ, F.col("arrays_npz")).when(kind == C.SOURCE_PNG, F.col("png_path")).when(
        kind == C.SOURCE_DIR, F.concat(F.rtrim("sample_dir", F.lit("/")), F.lit("/arrays.npz")))
    absolute = given.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]+:)")
    return entries.withColumns({"source_type": kind, "path": F.when(absolute, given).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), given))})


def _contents(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the content of their file, error rows of those without one)."""
    context = spark.sparkContext
    found, missing = {}, set()
    for path in {r["path"] for r in rows.select("path").distinct().collect() if r["path"] is not None}:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(context._jsc.hadoopConfiguration())
        if system.exists(where):
            found[path] = system.makeQualified(where).toUri().toString()
        else:
            missing.add(path)
    names = spark.createDataFrame([*found.items()], "path string, full string")
    if found:
        files = spark.read.format("binaryFile").load(sorted(set(found.values()))).select(
            F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/").alias("_at"), "content")
    else:
        files = spark.createDataFrame([], "_at string, content binary")
    at = names.withColumn("_at", F.regexp_replace("full", "^([a-z0-9]+):/+", "$1:/"))
    return (rows.join(at, "path").join(files, "_at").drop("_at", "full"),
            _error(rows.filter(F.col("path").isNull() | F.col("path").isin(*missing)), F.lit("file is missing")))


def _gray(content: bytes) -> np.ndarray:
    """Gray codes of an image; a value that is no code is an error."""
    gray = png.gray_of(png.decode(content))
    if (GRADE_OF[gray] < 0).any():
        raise ValueError("unknown gray value")
    return gray


def _measured(rows: DataFrame) -> DataFrame:
    """Image size and, where inference is allowed, the chip size that the untested chips show; or what is wrong."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                h = w = ch = cw = error = None
                try:
                    gray = _gray(bytes(r.content))
                    h, w = gray.shape
                    if r.infer:
                        ch, cw = chipsize.chip_size(gray)
                except (ValueError, zlib.error, struct.error) as exc:
                    error = str(exc)
                out.append((r.sample_id, h, w, ch, cw, error))
            frame = pd.DataFrame(out, columns=["sample_id", "height", "width", "ch", "cw", "error"])
            yield frame.astype({c: "Int32" for c in ("height", "width", "ch", "cw")})

    stated = F.col("chip_blocks").isNotNull() | F.col("grid").isNotNull()
    infer = ~stated & F.coalesce("allow_geometry_inference", F.lit(False))
    return stage(rows.select("sample_id", "content", infer.alias("infer")).mapInPandas(
        measure, "sample_id string, height int, width int, ch int, cw int, error string"))


def _png_pixels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    size = _measured(rows)
    bad = _error(size.filter("error IS NOT NULL"), F.col("error"))
    sized = rows.drop("content").join(size.filter("error IS NULL"), "sample_id").withColumn("chip_blocks", F.coalesce(
        "chip_blocks", F.when(F.col("ch").isNotNull(), F.struct(F.col("cw").alias("width"), F.col("ch").alias("height")))))
    geometry = stage(resolved_geometry(sized).select(
        "sample_id", "errors", F.col("sample_id").alias("product"), "chip_h", "chip_w", "rows", "cols",
        F.coalesce("actual_net_die", F.lit(0)).alias("net_die"), F.coalesce("wafer_mask_strategy", F.lit("centered_ellipse_from_png")).alias("mask_strategy")))
    wrong = geometry.filter(F.size("errors") > 0).select("sample_id", "errors")
    fit = geometry.filter(F.size("errors") == 0)
    # the wafer's chips, row by row: as many flags as the grid has slots
    slots = inferred_wafer_chips(fit).groupBy("product").agg(
        F.array_sort(F.collect_list(F.struct("chip_row", "chip_col", "in_wafer"))).alias("s")).select(
        F.col("product").alias("sample_id"), F.transform("s", lambda s: s["in_wafer"].cast("int")).alias("slots"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                gray = _gray(bytes(r.content))
                stby = png.full_chips(gray, r.chip_h, r.chip_w)
                wafer = np.asarray(r.slots).reshape(r.rows, r.cols).repeat(r.chip_h, 0).repeat(r.chip_w, 1)
                yield from arrays.pixel_frames(r.sample_id, {
                    "severity": np.where(stby == 1, 0, GRADE_OF[gray]), "in_wafer": wafer, "stby": stby, "valid": ((wafer > 0) & (stby == 0)).astype(int),
                    "chip_id": arrays.numbered_chips(wafer, r.chip_h, r.chip_w), "masks": np.zeros((len(C.PATTERN_CLASSES), *gray.shape), np.int8)})

    placed = rows.select("sample_id", "content").join(fit.join(slots, "sample_id"), "sample_id").select(
        "sample_id", "content", "chip_h", "chip_w", F.col("rows"), F.col("cols"), "slots")
    return placed.mapInPandas(decode, arrays.PIXEL_SCHEMA), bad.unionByName(wrong)


def load(spark: SparkSession, entries: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pixel table of the usable entries, and (sample_id, errors) of all others; every entry is in one of the two.

    ``entries`` are those of ``catalog.read_manifest``; ``allow_missing_masks_for_test`` may be a further column. An entry without a
    sample id goes by its metadata document's or its file's name. Ids should be unique, see ``validation.manifest_errors``.
    """
    rows = located(entries, folder)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)
    rows = stage(rows.withColumn("sample_id", F.coalesce("sample_id", stem)))
    known = F.col("source_type").isin(C.SOURCE_NPZ, C.SOURCE_PNG, C.SOURCE_DIR)
    errors = _error(rows.filter(~known), F.concat(F.lit("unsupported source type: "), F.col("source_type")))
    held, missing = _contents(spark, rows.filter(known))
    errors = errors.unionByName(missing)
    blocks = F.coalesce("chip_blocks", F.struct(F.lit(0).alias("width"), F.lit(0).alias("height"))).alias("chip_blocks")
    lenient = F.coalesce("allow_missing_masks_for_test", F.lit(False)) if "allow_missing_masks_for_test" in entries.columns else F.lit(False)
    npz = held.filter(F.col("source_type") != C.SOURCE_PNG).select("sample_id", "content", "array_keys", blocks, lenient.alias("lenient"))
    pixels = None
    for allow in (False, True):
        part = npz.filter(F.col("lenient") == allow)
        got = arrays.read_pixels(part, allow_missing=allow)
        pixels = got if pixels is None else pixels.unionByName(got)
        errors = errors.unionByName(arrays.read_errors(part, allow_missing=allow).select("sample_id", "errors"))
    more, wrong = _png_pixels(held.filter(F.col("source_type") == C.SOURCE_PNG))
    return pixels.unionByName(more), errors.unionByName(wrong)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Load the manifest document at a path."""
    return load(spark, catalog.read_manifest(spark, path), path.rsplit("/", 1)[0] if "/" in path else ".")
