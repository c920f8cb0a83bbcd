"""Array archives (NPZ) to pixel tables: decoded and checked per file inside the tasks."""
from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.sources.sinks import write_files

# fixed values: logical array names and the keys they have by default
DEFAULT_KEYS = {"severity": "severity", "wafer_mask": "wafer_mask", "valid_test_mask": "valid_test_mask",
                "stby_mask": "stby_mask", "chip_index": "chip_index"}
PIXEL_SCHEMA = ("sample_id string, y int, x int, severity int, in_wafer int, valid int, stby int, chip_id int, "
                "height int, width int, d2 int, wafer_extent int, " + ", ".join(f"{c} int" for c in C.PATTERN_CLASSES))
ERROR_SCHEMA = "sample_id string, errors array<string>"
ROWS_PER_BATCH = 250_000


def whole_numbers(values: np.ndarray, name: str, errors: list[str]) -> np.ndarray | None:
    """The array as integers, or a note why it is not one; checked before any cast can hide it."""
    if values.ndim != 2:
        errors.append(f"{name} must be two-dimensional")
        return None
    if values.dtype.kind == "f":
        if not np.isfinite(values).all():
            errors.append(f"{name} contains NaN or inf")
            return None
        if not (values == np.floor(values)).all():
            errors.append(f"{name} must hold whole numbers")
            return None
    elif values.dtype.kind not in "iub":
        errors.append(f"{name} must be numeric")
        return None
    return values.astype(np.int64)


def read_arrays(content: bytes, keys: dict[str, str], chip: tuple[int, int], allow_missing: bool) -> tuple[dict, list[str]]:
    """Named integer arrays of one archive and what is wrong with it."""
    errors: list[str] = []
    found: dict[str, np.ndarray] = {}
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as data:
            raw = {n: data[k] for n, k in {**DEFAULT_KEYS, **keys}.items() if k in data.files}
            masks = data["pattern_masks"] if "pattern_masks" in data.files else None
    except (ValueError, OSError, KeyError) as exc:
        return {}, [f"unreadable archive: {exc}"]
    if "severity" not in raw:
        return {}, ["severity array is missing"]
    for name, values in raw.items():
        checked = whole_numbers(values, name, errors)
        if checked is not None:
            found[name] = checked
    severity = found.get("severity")
    if severity is None:
        return {}, errors
    shape = severity.shape
    if severity.size and (severity.min() < 0 or severity.max() > C.MAX_GRADE):
        errors.append("severity must be in grade range 0..7")
    for name in ("wafer_mask", "valid_test_mask", "stby_mask"):
        values = found.get(name)
        if values is None:
            if not allow_missing and name not in raw:
                errors.append(f"{name} is missing")
            continue
        if values.shape != shape:
            errors.append(f"{name} shape does not match severity")
        elif values.size and (values.min() < 0 or values.max() > 1):
            errors.append(f"{name} must be binary")
    if errors:
        return {}, errors
    wafer = found.get("wafer_mask", np.ones(shape, dtype=np.int64))
    stby = found.get("stby_mask", np.zeros(shape, dtype=np.int64))
    valid = found.get("valid_test_mask", ((wafer > 0) & (stby == 0)).astype(np.int64))
    chips = found.get("chip_index")
    if chips is None:
        chips = numbered_chips(wafer, *chip)
    elif chips.shape != shape:
        return {}, ["chip_index shape does not match severity"]
    if masks is None:
        masks = np.zeros((len(C.PATTERN_CLASSES), *shape), dtype=np.int8)
    elif masks.shape != (len(C.PATTERN_CLASSES), *shape):
        return {}, ["pattern_masks shape does not match pattern classes and severity"]
    return {"severity": severity, "in_wafer": wafer, "valid": valid, "stby": stby, "chip_id": chips, "masks": masks}, []


def numbered_chips(wafer: np.ndarray, chip_h: int, chip_w: int) -> np.ndarray:
    """Row-major numbers of the chips that touch the wafer, -1 elsewhere."""
    if chip_h < 1 or chip_w < 1:
        return np.where(wafer > 0, 0, -1)
    h, w = wafer.shape
    rows, cols = -(-h // chip_h), -(-w // chip_w)
    padded = np.zeros((rows * chip_h, cols * chip_w), dtype=bool)
    padded[:h, :w] = wafer > 0
    touched = padded.reshape(rows, chip_h, cols, chip_w).any(axis=(1, 3))
    number = np.where(touched, touched.ravel().cumsum().reshape(rows, cols) - 1, -1)
    spread = number.repeat(chip_h, 0).repeat(chip_w, 1)[:h, :w]
    return np.where(wafer > 0, spread, -1)


def pixel_frames(sample_id: str, arrays: dict) -> Iterator[pd.DataFrame]:
    """Pixel rows of one wafer in slices; the wafer extent is settled here, where the whole wafer is at hand."""
    h, w = arrays["severity"].shape
    y, x = np.divmod(np.arange(h * w), w)
    d2 = (2 * y - (h - 1)) ** 2 + (2 * x - (w - 1)) ** 2
    inside = arrays["in_wafer"].ravel() > 0
    extent = int(d2[inside].max()) if inside.any() else 4
    columns = {n: arrays[n].ravel() for n in ("severity", "in_wafer", "valid", "stby", "chip_id")}
    columns |= {c: arrays["masks"][i].ravel().astype(int) for i, c in enumerate(C.PATTERN_CLASSES)}
    for s in range(0, h * w, ROWS_PER_BATCH):
        part = slice(s, s + ROWS_PER_BATCH)
        yield pd.DataFrame({"sample_id": sample_id, "y": y[part], "x": x[part], **{n: v[part] for n, v in columns.items()},
                            "height": h, "width": w, "d2": d2[part], "wafer_extent": extent})


def archive_files(spark: SparkSession, root: str, pattern: str = "arrays.npz") -> DataFrame:
    """(sample_id, path, content) of the archives below a folder; the sample is named by its folder."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("sample_id"), "path", "content")


def _entries(files: DataFrame, allow_missing: bool) -> DataFrame:
    have = files.columns
    return files.select(
        "sample_id", "content",
        (F.col("array_keys") if "array_keys" in have else F.lit(None).cast("map<string,string>")).alias("array_keys"),
        (F.col("chip_blocks.height") if "chip_blocks" in have else F.lit(0)).alias("chip_h"),
        (F.col("chip_blocks.width") if "chip_blocks" in have else F.lit(0)).alias("chip_w"))


def read_pixels(files: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Pixel table of the readable archives among (sample_id, content[, array_keys, chip_blocks])."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                arrays, errors = read_arrays(bytes(row.content), dict(row.array_keys or {}), (int(row.chip_h or 0), int(row.chip_w or 0)), allow_missing)
                if not errors:
                    yield from pixel_frames(row.sample_id, arrays)
    return _entries(files, allow_missing).mapInPandas(decode, PIXEL_SCHEMA)


def read_errors(files: DataFrame, allow_missing: bool = False) -> DataFrame:
    """(sample_id, errors) of the archives that cannot be used."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.sample_id, read_arrays(bytes(r.content), dict(r.array_keys or {}), (int(r.chip_h or 0), int(r.chip_w or 0)), allow_missing)[1])
                    for r in pdf.itertuples(index=False)]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["sample_id", "errors"])
    return _entries(files, allow_missing).mapInPandas(check, ERROR_SCHEMA)


def archive_bytes(pdf: pd.DataFrame) -> bytes:
    """Compressed archive of the pixel rows of one wafer."""
    h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
    out = {}
    for name, column in (("severity", "severity"), ("wafer_mask", "in_wafer"), ("valid_test_mask", "valid"), ("stby_mask", "stby"), ("chip_index", "chip_id")):
        if column in pdf:
            grid = np.zeros((h, w), dtype=np.int32)
            grid[pdf["y"], pdf["x"]] = pdf[column]
            out[name] = grid
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **out)
    return buffer.getvalue()


def pack_archives(pixels: DataFrame) -> DataFrame:
    """(sample_id, content): one archive per wafer as a table. One group is one wafer."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sample_id": [str(pdf["sample_id"].iloc[0])], "content": [archive_bytes(pdf)]})
    return pixels.groupBy("sample_id").applyInPandas(pack, "sample_id string, content binary")


def write_archives(pixels: DataFrame, folder: str) -> DataFrame:
    """Write one archive per wafer, <folder>/<sample_id>/arrays.npz; returns (sample_id, path) of all."""
    path = F.concat(F.col("sample_id"), F.lit("/arrays.npz"))
    write_files(pack_archives(pixels).select(path.alias("path"), "content"), folder)
    return pixels.select("sample_id").distinct().select("sample_id", F.concat(F.lit(folder.rstrip("/") + "/"), path).alias("path"))
