"""Chip size of an image from its untested chips, for wafers without stated geometry."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from siliscope import constants as C
from siliscope.operators.components import label_mask

SCHEMA = "sample_id string, chip_h int, chip_w int, error string"


def filled_rectangles(mask: np.ndarray) -> list[tuple[int, int]]:
    """(height, width) of the 4-connected regions of more than one pixel that fill their bounding box."""
    labels = label_mask(mask[None], diagonal=False)[0]
    y, x = np.nonzero(mask)
    if not len(y):
        return []
    box = pd.DataFrame({"l": labels[y, x], "y": y, "x": x}).groupby("l").agg(
        y0=("y", "min"), y1=("y", "max"), x0=("x", "min"), x1=("x", "max"), area=("y", "size"))
    h, w = box["y1"] - box["y0"] + 1, box["x1"] - box["x0"] + 1
    keep = (box["area"] == h * w) & (box["area"] > 1)
    return [(int(a), int(b)) for a, b in zip(h[keep], w[keep])]


def _splits(size: int, whole: int) -> set[int]:
    """Divisors of a block side, at least two and up to the side itself, that also divide the image."""
    return {d for d in range(2, size + 1) if size % d == 0 and whole % d == 0}


def chip_size(gray: np.ndarray) -> tuple[int, int]:
    """Largest chip size consistent with all big untested blocks; refused where a block may be several chips."""
    blocks = filled_rectangles(gray == C.STBY_GRAY)
    if not blocks:
        raise ValueError("no filled untested rectangles")
    largest = max(h * w for h, w in blocks)
    blocks = [(h, w) for h, w in blocks if 2 * h * w >= largest]
    chip_h, chip_w = math.gcd(*(h for h, _ in blocks)), math.gcd(*(w for _, w in blocks))
    if min(chip_h, chip_w) < 2:
        raise ValueError("untested blocks are too small")
    if gray.shape[0] % chip_h or gray.shape[1] % chip_w:
        raise ValueError("block size does not divide the image")
    if all(b == (chip_h, chip_w) for b in blocks):
        heights, widths = _splits(chip_h, gray.shape[0]) | {chip_h}, _splits(chip_w, gray.shape[1]) | {chip_w}
        if len(heights) * len(widths) > 1:
            raise ValueError("untested blocks may be several adjacent chips")
    return chip_h, chip_w


def infer_chip_size(pixels: DataFrame, gray: str = "gray") -> DataFrame:
    """(sample, chip_h, chip_w, error); one group is one wafer image."""

    def infer(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])), dtype=np.int64)
        grid[pdf["y"], pdf["x"]] = pdf[gray]
        try:
            h, w, error = *chip_size(grid), None
        except ValueError as exc:
            h, w, error = None, None, str(exc)
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "chip_h": pd.array([h], dtype="Int32"),
                             "chip_w": pd.array([w], dtype="Int32"), "error": [error]})

    return pixels.select("sample_id", "y", "x", "height", "width", gray).groupBy("sample_id").applyInPandas(infer, SCHEMA)
