"""Gray PNG files to raw gray pixel rows.

The session's image reader decodes the common files; the header tells which ones it would silently alter (gray with
alpha, 16 bit), and those are decoded or refused here.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siliscope.constants import STBY_GRAY
from siliscope.sources import catalog

RAW_SCHEMA = "path string, y int, x int, gray int, height int, width int"
CHIP_SCHEMA = "path string, product string, relative_path string, y int, x int, gray int, height int, width int, stby int"
ERROR_SCHEMA = "path string, error string"
# fixed values: colour types of the format and their channels
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
ROWS_PER_BATCH = 250_000


def headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, bit_depth, colour_type) from the first bytes of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").load(root)

    def number(start: int, size: int):
        return F.conv(F.hex(F.substring("content", start, size)), 16, 10).cast("int")
    return files.select("path", "content", number(17, 4).alias("width"), number(21, 4).alias("height"),
                        number(25, 1).alias("bit_depth"), number(26, 1).alias("colour_type"))


def refused(head: DataFrame) -> DataFrame:
    """Files no exact eight-bit gray value can be read from, by their header."""
    reason = (F.when(F.col("bit_depth") != 8, "needs 8-bit gray values").when(~F.col("colour_type").isin(*CHANNELS), "needs a gray image"))
    return head.select("path", reason.alias("error")).filter(F.col("error").isNotNull())


def decode(content: bytes) -> np.ndarray:
    """Samples [row, column, channel] of a non-interlaced eight-bit PNG."""
    pos, data, shape = 8, b"", None
    while pos < len(content):
        size, kind = struct.unpack(">I4s", content[pos:pos + 8])
        body = content[pos + 8:pos + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or colour not in CHANNELS or interlace:
                raise ValueError("needs a plain 8-bit image")
            shape = (h, w, CHANNELS[colour])
        elif kind == b"IDAT":
            data += body
        pos += size + 12
    if shape is None:
        raise ValueError("not a PNG file")
    h, w, bpp = shape
    lines = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(h, w * bpp + 1)
    out = np.zeros((h, w, bpp), dtype=np.int64)
    above = np.zeros((w, bpp), dtype=np.int64)
    for i in range(h):
        kind, line = int(lines[i, 0]), lines[i, 1:].reshape(w, bpp).astype(np.int64)
        if kind == 1:
            line = line.cumsum(0) % 256
        elif kind == 2:
            line = (line + above) % 256
        elif kind in (3, 4):
            left, corner = np.zeros(bpp, dtype=np.int64), np.zeros(bpp, dtype=np.int64)
            for j in range(w):
                if kind == 3:
                    guess = (left + above[j]) // 2
                else:
                    a, b, c = (np.abs(above[j] - corner), np.abs(left - corner), np.abs(left + above[j] - 2 * corner))
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[j], corner))
                corner = above[j]
                left = line[j] = (line[j] + guess) % 256
        out[i] = above = line
    return out


def encode(gray: np.ndarray) -> bytes:
    """An eight-bit gray image of a two-dimensional array."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = gray.shape
    lines = np.zeros((h, w + 1), np.uint8)
    lines[:, 1:] = gray
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b""))


def pack_images(pixels: DataFrame, path: str = "path", gray: str = "gray") -> DataFrame:
    """(path, content): one gray image per path from rows (path, y, x, gray, height, width). One group is one image."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])), np.uint8)
        plane[pdf["y"], pdf["x"]] = pdf["gray"]
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [encode(plane)]})

    rows = pixels.select(F.col(path).alias("path"), "y", "x", F.col(gray).alias("gray"), "height", "width")
    return rows.groupBy("path").applyInPandas(pack, "path string, content binary")


def gray_of(samples: np.ndarray) -> np.ndarray:
    """The gray plane, if alpha is opaque everywhere and the colours agree."""
    c = samples.shape[2]
    if c in (2, 4) and not (samples[:, :, -1] == 255).all():
        raise ValueError("needs an opaque alpha channel")
    if c >= 3 and not ((samples[:, :, 0] == samples[:, :, 1]) & (samples[:, :, 0] == samples[:, :, 2])).all():
        raise ValueError("colour channels differ")
    return samples[:, :, 0]


def _frames(path: str, gray: np.ndarray) -> Iterator[pd.DataFrame]:
    h, w = gray.shape
    y, x = np.divmod(np.arange(h * w), w)
    flat = gray.ravel()
    for s in range(0, h * w, ROWS_PER_BATCH):
        part = slice(s, s + ROWS_PER_BATCH)
        yield pd.DataFrame({"path": path, "y": y[part], "x": x[part], "gray": flat[part].astype(int), "height": h, "width": w})


def _planes(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray | None, str | None]]:
    for r in pdf.itertuples(index=False):
        try:
            if r.raw is not None:
                samples = np.frombuffer(bytes(r.raw), dtype=np.uint8).reshape(r.height, r.width, r.channels).astype(np.int64)
                yield r.path, gray_of(samples), None
            else:
                yield r.path, gray_of(decode(bytes(r.content))), None
        except (ValueError, zlib.error, struct.error) as exc:
            yield r.path, None, str(exc)


def _images(spark: SparkSession, root: str) -> DataFrame:
    head = headers(spark, root)
    bad = refused(head).select("path")
    with_alpha = head.filter((F.col("colour_type") == 4) & (F.col("bit_depth") == 8)).select(
        "path", "content", F.lit(None).cast("binary").alias("raw"), "height", "width", F.lit(2).alias("channels"))
    skip = bad.unionByName(with_alpha.select("path"))
    reader = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").load(root)
    # both readers name a file by its path, one with a scheme of one and one of three slashes
    name = F.regexp_replace("path", "^file:/+", "file:/")
    common = reader.select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), F.lit(None).cast("binary").alias("content"),
                           F.col("image.data").alias("raw"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                           F.col("image.nChannels").alias("channels"))
    return (common.join(skip.select(name.alias("path")), "path", "left_anti")
            .unionByName(with_alpha.withColumn("path", name)))


def full_chips(gray: np.ndarray, chip_h: int, chip_w: int) -> np.ndarray:
    """1 on the pixels of chips whose whole block has the code of an untested chip."""
    h, w = gray.shape
    rows, cols = h // chip_h, w // chip_w
    blocks = (gray[:rows * chip_h, :cols * chip_w] == STBY_GRAY).reshape(rows, chip_h, cols, chip_w).all(axis=(1, 3))
    out = np.zeros((h, w), dtype=np.int64)
    out[:rows * chip_h, :cols * chip_w] = blocks.repeat(chip_h, 0).repeat(chip_w, 1)
    return out


def read_gray(spark: SparkSession, root: str, geometry: DataFrame | None = None) -> DataFrame:
    """(path, y, x, gray, height, width) of every usable image below a folder.

    With product geometry (one row per product folder) the untested chips are marked as well, in the task that holds
    the image: product and stby are added.
    """
    files = _images(spark, root)
    if geometry is None:
        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for path, gray, error in _planes(pdf):
                    if error is None:
                        yield from _frames(path, gray)
        return files.mapInPandas(emit, RAW_SCHEMA)

    def emit_chips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, (path, gray, error) in zip(pdf.itertuples(index=False), _planes(pdf)):
                if error is None:
                    stby = full_chips(gray, row.chip_h, row.chip_w).ravel()
                    for part in _frames(path, gray):
                        start = int(part["y"].iloc[0]) * gray.shape[1] + int(part["x"].iloc[0])
                        yield part.assign(product=row.product, relative_path=row.relative_path, stby=stby[start:start + len(part)])[
                            ["path", "product", "relative_path", "y", "x", "gray", "height", "width", "stby"]]
    # products without geometry keep their images' pixels out; images.assembly_errors names them
    sized = catalog.placed_files(files, root).join(geometry.select("product", "chip_h", "chip_w"), "product")
    return sized.mapInPandas(emit_chips, CHIP_SCHEMA)


def read_errors(spark: SparkSession, root: str) -> DataFrame:
    """(path, error) of the images that are refused."""
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, e) for p, _, e in _planes(pdf) if e is not None], columns=["path", "error"])
    by_header = refused(headers(spark, root)).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "error")
    return by_header.unionByName(_images(spark, root).mapInPandas(emit, ERROR_SCHEMA))
