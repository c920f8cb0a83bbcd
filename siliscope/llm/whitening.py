"""Whitened principal components of integer feature vectors by Golub-Kahan-Lanczos bidiagonalisation.

X holds the centred feature rows. Starting from one direction v, the process builds orthonormal right vectors v_1, v_2, ...,
orthonormal left vectors u_1, u_2, ... (one entry per row) and an upper bidiagonal B with X V = U B. A step is one Spark job
over the packed rows: every task forms its part of u = X v and adds it up to X'u and |u|; only one row per dimension comes
back. A left vector is never stored: u_k is X p_k for a direction p_k as short as a feature row, and since X'u_j is known from
step j, the products u_j.(X v) that full reorthogonalisation needs are (X'u_j).v. Right vectors are reorthogonalised as well,
both twice. Where a remainder vanishes (rank lost, or equal deviations), the process goes on from a fresh direction, so it
always ends after as many steps as there are dimensions, and the singular values of the small B are those of X.

Sums, n and deviations are whole numbers and exact; everything else is double precision. The driver holds a few square
matrices of the vectors' length, tasks one block of rows at a time.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siliscope.llm.common import small_batches
from siliscope.sources.staging import release, stage

COMPONENTS = 32
BLOCK_BYTES = 4 << 20
#: a remainder shorter than this share of the longest left vector is rounding, not a direction
VANISHED = 1e-12
SEED = 20240
LARGEST = 2 ** 63 - 1


def quantised(vector: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * x) + offset of every component as long; null if the vector or a component is null or not finite.

    A component beyond 2**46 in size counts as not finite: its whole number would leave the exact range of a double.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(2 ** 46)))
    return F.when(vector.isNotNull() & fit, F.transform(x, lambda v: F.floor(v * scale) + F.lit(offset).cast("bigint")))


def _pack(id_type: pa.DataType):
    """Rows of one length as one binary block, with their ids beside it."""
    schema = pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("ids", pa.list_(id_type)), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                cells = part.column("vector").flatten().to_numpy().reshape(part.num_rows, d)
                step = max(1, BLOCK_BYTES // (8 * d))
                for lo in range(0, part.num_rows, step):
                    ids = part.column("id").slice(lo, step)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], pa.int32()), pa.array([len(ids)], pa.int64()),
                         pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(id_type)),
                         pa.array([cells[lo:lo + step].astype("<i8").tobytes()], pa.binary())], schema=schema)

    return run


def _cells(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    for cells in batch.column("cells"):
        yield np.frombuffer(cells.as_buffer(), "<i8").reshape(-1, d)


def _sums(blocks: DataFrame, d: int) -> list[int]:
    """Exact sum of every dimension: per block as longs, over blocks as decimals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in _cells(batch, d):  # a block holds few enough rows for longs: entries stay below 2**53
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(cells.sum(0), pa.int64())], ["i", "s"])

    rows = blocks.select("cells").mapInArrow(run, "i int, s bigint").groupBy("i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()
    return [int(r.s) for r in sorted(rows, key=lambda r: r.i)]


def _centred(cells: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n as (n*x - S)/n, so that the difference is exact; beyond longs it is taken in doubles."""
    if n * max(int(np.abs(cells).max(initial=0)), int(np.abs(sums // n).max(initial=0))) < 2 ** 61:
        return (n * cells - sums.astype(np.int64)) / n
    return cells - np.array([int(s) / n for s in sums])


def _gathered(blocks: DataFrame, per_task, width: int) -> np.ndarray:
    """Sum of a vector of ``width`` doubles over all tasks; the driver receives ``width`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            per_task(batch, total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], ["i", "v"])

    found = np.zeros(width)
    for row in blocks.select("cells").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        found[row.i] = row.v
    return found


def bidiagonalise(multiply, d: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V (d x d, orthonormal columns) and the upper bidiagonal B with X V = U B.

    ``multiply(p)`` returns X'(X p) and |X p|**2: both products of a step with the left vector X p.
    """
    draw = np.random.default_rng(seed)
    right, left, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v_j, p_j, X'u_j
    diagonal, upper = np.zeros(d), np.zeros(max(d - 1, 0))

    def fresh() -> np.ndarray:
        v = draw.standard_normal(d)
        for _ in range(3):
            v -= right @ (right.T @ v)
            v /= np.linalg.norm(v)
        return v

    v, largest = fresh(), 0.0
    for k in range(d):
        right = np.column_stack([right, v])
        p = v.copy()
        for _ in range(2):  # u_j.(X p) = (X'u_j).p
            p -= left @ (images.T @ p)
        image, square = multiply(p)
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max(largest, alpha)
        if alpha <= VANISHED * largest or alpha == 0.0:
            alpha, p, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            p, image = p / alpha, image / alpha
        left, images = np.column_stack([left, p]), np.column_stack([images, image])
        diagonal[k] = alpha
        if k + 1 == d:
            break
        w = image.copy()
        for _ in range(2):
            w -= right @ (right.T @ w)
        beta = float(np.linalg.norm(w))
        if beta <= VANISHED * largest or beta == 0.0:
            upper[k], v = 0.0, fresh()
        else:
            v = w / beta
            v -= right @ (right.T @ v)
            v /= np.linalg.norm(v)
            upper[k] = float(image @ v)
    return right, np.diag(diagonal) + np.diag(upper, 1)


def components(right: np.ndarray, bidiagonal: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances (falling) and unit directions in columns; the largest entry of a direction is positive."""
    _, sigma, turned = np.linalg.svd(bidiagonal)
    directions = right @ turned.T
    if directions.size:
        at = np.abs(directions).argmax(0)
        directions *= np.sign(directions[at, np.arange(directions.shape[1])])
    return sigma ** 2 / n, directions


def whiten(wafers: DataFrame, components_kept: int = COMPONENTS, sample_id: str = "sample_id", vector: str = "features") -> DataFrame:
    """Whitened components of every wafer's feature row.

    ``wafers`` holds an id and a vector of whole numbers (see ``quantised``). Returns one row per wafer and component, up to
    ``components_kept`` of them by falling variance: ``sample_id, component`` (from 1), ``n`` (wafers), ``deviation`` (sum over
    dimensions of (n*x - S)**2, exact; null where it is no long), ``whitened`` (mean 0, variance 1 over the table),
    ``explained`` (share of the variance) and ``identity_error`` (largest absolute entry of the whitened covariance less the identity, one value).

    Rows with a null vector or a null component take no part, nor do those whose length is not the commonest (of equally
    common lengths the longer counts). Rows with a null or repeated id each stand for themselves. Components without variance
    (rank lost, one wafer, equal wafers) are not returned, so such tables, empty ones and vectors without components give
    no rows. Other columns are ignored.
    """
    spark = wafers.sparkSession
    small_batches(wafers)
    kind = wafers.schema[sample_id].dataType
    id_type = pa.string() if isinstance(kind, T.StringType) else pa.int64()
    id_name = "string" if isinstance(kind, T.StringType) else "bigint"
    rows = wafers.select(F.col(f"`{sample_id}`").cast(id_name).alias("id"), F.col(f"`{vector}`").cast("array<bigint>").alias("vector")).filter(
        F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull()) & (F.size("vector") > 0))
    packed = stage(rows.withColumn("dims", F.size("vector")).mapInArrow(
        _pack(id_type), f"dims int, n bigint, ids array<{id_name}>, cells binary"))
    schema = T.StructType([
        T.StructField("sample_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    common = packed.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    d, n = int(common.dims), int(common.n)
    blocks = packed.filter(F.col("dims") == d)
    sums = np.array(_sums(blocks, d), object)

    def multiply(p: np.ndarray) -> tuple[np.ndarray, float]:
        def per_task(batch: pa.RecordBatch, total: np.ndarray) -> None:
            for cells in _cells(batch, d):
                x = _centred(cells, n, sums)
                u = x @ p
                total[:d] += x.T @ u
                total[d] += u @ u

        got = _gathered(blocks, per_task, d + 1)
        return got[:d], float(got[d])

    variances, directions = components(*bidiagonalise(multiply, d), n)
    whole = float(variances.sum())
    kept = min(components_kept, int((variances > (VANISHED * variances[0] if whole > 0 else np.inf)).sum()))
    if kept == 0:
        release(packed)
        return spark.createDataFrame([], schema)
    turn = directions[:, :kept] / np.sqrt(variances[:kept])

    def products(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for cells in _cells(batch, d):
            y = _centred(cells, n, sums) @ turn
            total[:kept] += y.sum(0)
            total[kept:] += (y.T @ y).ravel()

    got = _gathered(blocks, products, kept + kept * kept)
    mean = got[:kept] / n
    error = float(np.abs(got[kept:].reshape(kept, kept) / n - np.outer(mean, mean) - np.eye(kept)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, cells in enumerate(_cells(batch, d)):
                ids = batch.column("ids").slice(i, 1).flatten()
                y = np.ascontiguousarray(_centred(cells, n, sums) @ turn)
                offsets = pa.array(np.arange(0, y.size + 1, kept), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.array(_deviations(cells, n, sums), pa.int64()),
                                                  pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], ["id", "deviation", "parts"])

    shares = F.array(*[F.lit(float(x / whole)) for x in variances[:kept]])
    projected = blocks.select("ids", "cells").mapInArrow(project, f"id {id_name}, deviation bigint, parts array<double>")
    return projected.select(F.col("id").cast(kind).alias("sample_id"), "deviation", F.posexplode("parts").alias("at", "whitened")).select(
        "sample_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def _deviations(cells: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Sum over dimensions of (n*x - S)**2 per row; None where a long cannot hold it."""
    widest = n * int(np.abs(cells).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if widest < 2 ** 62:
        off = n * cells - sums.astype(np.int64)
        if int(np.abs(off).max(initial=0)) ** 2 * cells.shape[1] < 2 ** 62:
            return np.square(off).sum(1).tolist()
    exact = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(row, sums)) for row in cells.tolist()]
    return [e if e <= LARGEST else None for e in exact]
