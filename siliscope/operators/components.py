"""Connected regions on wafer maps.

Chip maps arrive as one array per wafer (a map has a fixed size), many wafers per Arrow batch. Pixel images are labelled tile by
tile, and the parts of a region in different tiles are united along the tiles' borders, so no task holds an image. Either
way the label of a region is the row-major position of its first cell.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siliscope.sources.staging import stage

TILE = 256

def label_mask(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Label the regions of a stack of maps [batch, row, col]; cells outside the mask get the largest label."""
    batch, rows, cols = mask.shape
    top = rows * cols
    base = np.arange(top, dtype=np.int64).reshape(1, rows, cols)
    labels = np.where(mask, base, top)
    while True:
        pad = np.pad(labels, ((0, 0), (1, 1), (1, 1)), constant_values=top)
        across = np.minimum(np.minimum(pad[:, :, :-2], pad[:, :, 2:]), pad[:, :, 1:-1])
        if diagonal:
            spread = np.minimum(np.minimum(across[:, :-2], across[:, 2:]), across[:, 1:-1])
        else:
            spread = np.minimum(np.minimum(pad[:, :-2, 1:-1], pad[:, 2:, 1:-1]), across[:, 1:-1])
        spread = np.where(mask, spread, top)
        # a label names a cell of the same region, so jump to that cell's own label
        flat = np.concatenate([spread.reshape(batch, -1), np.full((batch, 1), top)], axis=1)
        spread = np.take_along_axis(flat, spread.reshape(batch, -1), axis=1).reshape(mask.shape)
        if np.array_equal(spread, labels):
            return labels
        labels = spread


def region_labels(cells: Column, rows: Column, cols: Column, diagonal: bool = True) -> Column:
    """Labels aligned with an array of row-major cell positions."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def label(cell_lists: pd.Series, row_counts: pd.Series, col_counts: pd.Series) -> pd.Series:
        out: list = [None] * len(cell_lists)
        shapes = pd.DataFrame({"r": row_counts.to_numpy(), "c": col_counts.to_numpy()})
        for (r, c), group in shapes.groupby(["r", "c"]):
            step = max(1, 4_000_000 // max(int(r) * int(c), 1))
            index = group.index.to_numpy()
            for start in range(0, len(index), step):
                chosen = index[start:start + step]
                mask = np.zeros((len(chosen), int(r) * int(c)), dtype=bool)
                for slot, i in enumerate(chosen):
                    mask[slot, np.asarray(cell_lists.iloc[i], dtype=np.int64)] = True
                labels = label_mask(mask.reshape(len(chosen), int(r), int(c)), diagonal).reshape(len(chosen), -1)
                for slot, i in enumerate(chosen):
                    out[i] = labels[slot, np.asarray(cell_lists.iloc[i], dtype=np.int64)].astype(np.int32)
        return pd.Series(out)

    return label(cells, rows, cols)


def tile_labels(cells: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """(sample_id, y, x, part, edge) of marked pixels (sample_id, y, x, width): regions as far as they reach within a tile.

    ``part`` is the position of the part's first pixel in the image. ``edge`` is 1 if one of the four neighbours is not marked;
    pixels along a border are handed to the tile beyond as well, where they are only looked at. One group is one tile.
    """
    ty, tx = F.floor(F.col("y") / tile).cast("int"), F.floor(F.col("x") / tile).cast("int")
    at = [F.struct(ty.alias("ty"), tx.alias("tx"), F.lit(1).alias("own"))]
    for coordinate, last, dy, dx in ((F.col("y"), 0, -1, 0), (F.col("y"), tile - 1, 1, 0), (F.col("x"), 0, 0, -1), (F.col("x"), tile - 1, 0, 1)):
        at.append(F.when(coordinate % tile == last, F.struct((ty + dy).alias("ty"), (tx + dx).alias("tx"), F.lit(0).alias("own"))))
    placed = cells.select("sample_id", "y", "x", "width", F.explode(F.array_compact(F.array(*at))).alias("p")).select("sample_id", "y", "x", "width", "p.*")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["ty"].iloc[0]) * tile - 1, int(pdf["tx"].iloc[0]) * tile - 1
        y, x, own = pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["own"].to_numpy() == 1
        seen = np.zeros((tile + 2, tile + 2), dtype=int)
        seen[y - y0, x - x0] = 1
        around = seen[:-2, 1:-1] + seen[2:, 1:-1] + seen[1:-1, :-2] + seen[1:-1, 2:]
        y, x = y[own], x[own]
        mask = np.zeros((1, tile, tile), dtype=bool)
        mask[0, y - y0 - 1, x - x0 - 1] = True
        first = label_mask(mask, diagonal)[0][y - y0 - 1, x - x0 - 1]
        part = (first // tile + y0 + 1) * int(pdf["width"].iloc[0]) + first % tile + x0 + 1 if len(y) else first
        return pd.DataFrame({"sample_id": pdf["sample_id"].to_numpy()[own], "y": y, "x": x, "part": part,
                             "edge": (around[y - y0 - 1, x - x0 - 1] < 4).astype(int)})

    kind = cells.schema["sample_id"].dataType.simpleString()
    return placed.groupBy("sample_id", "ty", "tx").applyInPandas(label, f"sample_id {kind}, y int, x int, part long, edge int")


def united_parts(labelled: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """(sample_id, part, region) of the parts that go on beyond their tile; all others are regions of their own.

    Only pixels along borders meet. The links of one wafer, at most a few per border pixel, are united in one group.
    """
    links = None
    for dy, dx in ((1, 0), (0, 1), *(((1, 1), (1, -1)) if diagonal else ())):
        crosses = (F.floor((F.col("y") + dy) / tile) != F.floor(F.col("y") / tile)) | (F.floor((F.col("x") + dx) / tile) != F.floor(F.col("x") / tile))
        one = labelled.filter(crosses).select("sample_id", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("part").alias("a"))
        along = [F.col(c) % tile == v for c, v in ([("y", 0)] if dy else []) + ([("x", 0), ("x", tile - 1)] if dx else [])]
        border = along[0]
        for more in along[1:]:
            border = border | more
        other = labelled.filter(border).select("sample_id", "y", "x", F.col("part").alias("b"))
        met = one.join(other, ["sample_id", "y", "x"]).select("sample_id", "a", "b").distinct()
        links = met if links is None else links.unionByName(met)

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}

        def root(v: int) -> int:
            while up.setdefault(v, v) != v:
                up[v] = v = up[up[v]]
            return v

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)  # the smallest position leads
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]] * len(up), "part": list(up), "region": [root(v) for v in list(up)]})

    kind = labelled.schema["sample_id"].dataType.simpleString()
    return links.groupBy("sample_id").applyInPandas(unite, f"sample_id {kind}, part long, region long")


def tiled_regions(cells: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """(sample_id, y, x, region, edge) of marked pixels (sample_id, y, x, width) of images of any size."""
    labelled = stage(tile_labels(cells, diagonal, tile))
    return labelled.join(united_parts(labelled, diagonal, tile), ["sample_id", "part"], "left").select(
        "sample_id", "y", "x", F.coalesce("region", "part").alias("region"), "edge")


def hot_chip_regions(chip_rows: DataFrame) -> DataFrame:
    """Hot tested chips of each wafer with the label of their 8-connected region.

    Hot is a mean grade of at least max(median + half a deviation, 84th percentile) of the wafer's own chips.
    """
    tested = chip_rows.filter(F.col("n_valid") > 0)
    stats = tested.groupBy("sample_id").agg(
        F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_pop("value").alias("sd"),
        F.percentile("value", F.lit(0.84)).alias("q84"), F.count(F.lit(1)).alias("n_tested"))
    hot = (tested.join(stats, "sample_id")
           .filter(F.col("value") >= F.greatest(F.col("median") + 0.5 * F.col("sd"), F.col("q84"))))
    packed = hot.groupBy("sample_id", "grid_rows", "grid_cols").agg(
        F.array_sort(F.collect_list(F.struct(
            (F.col("chip_row") * F.col("grid_cols") + F.col("chip_col")).cast("int").alias("cell"),
            "value", "chip_row", "chip_col", "radius", "theta", "n_tested"))).alias("cells"))
    labelled = packed.withColumn("labels", region_labels(F.col("cells.cell"), F.col("grid_rows"), F.col("grid_cols")))
    return (labelled
            .select("sample_id", "grid_rows", "grid_cols", F.explode(F.arrays_zip("cells", "labels")).alias("z"))
            .select("sample_id", "grid_rows", "grid_cols", "z.cells.*", F.col("z.labels").alias("region")))


def region_stats(cells: DataFrame) -> DataFrame:
    """Shape of each region: size, box filling, elongation, line score, radial and circular extent, mean value."""
    w = Window.partitionBy("sample_id", "region").orderBy("theta")
    whole = Window.partitionBy("sample_id", "region")
    gap = F.coalesce(F.lead("theta").over(w), F.min("theta").over(whole) + 1.0) - F.col("theta")
    agg = (
        cells.withColumn("gap", gap)
        .groupBy("sample_id", "region", "grid_rows", "grid_cols")
        .agg(F.count(F.lit(1)).alias("size"),
             ((F.max("chip_row") - F.min("chip_row") + 1) * (F.max("chip_col") - F.min("chip_col") + 1)).alias("box"),
             F.sum("chip_row").alias("sr"), F.sum("chip_col").alias("sc"),
             F.sum(F.col("chip_row") * F.col("chip_row")).alias("srr"),
             F.sum(F.col("chip_col") * F.col("chip_col")).alias("scc"),
             F.sum(F.col("chip_row") * F.col("chip_col")).alias("src"),
             (F.max("radius") - F.min("radius")).alias("radial_span"),
             F.max("gap").alias("widest_gap"), F.avg("value").alias("mean_value"), F.max("n_tested").alias("n_tested"))
    )
    n = F.col("size").cast("double")
    free = F.greatest(n - 1, F.lit(1.0))
    # n times the centred sums are integers, so straight lines give an exact ratio
    vr, vc = n * F.col("srr") - F.col("sr") * F.col("sr"), n * F.col("scc") - F.col("sc") * F.col("sc")
    vrc = n * F.col("src") - F.col("sr") * F.col("sc")
    spread = F.sqrt((vr - vc) * (vr - vc) + 4.0 * vrc * vrc)
    trace_floor = F.lit(1e-6) * n * free
    compact = n / F.greatest(F.col("box"), F.lit(1))
    elong = F.when(n >= 2, spread / F.greatest(vr + vc, trace_floor)).otherwise(F.lit(0.0))
    return (
        agg.withColumn("compactness", compact).withColumn("elongation", elong)
        .withColumn("linear_score", F.greatest(F.lit(0.0), F.col("elongation") * F.least(F.lit(1.0), n / 6.0)
                                               * (1.0 - 0.45 * F.col("compactness"))))
        .withColumn("angular_span", F.when(F.col("size") <= 1, F.lit(0.0)).otherwise(1.0 - F.col("widest_gap")))
        .withColumn("centroid_row", F.col("sr") / n).withColumn("centroid_col", F.col("sc") / n)
        .drop("sr", "sc", "srr", "scc", "src", "box", "widest_gap")
    )


def pair_distances(points: Column) -> Column:
    """Distances between all pairs of a three-element point array; pairs with a missing point are NULL."""
    def d(i: int, j: int) -> Column:
        a, b = F.get(points, F.lit(i)), F.get(points, F.lit(j))
        return F.hypot(a["r"] - b["r"], a["c"] - b["c"])
    return F.filter(F.array(d(0, 1), d(0, 2), d(1, 2)), lambda v: v.isNotNull())


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(total / F.size(values))


def grid_diagonal() -> Column:
    rows, cols = F.col("grid_rows"), F.col("grid_cols")
    return F.greatest(F.hypot(F.greatest(rows - 1, F.lit(1)).cast("double"),
                              F.greatest(cols - 1, F.lit(1)).cast("double")), F.lit(1.0))


def triangle_score(points: Column) -> Column:
    """Balance of the sides times a capped relative area; zero with fewer than three points."""
    sides = pair_distances(points)
    mean = array_mean(sides)
    sd = F.sqrt(F.aggregate(sides, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / 3.0)
    a, b, c = (F.get(points, F.lit(i)) for i in range(3))
    area = F.abs((b["r"] - a["r"]) * (c["c"] - a["c"]) - (b["c"] - a["c"]) * (c["r"] - a["r"])) / 2.0
    balance = F.greatest(F.lit(0.0), 1.0 - sd / mean)
    part_area = F.least(F.lit(1.0), area / F.greatest(mean * grid_diagonal() / 8.0, F.lit(1e-6)))
    return F.when(F.size(points) < 3, F.lit(0.0)).when(mean <= 1e-6, F.lit(0.0)).otherwise(balance * part_area)


def circular_span(thetas: Column) -> Column:
    """Smallest arc, as a share of the circle, that covers all angles of an array of turns."""
    s = F.array_sort(thetas)
    gaps = F.transform(s, lambda v, i: F.coalesce(F.get(s, i + 1), s[0] + 1.0) - v)
    return F.when(F.size(s) <= 1, F.lit(0.0)).otherwise(1.0 - F.array_max(gaps))


