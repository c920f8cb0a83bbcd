"""Regions of pixel images labelled by tiles, against labelling in one piece."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from siliscope.operators import components as cp
from siliscope.operators import pixelscores as ps

CELLS = "sample_id string, y int, x int, height int, width int"


def table(spark, masks):
    return spark.createDataFrame([(n, int(y), int(x), *m.shape) for n, m in masks.items() for y, x in zip(*np.nonzero(m))], CELLS)


def in_one_piece(mask, diagonal):
    labels = cp.label_mask(mask[None], diagonal)[0]
    around = np.pad(mask, 1).astype(int)
    four = around[:-2, 1:-1] + around[2:, 1:-1] + around[1:-1, :-2] + around[1:-1, 2:]
    return {(int(y), int(x)): (int(labels[y, x]), int(four[y, x] < 4)) for y, x in zip(*np.nonzero(mask))}


def snake(h, w):
    """One region that crosses every border of every tile."""
    mask = np.zeros((h, w), bool)
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    return mask


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("tile", [4, 7])
def test_tiles_equal_one_piece(spark, diagonal, tile):
    rng = np.random.default_rng(tile)
    masks = {f"r{i}": rng.random((h, w)) < share for i, (h, w, share) in enumerate(
        [(23, 31, 0.45), (16, 16, 0.6), (30, 9, 0.3), (1, 40, 0.8), (40, 1, 0.8), (8, 8, 1.0)])}
    masks["snake"] = snake(25, 18)
    masks["corners"] = np.kron(np.indices((6, 6)).sum(0) % 2, np.ones((4, 4))).astype(bool)  # tiles that touch at corners alone
    got = {}
    for r in cp.tiled_regions(table(spark, masks), diagonal, tile).collect():
        got.setdefault(r.sample_id, {})[(r.y, r.x)] = (r.region, r.edge)
    assert got == {n: in_one_piece(m, diagonal) for n, m in masks.items()}


def test_region_figures_do_not_depend_on_tiles(spark):
    masks = {"a": np.random.default_rng(1).random((40, 50)) < 0.55, "b": snake(33, 20)}
    cells = table(spark, masks)
    small, whole = (sorted(map(tuple, ps.region_table(cells, tile).select("sample_id", "region", "area", "perimeter", F.round("elongation", 9)).collect()))
                    for tile in (6, 64))
    assert small == whole and sum(r[2] for r in small) == sum(int(m.sum()) for m in masks.values())
    assert ps.region_table(cells.limit(0)).count() == 0


def test_an_image_larger_than_a_tile(spark):
    """A bar across 1,900 columns is one region of eight tiles."""
    bar = spark.range(1900).select(F.lit("w").alias("sample_id"), F.lit(255).alias("y"), F.col("id").cast("int").alias("x"), F.lit(2000).alias("height"), F.lit(1900).alias("width"))
    both = bar.unionByName(bar.withColumn("y", F.lit(256)))
    row = ps.region_table(both).collect()
    assert [(r.region, r.area, r.perimeter) for r in row] == [(255 * 1900, 3800, 3800)]
