"""Wafer maps on coarse grids: pooled channels, resized tensors, profiles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.functions.columns import ratio, TWO_PI
from siliscope.sources.staging import stage


def grid_cell(position: Column, length: Column, cells: int) -> Column:
    """Cell whose edges floor(i * length / cells) enclose the position."""
    return F.floor(((position + 1) * cells - 1) / length).cast("int")


def grid_edge(index: Column, length: Column, cells: int) -> Column:
    return F.floor(index * length / F.lit(cells)).cast("int")


def grid_edges(wafers: DataFrame, cells: int) -> DataFrame:
    """Edge table of a grid, one row per wafer shape and edge."""
    i = F.explode(F.sequence(F.lit(0), F.lit(cells)))
    return (wafers.select("height", "width").distinct().select("height", "width", i.alias("i"))
            .select("height", "width", "i", grid_edge(F.col("i"), F.col("height"), cells).alias("y_edge"),
                    grid_edge(F.col("i"), F.col("width"), cells).alias("x_edge")))


def pooled(pixels: DataFrame, cells: int, classes: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums per wafer and grid cell, one pass; every channel below is a ratio of these columns."""
    valid, wafer = F.col("valid") > 0, F.col("in_wafer") > 0
    grade = F.least(F.greatest(F.col("severity"), F.lit(0)), F.lit(C.MAX_GRADE))
    image = F.when(F.col("stby") > 0, F.lit(7)).when(wafer, grade).otherwise(F.lit(0))
    return (
        pixels.groupBy("sample_id", grid_cell(F.col("y"), F.col("height"), cells).alias("gy"),
                       grid_cell(F.col("x"), F.col("width"), cells).alias("gx"))
        .agg(F.count(F.lit(1)).alias("area"), F.count_if(wafer).alias("n_wafer"), F.count_if(valid).alias("n_valid"),
             F.count_if(wafer & (F.col("stby") > 0)).alias("n_stby"), F.count_if(wafer & valid).alias("n_wafer_valid"),
             F.sum(F.when(valid, grade).otherwise(0)).alias("sev_sum"), F.sum(grade).alias("sev_all"),
             F.coalesce(F.max(F.when(valid, grade)), F.lit(0)).alias("sev_max"),
             F.count_if(valid & (F.col("severity") > 0)).alias("n_fail"),
             F.count_if(valid & (F.col("severity") >= 6)).alias("n_high"), F.sum(image).alias("image_sum"),
             *[F.max((F.col(m) > 0).cast("int")).alias(f"any_{m}") for m in ("in_wafer", "valid", "stby")],
             *[F.max((F.col(c) > 0).cast("int")).alias(f"any_{c}") for c in classes],
             *[F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in classes]))


def coarser(cells: DataFrame, factor: int) -> DataFrame:
    """The counts of ``pooled`` on a grid with ``factor`` times fewer cells a side.

    A grid's edges are edges of every grid whose cells it joins, so the counts add up exactly and pixels are read once.
    """
    names = [c for c in cells.columns if c not in ("sample_id", "gy", "gx")]
    largest = lambda c: c == "sev_max" or c.startswith("any_")
    return cells.groupBy("sample_id", F.floor(F.col("gy") / factor).cast("int").alias("gy"), F.floor(F.col("gx") / factor).cast("int").alias("gx")).agg(
        *[(F.max(c) if largest(c) else F.sum(c)).alias(c) for c in names])


def representations(pixels: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(space, id, vec): the plain picture and the semantic channels of every wafer on grids of the given sizes, from one pass
    over the pixels at the finest grid. Sizes divide the largest; vectors of one space are equally long for maps of one shape."""
    finest = max(sizes)
    if any(finest % n for n in sizes):
        raise ValueError("every grid size has to divide the largest")
    cells, out = stage(pooled(pixels, finest)), None
    for n in sizes:
        grid = cells if n == finest else coarser(cells, finest // n)
        for name, vectors in (("naive_gray", gray_vector(grid, n)), ("semantic_pool", semantic_vector(grid, n))):
            one = vectors.select(F.lit(f"{name}_{n}").alias("space"), "id", "vec")
            out = one if out is None else out.unionByName(one)
    return out


def semantic_maps(cells: DataFrame, size: int) -> DataFrame:
    """Mean grade, peak, fail and high-grade rates over tested pixels, untested share, wafer share, distance from centre."""
    c = (size - 1) / 2.0
    unit = max(c, 1.0)
    dy, dx = (F.col("gy") - c) / unit, (F.col("gx") - c) / unit
    return cells.select(
        "sample_id", "gy", "gx", (ratio(F.col("sev_sum"), F.col("n_valid")) / 7.0).alias("severity"),
        (F.col("sev_max") / 7.0).alias("severity_peak"), ratio(F.col("n_fail"), F.col("n_valid")).alias("fail"),
        ratio(F.col("n_high"), F.col("n_valid")).alias("high"), ratio(F.col("n_stby"), F.col("n_wafer")).alias("stby"),
        ratio(F.col("n_wafer_valid"), F.col("n_wafer")).alias("valid"), ratio(F.col("n_wafer"), F.col("area")).alias("wafer"),
        F.least(F.sqrt(dy * dy + dx * dx), F.lit(1.0)).alias("outer"))


def flattened(cells: DataFrame, size: int, channels: dict[str, Column]) -> DataFrame:
    """(id, vec): the channels of a wafer one after the other, each in row-major order; a grid has a fixed size."""
    packed = cells.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("gy") * size + F.col("gx")).alias("cell"), *[c.cast("double").alias(n) for n, c in channels.items()]))).alias("g"))
    return packed.select(F.col("sample_id").alias("id"), F.concat(*[F.col(f"g.{n}") for n in channels]).alias("vec"))


def input_tensor(cells: DataFrame, size: int) -> DataFrame:
    """Mean grade and the three masks (any pixel counts), flattened; thin structures survive the resize."""
    return flattened(cells, size, {"severity": F.col("sev_all") / (7.0 * F.col("area")), "wafer": F.col("any_in_wafer"),
                                   "valid": F.col("any_valid"), "stby": F.col("any_stby")})


def target_tensor(cells: DataFrame, size: int, classes: tuple[str, ...]) -> DataFrame:
    return flattened(cells, size, {c: F.col(f"any_{c}") for c in classes})


def gray_vector(cells: DataFrame, size: int) -> DataFrame:
    """Plain downsized picture: untested pixels white, outside black."""
    return flattened(cells, size, {"gray": F.col("image_sum") / (7.0 * F.col("area"))})


def semantic_vector(cells: DataFrame, size: int) -> DataFrame:
    maps = semantic_maps(cells, size)
    return flattened(maps, size, {n: F.col(n) for n in ("severity", "fail", "high", "stby", "valid", "wafer")})


def box_mean(cells: DataFrame, value: str, half: int, rows: int, cols: int, keys: list[str]) -> DataFrame:
    """Mean over a (2*half+1)-square around every cell of a full map, mirrored at its borders.

    Sums along rows, then along columns. Only cells near a border get mirrored copies, so no cell is copied for each square it
    falls into; the square may reach as far as the map's own mirror image.
    """
    side = 2 * half + 1
    if half > min(rows, cols):
        raise ValueError("the square reaches beyond the mirrored map")

    def along(df: DataFrame, line: str, pos: str, length: int) -> DataFrame:
        p = F.col(pos)
        places = F.filter(F.array(p, -p - 1, 2 * length - 1 - p), lambda q: (q >= -half) & (q < length + half))
        mirrored = df.select(*keys, line, "_v", F.explode(places).alias(pos))
        near = Window.partitionBy(*keys, line).orderBy(pos).rowsBetween(-half, half)
        return mirrored.withColumn("_v", F.sum("_v").over(near)).filter((p >= 0) & (p < length))

    own = cells.select(*keys, "gy", "gx", F.col(value).cast("double").alias("_v"))
    summed = along(along(own, "gy", "gx", cols), "gx", "gy", rows)
    return summed.select(*keys, "gy", "gx", (F.col("_v") / float(side * side)).alias("box_mean"))


def angular_spectrum(profile: DataFrame, bins: int, last: int = 12) -> DataFrame:
    """Magnitudes 1..last of the angular profile over its mean level: the same for a rotated wafer."""
    rows = profile.select("sample_id", F.posexplode("profile").alias("i", "v"))
    waves = rows.select("sample_id", "i", "v", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("k"))
    angle = F.lit(TWO_PI) * F.col("k") * F.col("i") / F.lit(float(bins))
    power = waves.groupBy("sample_id", "k").agg(
        F.hypot(F.sum(F.col("v") * F.cos(angle)), F.sum(F.col("v") * F.sin(angle))).alias("m"))
    dc = F.col("dc") + 1e-6
    level = power.filter("k = 0").select("sample_id", F.col("m").alias("dc"))
    return power.filter("k > 0").join(level, "sample_id").select("sample_id", "k", (F.col("m") / dc).alias("magnitude"))
