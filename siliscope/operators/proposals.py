"""Candidate regions for review: windows on a grid and arcs on a polar grid, their suppression and their recall."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siliscope.functions.columns import bin_index, circular_member
from siliscope.operators.pooling import grid_cell, grid_edge

WINDOW_IOU = 0.2
ARC_IOU = 0.35


# fixed values: channel weights of the score maps
def class_score(cls: str) -> Column:
    c = F.col
    if cls == "local":
        s = 0.45 * c("high") + 0.35 * c("severity") + 0.25 * c("fail") + 0.25 * c("stby")
    elif cls == "stby_pattern":
        s = c("stby") + 0.20 * c("high") + 0.10 * c("severity")
    elif cls == "shot_grid":
        s = 0.55 * c("fail") + 0.35 * c("severity") + 0.20 * c("high")
    else:
        s = 0.45 * c("severity") + 0.35 * c("fail") + 0.35 * c("high") + 0.35 * c("stby")
        if cls == "edge":
            s = s * (0.35 + c("outer"))
    return s * c("wafer")


def curve_score(cls: str) -> Column:
    c = F.col
    if cls == "ring":
        s = 0.35 * c("severity") + 0.30 * c("severity_peak") + 0.25 * c("fail") + 0.15 * c("high")
    else:
        s = 0.25 * c("severity") + 0.45 * c("severity_peak") + 0.25 * c("fail") + 0.15 * c("high") + 0.10 * c("stby")
    return s * c("wafer")


def pixel_score(cls: str) -> Column:
    sev = F.least(F.greatest(F.col("severity"), F.lit(0)), F.lit(7)) / 7.0
    fail, high = ((F.col("severity") >= g).cast("double") for g in (1, 6))
    if cls == "ring":
        s = 0.50 * sev + 0.35 * fail + 0.15 * high
    else:
        s = 0.45 * sev + 0.30 * fail + 0.15 * high + 0.25 * (F.col("stby") > 0).cast("double")
    return s * (F.col("in_wafer") > 0).cast("double")


def score_rows(maps: DataFrame, classes: tuple[str, ...], score=class_score) -> DataFrame:
    """(sample, class, gy, gx, score, wafer) of the pooled channels."""
    rows = F.array(*[F.struct(F.lit(c).alias("class_name"), score(c).alias("score")) for c in classes])
    return maps.select("sample_id", "gy", "gx", "wafer", F.explode(rows).alias("r")).select(
        "sample_id", "gy", "gx", "wafer", "r.*")


def window_means(rows: DataFrame, value: str, w: int, size: int, keys: list[str]) -> DataFrame:
    """Mean of every w-by-w window of a full grid; the windows of a wafer stay within its partition."""
    if not 1 <= w <= size:
        raise ValueError("the window must fit inside the grid")
    along = Window.partitionBy(*keys, "gy").orderBy("gx").rowsBetween(0, w - 1)
    down = Window.partitionBy(*keys, "gx").orderBy("gy").rowsBetween(0, w - 1)
    return (rows.repartition(keys[0]).withColumn("_row", F.sum(value).over(along))
            .withColumn("mean", F.sum("_row").over(down) / float(w * w))
            .filter((F.col("gy") <= size - w) & (F.col("gx") <= size - w)).select(*keys, "gy", "gx", "mean"))


def _window_iou(y: np.ndarray, x: np.ndarray, y0: int, x0: int, w: int) -> np.ndarray:
    inter = np.maximum(0, w - np.abs(y - y0)) * np.maximum(0, w - np.abs(x - x0))
    return inter / (2 * w * w - inter)


def suppress_windows(means: DataFrame, w: int, k: int, iou: float = WINDOW_IOU) -> DataFrame:
    """Best windows of each wafer and class that overlap little; one group is one grid, at most a few thousand rows."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["gx"], pdf["gy"], -pdf["mean"].round(9)))
        y, x = pdf["gy"].to_numpy()[order], pdf["gx"].to_numpy()[order]
        free = np.ones(len(order), dtype=bool)
        chosen: list[int] = []
        while len(chosen) < k and free.any():
            i = int(np.argmax(free))
            chosen.append(i)
            free &= _window_iou(y, x, y[i], x[i], w) <= iou
            free[i] = False
        out = pdf.iloc[order[chosen]]
        return pd.DataFrame({"sample_id": out["sample_id"], "class_name": out["class_name"],
                             "place": np.arange(1, len(chosen) + 1), "gy": out["gy"], "gx": out["gx"], "mean": out["mean"]})

    return means.groupBy("sample_id", "class_name").applyInPandas(
        pick, "sample_id string, class_name string, place int, gy int, gx int, mean double")


def random_windows(wafer_means: DataFrame, k: int, seed: int) -> DataFrame:
    """k windows drawn by a keyed digest among those mostly on the wafer, or among all if none is."""
    on = F.col("mean") > 0.15
    per = Window.partitionBy("sample_id", "class_name")
    draw = F.xxhash64(F.lit(seed), "sample_id", "class_name", "gy", "gx")
    return (wafer_means.withColumn("_any", F.max(on.cast("int")).over(per)).filter(on | (F.col("_any") == 0))
            .withColumn("place", F.row_number().over(per.orderBy(draw, "gy", "gx"))).filter(F.col("place") <= k).drop("_any"))


def window_boxes(windows: DataFrame, w: int, size: int, height: Column, width: Column) -> DataFrame:
    """Pixel boxes of grid windows."""
    return windows.withColumns({"y0": grid_edge(F.col("gy"), height, size), "y1": grid_edge(F.col("gy") + w, height, size),
                                "x0": grid_edge(F.col("gx"), width, size), "x1": grid_edge(F.col("gx") + w, width, size)})


def boxes_text(boxes: Column) -> Column:
    """Boxes as text for a spreadsheet view; tables keep the array."""
    return F.array_join(F.transform(boxes, lambda b: F.concat_ws(":", b["y0"], b["y1"], b["x0"], b["x1"],
                                                                 F.format_string("%.4f", b["score"]))), ";")


def parse_boxes(text: Column) -> Column:
    def one(s: Column) -> Column:
        p = F.split(s, ":")
        return F.struct(*[p[i].cast("int").alias(n) for i, n in enumerate(("y0", "y1", "x0", "x1"))], p[4].cast("double").alias("score"))
    return F.transform(F.filter(F.split(text, ";"), lambda s: s != ""), one)


def grid_targets(pixels: DataFrame, classes: tuple[str, ...], size: int) -> DataFrame:
    """Class pixels per grid cell. Windows end on cell edges, so their coverage can be counted from cells."""
    named = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in classes]))
    return (pixels.withColumn("class_name", F.explode(named))
            .groupBy("sample_id", "class_name", grid_cell(F.col("y"), F.col("height"), size).alias("gy"),
                     grid_cell(F.col("x"), F.col("width"), size).alias("gx")).agg(F.count(F.lit(1)).alias("n")))


def window_recall(targets: DataFrame, windows: DataFrame, w: int, name: str = "recall") -> DataFrame:
    """Share of a wafer's class pixels inside any of its windows; a pixel in two windows counts once."""
    boxes = windows.groupBy("sample_id", "class_name").agg(F.collect_list(F.struct("gy", "gx")).alias("boxes"))
    y, x = F.col("gy"), F.col("gx")
    inside = F.exists("boxes", lambda b: (y >= b["gy"]) & (y < b["gy"] + w) & (x >= b["gx"]) & (x < b["gx"] + w))
    return (targets.join(boxes, ["sample_id", "class_name"], "left")
            .groupBy("sample_id", "class_name").agg(F.sum("n").alias("target_pixels"),
                                                    (F.sum(F.when(inside, F.col("n")).otherwise(0)) / F.sum("n")).alias(name)))


def recall_summary(rows: DataFrame, hits: tuple[float, ...]) -> DataFrame:
    """Mean recall of proposals and of random draws per class, their ratio, and hit rates at the given levels."""
    levels = [F.avg((F.col(f"{kind}_recall") >= h).cast("int")).alias(f"{prefix}hit_at_{int(h * 100)}")
              for kind, prefix in (("proposal", ""), ("random", "random_")) for h in hits]
    return rows.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("positive_count"), F.avg("proposal_recall").alias("mean_proposal_recall"),
        F.avg("random_recall").alias("mean_random_recall"),
        (F.avg("proposal_recall") / F.greatest(F.avg("random_recall"), F.lit(1e-9))).alias("recall_lift"), *levels)


def polar_scores(polar: DataFrame, classes: tuple[str, ...], radial: int, angular: int) -> DataFrame:
    """Mean pixel score per polar bin over the wafer."""
    rows = F.array(*[F.struct(F.lit(c).alias("class_name"), pixel_score(c).alias("score")) for c in classes])
    return (polar.filter(F.col("in_wafer") > 0)
            .select("sample_id", bin_index(F.col("radius"), radial).alias("r"), bin_index(F.col("theta"), angular).alias("a"),
                    F.explode(rows).alias("s"))
            .groupBy("sample_id", "s.class_name", "r", "a").agg(F.avg("s.score").alias("score")))


def polar_targets(polar: DataFrame, classes: tuple[str, ...], radial: int, angular: int) -> DataFrame:
    named = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in classes]))
    return (polar.withColumn("class_name", F.explode(named))
            .groupBy("sample_id", "class_name", bin_index(F.col("radius"), radial).alias("r"),
                     bin_index(F.col("theta"), angular).alias("a")).agg(F.count(F.lit(1)).alias("n")))


def arc_families(cls: str, radial: int, angular: int) -> pd.DataFrame:
    """All candidates of a class on a polar grid; the list depends on the grid alone."""
    rows: list[tuple] = []
    # fixed values: widths of the candidate families
    if cls == "ring":
        top = max(2, int(radial * 0.90))
        for rw in (1, 2, 3):
            starts = range(1, min(radial - rw, top))
            rows += [("annulus", r, r + rw, 0, angular) for r in starts]
        for rw in (1, 2, 3):
            for aw in (8, 12, 16, 24):
                rows += [("partial_ring", r, r + rw, a, a + aw) for r in range(1, min(radial - rw, top))
                         for a in range(0, angular, 2)]
    else:
        for rw in (1, 2, 3):
            for aw in (4, 8, 12, 16):
                rows += [("spin_arc", r, r + rw, a, a + aw) for r in range(1, radial - rw) for a in range(0, angular, 2)]
        rows += [("radial_scratch", r0, r1, a, a + aw) for r0 in range(1, max(2, radial // 2))
                 for r1 in range(max(r0 + radial // 3, radial // 2), radial) for aw in (1, 2, 3) for a in range(angular)]
    return pd.DataFrame(rows, columns=["kind", "r0", "r1", "a0", "a1"])


def score_arcs(grid: np.ndarray, arcs: pd.DataFrame) -> np.ndarray:
    """Score of each candidate on one polar grid, from running sums over the grid laid out twice around the circle."""
    radial, angular = grid.shape
    seen = grid[grid > 0]
    baseline, spread = (float(np.median(seen)), float(seen.std())) if seen.size else (0.0, 0.0)
    residual = grid - baseline
    hit = residual > max(0.01, 0.20 * spread)
    laps = int(np.ceil(arcs["a1"].max() / angular)) + 1

    def running(values: np.ndarray) -> np.ndarray:
        wide = np.tile(values.astype(float), (1, laps))
        return np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    r0, r1, a0, a1 = (arcs[c].to_numpy() for c in ("r0", "r1", "a0", "a1"))

    def box(table: np.ndarray) -> np.ndarray:
        return table[r1, a1] - table[r0, a1] - table[r1, a0] + table[r0, a0]

    area = ((r1 - r0) * (a1 - a0)).astype(float)
    total, n_hit, hit_sum = box(running(residual)), box(running(hit)), box(running(residual * hit))
    continuity = np.zeros(len(arcs))
    radial_kind = (arcs["kind"] == "radial_scratch").to_numpy()
    for start, end in {(int(a), int(b)) for a, b in zip(r0[~radial_kind], r1[~radial_kind])}:
        rows = ~radial_kind & (r0 == start) & (r1 == end)
        cols = np.concatenate([[0], np.tile(hit[start:end].any(0), laps).cumsum()])
        continuity[rows] = (cols[a1[rows]] - cols[a0[rows]]) / (a1[rows] - a0[rows])
    for start, end in {(int(a), int(b)) for a, b in zip(a0[radial_kind], a1[radial_kind])}:
        rows = radial_kind & (a0 == start) & (a1 == end)
        lines = np.concatenate([[0], hit[:, np.arange(start, end) % angular].any(1).cumsum()])
        continuity[rows] = (lines[r1[rows]] - lines[r0[rows]]) / (r1[rows] - r0[rows])
    some = np.round(n_hit) > 0
    strength = np.divide(hit_sum, n_hit, out=np.zeros_like(hit_sum), where=some)
    support = np.maximum(n_hit / area, 1.0 / area)
    return np.where(some, strength * (0.15 + continuity) * np.sqrt(support), total / area)


def _arc_overlap(arcs: pd.DataFrame, one: pd.Series, angular: int) -> np.ndarray:
    rows = np.maximum(0, np.minimum(arcs["r1"], one["r1"]) - np.maximum(arcs["r0"], one["r0"])).to_numpy()
    a0, a1 = arcs["a0"].to_numpy(), arcs["a1"].to_numpy()
    # a bin is shared when both intervals cover it, each possibly after a full turn
    mine = (np.arange(angular)[:, None] - one["a0"]) % angular < min(angular, one["a1"] - one["a0"])
    theirs = (np.arange(angular)[:, None] - a0[None, :]) % angular < np.minimum(angular, a1 - a0)[None, :]
    shared = rows * (mine & theirs).sum(0)
    union = (arcs["r1"] - arcs["r0"]) * (a1 - a0) + (one["r1"] - one["r0"]) * (one["a1"] - one["a0"]) - shared
    return shared / np.maximum(union.to_numpy(), 1)


ARC_SCHEMA = "sample_id string, class_name string, place int, kind string, r0 int, r1 int, a0 int, a1 int, score double"


def arc_candidates(scores: DataFrame, radial: int, angular: int, k: int | None = None, iou: float = ARC_IOU) -> DataFrame:
    """Scored arcs per wafer and class: all of them, or the best k that overlap little.

    One group is one polar grid of a wafer, whatever its number of pixels.
    """

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        cls = pdf["class_name"].iloc[0]
        grid = np.zeros((radial, angular))
        grid[pdf["r"], pdf["a"]] = pdf["score"]
        arcs = arc_families(cls, radial, angular)
        arcs["score"] = score_arcs(grid, arcs)
        order = np.argsort(-arcs["score"].round(9).to_numpy(), kind="stable")
        arcs = arcs.iloc[order].reset_index(drop=True)
        if k is not None:
            free, chosen = np.ones(len(arcs), dtype=bool), []
            while len(chosen) < k and free.any():
                i = int(np.argmax(free))
                chosen.append(i)
                free &= _arc_overlap(arcs, arcs.iloc[i], angular) <= iou
                free[i] = False
            arcs = arcs.iloc[chosen]
        return arcs.assign(sample_id=pdf["sample_id"].iloc[0], class_name=cls, place=np.arange(1, len(arcs) + 1))[
            ["sample_id", "class_name", "place", "kind", "r0", "r1", "a0", "a1", "score"]]

    return scores.groupBy("sample_id", "class_name").applyInPandas(find, ARC_SCHEMA)


def random_arcs(groups: DataFrame, radial: int, angular: int, k: int, seed: int) -> DataFrame:
    """k arcs per wafer and class with kind, width and place drawn by keyed digests."""
    def unit(tag: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "sample_id", "class_name", "place"), F.lit(1 << 30)) / float(1 << 30)

    def pick(tag: str, values: tuple[int, ...]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(unit(tag) * len(values)) + 1).cast("int"))

    def between(tag: str, low: Column, high: Column) -> Column:
        return (low + F.floor(unit(tag) * (high - low))).cast("int")

    ring = F.col("class_name") == "ring"
    kind = F.when(ring, F.when(unit("kind") < 0.35, "annulus").otherwise("partial_ring")).otherwise(
        F.when(unit("kind") < 0.65, "spin_arc").otherwise("radial_scratch"))
    radial_kind = F.col("kind") == "radial_scratch"
    width = pick("rw", (1, 2, 3))
    rows = groups.select("sample_id", "class_name", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("place")).withColumn("kind", kind)
    rows = rows.withColumn("r0", F.when(radial_kind, between("r0", F.lit(1), F.lit(max(2, radial // 2))))
                           .otherwise(between("r0", F.lit(1), F.lit(radial) - width)))
    rows = rows.withColumn("r1", F.when(radial_kind, between("r1", F.greatest(F.col("r0") + radial // 3, F.lit(radial // 2)), F.lit(radial)))
                           .otherwise(F.col("r0") + width))
    a_width = (F.when(F.col("kind") == "annulus", F.lit(angular)).when(ring, pick("aw", (8, 12, 16, 24)))
               .when(radial_kind, pick("aw", (1, 2, 3))).otherwise(pick("aw", (4, 8, 12, 16))))
    rows = rows.withColumn("a0", F.when(F.col("kind") == "annulus", F.lit(0)).otherwise(between("a0", F.lit(0), F.lit(angular))))
    return rows.withColumn("a1", (F.col("a0") + a_width).cast("int"))


def arc_recall(targets: DataFrame, arcs: DataFrame, angular: int, name: str = "recall") -> DataFrame:
    """Share of a wafer's class pixels in any of its arcs, from counts per polar bin."""
    packed = arcs.groupBy("sample_id", "class_name").agg(F.collect_list(F.struct("r0", "r1", "a0", "a1")).alias("arcs"))
    r, a = F.col("r"), F.col("a")
    inside = F.exists("arcs", lambda c: (r >= c["r0"]) & (r < c["r1"]) & circular_member(a, c["a0"], c["a1"] - c["a0"], angular))
    return (targets.join(packed, ["sample_id", "class_name"], "left").groupBy("sample_id", "class_name")
            .agg(F.sum("n").alias("target_pixels"), (F.sum(F.when(inside, F.col("n")).otherwise(0)) / F.sum("n")).alias(name)))


def arcs_on_grid(maps: DataFrame, arcs: DataFrame, size: int, radial: int, angular: int) -> DataFrame:
    """Square-grid cells covered by any arc of the wafer and class; only cells well on the wafer take part."""
    from siliscope.functions.columns import clock_turn
    c = (size - 1) / 2.0
    dy, dx = F.col("gy") - c, F.col("gx") - c
    dist = F.sqrt(dy * dy + dx * dx)
    far = F.max(dist).over(Window.partitionBy("sample_id"))
    cells = (maps.filter(F.col("wafer") > 0.2).withColumn("far", far)
             .select("sample_id", "gy", "gx", bin_index(F.least(dist / F.greatest("far", F.lit(1.0)), F.lit(0.999)), radial).alias("r"),
                     bin_index(clock_turn(dx, dy), angular).alias("a")))
    packed = arcs.groupBy("sample_id", "class_name").agg(F.collect_list(F.struct("r0", "r1", "a0", "a1")).alias("arcs"))
    r, a = F.col("r"), F.col("a")
    inside = F.exists("arcs", lambda k: (r >= k["r0"]) & (r < k["r1"]) & circular_member(a, k["a0"], k["a1"] - k["a0"], angular))
    return cells.join(packed, "sample_id").filter(inside).select("sample_id", "class_name", "gy", "gx")
