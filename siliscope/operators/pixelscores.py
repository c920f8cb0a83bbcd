"""The alternative feature space: grade histogram, profiles along four axes and rule scores on pixel level.

``grade_base`` is the grade of good pixels, 0 or 1. Severity runs from there to the largest grade; a fail grade is meant on the
table's own scale.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siliscope.constants import MAX_GRADE
from siliscope.functions.columns import bin_index, ratio
from siliscope.operators.components import TILE, tile_labels, united_parts
from siliscope.operators.pooling import angular_spectrum, box_mean
from siliscope.sources.staging import stage

MIN_AREA = 12


def fail_pixels(pixels: DataFrame, grade: int) -> DataFrame:
    return pixels.filter((F.col("valid") == 1) & (F.col("severity") >= grade)).select("sample_id", "y", "x", "height", "width")


def region_table(fails: DataFrame, tile: int = TILE) -> DataFrame:
    """Area, perimeter and elongation of every 4-connected region of failing pixels.

    Sums are taken per tile first, so only a row per part of a region meets the other parts.
    """
    labelled = stage(tile_labels(fails, tile=tile))
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    names = ("area", "perimeter", "sy", "sx", "syy", "sxx", "sxy")
    parts = labelled.groupBy("sample_id", "part").agg(
        F.count(F.lit(1)).alias("area"), F.sum("edge").alias("perimeter"), F.sum(y).alias("sy"), F.sum(x).alias("sx"),
        F.sum(y * y).alias("syy"), F.sum(x * x).alias("sxx"), F.sum(y * x).alias("sxy"))
    sums = parts.join(united_parts(labelled, tile=tile), ["sample_id", "part"], "left").groupBy(
        "sample_id", F.coalesce("region", "part").alias("region")).agg(*[F.sum(n).alias(n) for n in names])
    n = F.col("area").cast("double")
    free = n * F.greatest(n - 1, F.lit(1.0))
    vy, vx = (n * F.col("syy") - F.col("sy") * F.col("sy")) / free, (n * F.col("sxx") - F.col("sx") * F.col("sx")) / free
    vxy = (n * F.col("sxy") - F.col("sy") * F.col("sx")) / free
    root = F.sqrt((vy - vx) * (vy - vx) + 4.0 * vxy * vxy)
    return sums.select("sample_id", "region", "area", "perimeter",
                       F.sqrt(((vy + vx + root) / 2.0 + 1e-6) / ((vy + vx - root) / 2.0 + 1e-6)).alias("elongation"))


def component_scores(pixels: DataFrame, grade: int) -> DataFrame:
    """Line, blob, area and count scores of the regions of at least twelve pixels."""
    a, e, p = F.col("area").cast("double"), F.col("elongation"), F.col("perimeter").cast("double")
    one = F.lit(1.0)
    scratch = F.least(one, F.greatest(F.lit(0.0), (e - 2.5) / 12.0)) * F.least(one, a / 600.0)
    compact = F.lit(4.0 * math.pi) * a / F.greatest(p * p, one)
    blob = F.least(one, compact) * F.least(one, a / 500.0) * F.greatest(F.lit(0.0), 1.0 - (e - 1.0) / 6.0)
    large = region_table(fail_pixels(pixels, grade)).filter(F.col("area") >= MIN_AREA)
    scores = large.groupBy("sample_id").agg(F.max(scratch).alias("scratch_score"), F.max(blob).alias("blob_score"),
                                            F.least(one, F.max(a) / 2500.0).alias("area_score"),
                                            F.least(one, F.count(F.lit(1)) / 30.0).alias("component_count_score"))
    return pixels.select("sample_id").distinct().join(scores, "sample_id", "left").fillna(0.0)


def profile_features(polar: DataFrame, grade_base: int = 0) -> DataFrame:
    """(sample, vec): shares of grades 1..7, then mean severity by radius, angle, column and row bin; empty bins are zero."""
    sev = (F.col("severity") - grade_base) / float(MAX_GRADE - grade_base)
    valid = polar.filter(F.col("valid") == 1)
    place = F.array(*[F.struct(F.lit(start).alias("start"), b.alias("b")) for start, b in (
        (7, bin_index(F.col("radius"), 32)), (39, bin_index(F.col("theta"), 36)),
        (75, F.floor(F.col("x") * 32 / F.col("width")).cast("int")), (107, F.floor(F.col("y") * 32 / F.col("height")).cast("int")))])
    means = (valid.select("sample_id", "severity", F.explode(place).alias("p"))
             .groupBy("sample_id", (F.col("p.start") + F.col("p.b")).alias("pos")).agg(F.avg(sev).alias("v")))
    shares = valid.groupBy("sample_id").agg(*[ratio(F.count_if(F.col("severity") == g + grade_base), F.count(F.lit(1))).alias(f"g{g}") for g in range(1, 8)])
    packed = means.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    tail = F.transform(F.sequence(F.lit(7), F.lit(138)), lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0)))
    return shares.join(packed, "sample_id").select("sample_id", F.concat(F.array(*[f"g{g}" for g in range(1, 8)]), tail).alias("vec"))


def rule_scores(polar: DataFrame, height: int, width: int, grade: int, half: int, grade_base: int = 0) -> DataFrame:
    """Ten scores in [0, 1]-like ranges: fail rate, severity, edge lift, ring, local, grid and the component scores."""
    valid = F.col("valid") == 1
    sev = F.when(valid, (F.col("severity") - grade_base) / float(MAX_GRADE - grade_base)).otherwise(0.0)
    fail = (valid & (F.col("severity") >= grade)).cast("int")
    rows = polar.withColumns({"sev": sev, "fail": fail, "rr": F.sqrt(F.col("d2").cast("double")) / F.sqrt(F.col("wafer_extent").cast("double"))})

    def mean(cond: Column, name: str) -> Column:
        return F.coalesce(F.avg(F.when(cond, F.col(name))), F.lit(0.0))

    base = rows.groupBy("sample_id").agg(
        mean(valid, "fail").alias("fail_rate"), mean(valid, "sev").alias("mean_severity"), F.avg("fail").alias("fail_all"),
        F.least(mean((F.col("rr") > 0.78) & valid, "sev") / (mean((F.col("rr") < 0.55) & valid, "sev") + 1e-5) / 5.0, F.lit(1.0)).alias("edge_lift"))

    def clip(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    ring = rows.filter(valid).groupBy("sample_id", bin_index(F.least("rr", F.lit(0.999999)), 36).alias("b")).agg(F.avg("sev").alias("v"))
    bins = rows.select("sample_id").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(35))))
    ring = bins.join(ring, ["sample_id", "b"], "left").fillna(0.0, ["v"]).groupBy("sample_id").agg(
        clip((F.max("v") - F.percentile("v", F.lit(0.5))) / (F.stddev_pop("v") + 1e-5) / 5.0).alias("ring_score"))
    lines = None
    for axis in ("y", "x"):
        one = rows.groupBy("sample_id", axis).agg(F.avg("fail").alias("m")).groupBy("sample_id").agg(F.stddev_pop("m").alias(f"sd_{axis}"))
        lines = one if lines is None else lines.join(one, "sample_id")
    dense = box_mean(rows.select("sample_id", F.col("y").alias("gy"), F.col("x").alias("gx"), "fail"), "fail", half, height, width, ["sample_id"])
    dense = dense.groupBy("sample_id").agg(F.max("box_mean").alias("densest"))
    joined = base.join(ring, "sample_id").join(lines, "sample_id").join(dense, "sample_id").join(component_scores(polar, grade), "sample_id")
    return joined.select("sample_id", "fail_rate", "mean_severity", "edge_lift", "ring_score", "scratch_score", "blob_score",
                         clip(F.col("densest") / (F.col("fail_all") + 1e-5) / 28.0).alias("local_score"),
                         clip(F.greatest("sd_y", "sd_x") / (F.col("fail_all") + 1e-5) / 8.0).alias("grid_score"),
                         "area_score", "component_count_score")


SCORES = ("fail_rate", "mean_severity", "edge_lift", "ring_score", "scratch_score", "blob_score", "local_score", "grid_score",
          "area_score", "component_count_score")


def combined_vectors(polar: DataFrame, height: int, width: int, grade: int, half: int, grade_base: int = 0,
                     invariant: bool = False) -> DataFrame:
    """(id, vec) for the alternative search: histogram, column, row, radial and angular profiles and the rule scores.

    The ``invariant`` form stays the same for a turned wafer: histogram, radial profile, angular spectrum and rule scores. Search
    them with ``search.cosine_neighbors`` on ``search.standardised_vectors(..., flat_as_one=True)``.
    """
    parts = profile_features(polar, grade_base)
    piece = lambda start, n: F.slice("vec", start + 1, n)
    scores = rule_scores(polar, height, width, grade, half, grade_base).select(
        "sample_id", F.array(*[F.col(c).cast("double") for c in SCORES]).alias("scores"))
    if invariant:
        waves = angular_spectrum(parts.select("sample_id", piece(39, 36).alias("profile")), 36, 12).groupBy("sample_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("k", "magnitude"))), lambda w: w["magnitude"]).alias("waves"))
        rows = parts.join(waves, "sample_id").join(scores, "sample_id")
        return rows.select(F.col("sample_id").alias("id"), F.concat(piece(0, 7), piece(7, 32), "waves", "scores").alias("vec"))
    rows = parts.join(scores, "sample_id")
    return rows.select(F.col("sample_id").alias("id"), F.concat(piece(0, 7), piece(75, 32), piece(107, 32), piece(7, 32), piece(39, 36), "scores").alias("vec"))
