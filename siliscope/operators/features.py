"""Interpretable wafer features: fifty compact measures and 108 location-aware ones.

Pixel families are one aggregate over pixels; chip families read the chip table, which holds a few hundred rows per wafer.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siliscope.functions.columns import bin_index, ratio
from siliscope.operators import components as cmp
from siliscope.operators.geometry import Geometry, with_chip_polar, with_polar
from siliscope.sources.staging import stage_by


def _valid() -> Column:
    return F.col("valid") == 1


def _fails() -> Column:
    return _valid() & (F.col("severity") > 0)


def _global_aggs() -> list[Column]:
    n_valid = F.count_if(_valid())
    return [
        ratio(F.count_if(_fails()), n_valid).alias("total_fail_density"),
        (F.sum(F.when(_valid(), F.col("severity")).otherwise(0)).cast("double")
         / (F.greatest(n_valid, F.lit(1)) * F.lit(7.0))).alias("grade_weighted_severity"),
        ratio(F.count_if(F.col("stby") == 1), F.count_if(F.col("in_wafer") == 1)).alias("stby_ratio"),
    ]


def _bin_aggs(bin_col: str, names: list[str]) -> list[Column]:
    """Mean normalised grade of tested pixels per bin, one expression per bin; an empty bin is zero."""
    out = []
    for i, name in enumerate(names):
        hit = _valid() & (F.col(bin_col) == i)
        total = F.sum(F.when(hit, F.col("severity")).otherwise(0)).cast("double")
        out.append((total / (F.greatest(F.count_if(hit), F.lit(1)) * F.lit(7.0))).alias(name))
    return out


def _zone_names(bins: int) -> list[str]:
    return [f"radial_zone_{i:02d}_severity" for i in range(bins)]


def _sector_names(bins: int) -> list[str]:
    return [f"angular_sector_{i:02d}_severity" for i in range(bins)]


def _edge_aggs() -> list[Column]:
    def rate(zone: int) -> Column:
        return ratio(F.count_if(_fails() & (F.col("zone5") == zone)), F.count_if(_valid() & (F.col("zone5") == zone)))
    return [rate(4).alias("edge_density"), rate(0).alias("center_density"),
            (rate(4) - rate(0)).alias("edge_minus_center_density")]


def global_densities(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("sample_id").agg(*_global_aggs())


def radial_zones(polar: DataFrame, bins: int = 5) -> DataFrame:
    return (polar.withColumn("zone", bin_index(F.col("radius"), bins)).groupBy("sample_id")
            .agg(*_bin_aggs("zone", _zone_names(bins))))


def angular_sectors(polar: DataFrame, bins: int = 12) -> DataFrame:
    return (polar.withColumn("sector", bin_index(F.col("theta"), bins)).groupBy("sample_id")
            .agg(*_bin_aggs("sector", _sector_names(bins))))


def edge_center_density(polar: DataFrame) -> DataFrame:
    return polar.withColumn("zone5", bin_index(F.col("radius"), 5)).groupBy("sample_id").agg(*_edge_aggs())


def edge_chip_faces(polar: DataFrame, geo: Geometry, face_of: str = "valid") -> DataFrame:
    """Pixels of edge chips with their position between the chip's inner and outer face, 0 to 1.

    ``face_of`` is the mask whose pixels span the radius range: tested pixels for the feature, all pixels for the
    batch report. Chips that cannot reach the edge ring are dropped before the shuffle.
    """
    def far(pos: str, chip: str, size: str) -> Column:
        first = 2 * F.col(pos) * geo.col(chip) - (F.col(size) - 1)
        last = 2 * ((F.col(pos) + 1) * geo.col(chip) - 1) - (F.col(size) - 1)
        return F.greatest(F.abs(first), F.abs(last)).cast("double")

    reach = F.sqrt(F.pow(far("chip_row", "chip_h", "height"), 2) + F.pow(far("chip_col", "chip_w", "width"), 2))
    # a hair of slack: this only spares work, the exact test is the one on the chip's own pixels below
    near_edge = reach / F.greatest(F.sqrt(F.col("wafer_extent").cast("double")), F.lit(2.0)) >= 0.7799
    w = Window.partitionBy("sample_id", "chip_row", "chip_col")
    rows = polar.filter(near_edge)
    if face_of == "valid":
        rows = rows.filter(_valid())
    return (
        rows.withColumns({"valid_max": F.max(F.when(_valid(), F.col("radius"))).over(w),
                          "r_min": F.min("radius").over(w), "r_max": F.max("radius").over(w)})
        .filter((F.col("valid_max") >= 0.78) & (F.col("r_max") > F.col("r_min")) & _valid())
        .withColumn("face", (F.col("radius") - F.col("r_min")) / (F.col("r_max") - F.col("r_min")))
    )


def edge_face_rates(polar: DataFrame, geo: Geometry, face_of: str = "valid") -> DataFrame:
    """Fail-rate difference of the outer and inner faces; wafers without an edge chip have no row."""
    inner, outer = F.col("face") < 0.34, F.col("face") > 0.66
    return edge_chip_faces(polar, geo, face_of).groupBy("sample_id").agg(
        (ratio(F.count_if(outer & _fails()), F.count_if(outer))
         - ratio(F.count_if(inner & _fails()), F.count_if(inner))).alias("edge_chip_outer_minus_inner_density"))


def edge_face_density(polar: DataFrame, geo: Geometry, face_of: str = "valid") -> DataFrame:
    faces = edge_face_rates(polar, geo, face_of)
    return (polar.select("sample_id").distinct().join(faces, "sample_id", "left")
            .fillna(0.0, ["edge_chip_outer_minus_inner_density"]))


def bin_profile(polar: DataFrame, position: str, bins: int, value: str = "severity", mask: str = "valid",
                scale: float = 7.0) -> DataFrame:
    """Mean of a value per radial or angular bin as one array per wafer; an empty bin is zero."""
    means = (polar.filter(F.col(mask) == 1).groupBy("sample_id", bin_index(F.col(position), bins).alias("bin"))
             .agg((F.sum(value).cast("double") / (F.lit(scale) * F.count(F.lit(1)))).alias("mean")))
    packed = means.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "mean"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                         lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0)))
    return packed.select("sample_id", filled.alias("profile"))


def array_median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def _peaks(prefix: str) -> dict[str, Column]:
    """Height of a profile's peak over its median, and the share of bins at least half as high."""
    base = array_median(F.col("profile"))
    contrast = F.array_max("profile") - base
    wide = F.size(F.filter("profile", lambda v: v >= base + 0.5 * contrast)) / F.size("profile").cast("double")
    return {f"{prefix}_peak_contrast": contrast,
            f"{prefix}_peak_width_ratio": F.when(contrast <= 1e-6, F.lit(0.0)).otherwise(wide)}


def profile_peaks(polar: DataFrame) -> DataFrame:
    """Ring-like radial peaks and scratch-like angular peaks of 24-bin profiles."""
    def peaks(position: str, prefix: str) -> DataFrame:
        return bin_profile(polar, position, 24).withColumns(_peaks(prefix)).drop("profile")
    return peaks("radius", "ring_radial").join(peaks("theta", "scratch_angular"), "sample_id")


def polar_cells(chip_rows: DataFrame, radial: int = 3, angular: int = 12) -> DataFrame:
    """Chip table averaged on a coarse polar grid; the radius is taken over the wafer's chips for all measures."""
    placed = with_chip_polar(chip_rows, "n_wafer").filter(F.col("n_wafer") > 0)
    tested = F.col("n_valid") > 0
    return (placed.groupBy("sample_id", bin_index(F.col("radius"), radial).alias("r"),
                           bin_index(F.col("theta"), angular).alias("a"))
            .agg(F.coalesce(F.avg(F.when(tested, F.col("value"))), F.lit(0.0)).alias("severity"),
                 ratio(F.count_if(tested & (F.col("value") > 0)), F.count_if(tested)).alias("fail_density"),
                 F.avg(F.col("n_stby") / F.col("n_wafer")).alias("stby")))


def polar_features(chip_rows: DataFrame, radial: int = 3, angular: int = 12) -> DataFrame:
    cells = polar_cells(chip_rows, radial, angular).groupBy("sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct(
            (F.col("r") * angular + F.col("a")).cast("int"),
            F.struct("severity", "fail_density", "stby")))).alias("m"))
    out = ["sample_id"]
    for r in range(radial):
        for a in range(angular):
            cell, name = f"element_at(m, {r * angular + a})", f"polar_r{r:02d}_a{a:02d}"
            out += [f"coalesce({cell}.severity, 0.0D) AS {name}_severity",
                    f"coalesce({cell}.fail_density, 0.0D) AS {name}_fail_density",
                    f"coalesce({cell}.stby, 0.0D) AS stby_{name}_ratio"]
    return cells.selectExpr(*out)


def _tested(chip_rows: DataFrame) -> DataFrame:
    return chip_rows.filter(F.col("n_valid") > 0)


def local_hotspots(chip_rows: DataFrame) -> DataFrame:
    tested = _tested(chip_rows)
    stats = tested.groupBy("sample_id").agg(
        F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_pop("value").alias("sd"),
        F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("sample_id").orderBy(F.col("value").desc(), "chip_row", "chip_col")
    ranked = tested.withColumn("place", F.row_number().over(order)).join(stats, "sample_id")
    top = F.col("place") <= 3
    packed = ranked.groupBy("sample_id", "grid_rows", "grid_cols").agg(
        (F.max("value") - F.max("median")).alias("local_hotspot_peak_contrast"),
        (F.avg(F.when(top, F.col("value"))) - F.max("median")).alias("local_hotspot_top3_mean_contrast"),
        F.collect_list(F.when(top, F.struct(F.col("chip_row").alias("r"), F.col("chip_col").alias("c")))).alias("p"),
        ratio(F.count_if(F.col("value") > F.col("median") + 2.0 * F.col("sd")), F.max("n"))
        .alias("local_hotspot_count_ratio"))
    spread = cmp.array_mean(cmp.pair_distances(F.col("p"))) / cmp.grid_diagonal()
    return packed.select("sample_id", "local_hotspot_peak_contrast", "local_hotspot_top3_mean_contrast",
                         spread.alias("local_hotspot_top3_spread"), "local_hotspot_count_ratio")


def component_features(chip_rows: DataFrame) -> DataFrame:
    """Blobs and lines among the hot chips of each wafer."""
    stats = cmp.region_stats(cmp.hot_chip_regions(with_chip_polar(chip_rows, "n_valid")))
    by_mean = Window.partitionBy("sample_id").orderBy(F.round("mean_value", 9).desc(), "region")
    by_line = Window.partitionBy("sample_id").orderBy(F.round("linear_score", 9).desc(), "region")
    ranked = stats.withColumns({"mean_place": F.row_number().over(by_mean), "line_place": F.row_number().over(by_line)})
    top, line = F.col("mean_place") <= 3, F.col("line_place") == 1
    point = F.struct(F.col("mean_place").alias("k"), F.col("centroid_row").alias("r"), F.col("centroid_col").alias("c"))

    def of_line(name: str) -> Column:
        return F.max(F.when(line, F.col(name)))

    packed = ranked.groupBy("sample_id", "grid_rows", "grid_cols").agg(
        ratio(F.sum("size"), F.max("n_tested")).alias("morph_hot_chip_ratio"),
        ratio(F.count(F.lit(1)), F.max("n_tested")).alias("morph_component_count_ratio"),
        ratio(F.max("size"), F.max("n_tested")).alias("local_component_largest_ratio"),
        F.avg(F.when(top, F.col("compactness"))).alias("local_component_compactness"),
        F.array_sort(F.collect_list(F.when(top, point))).alias("p"),
        of_line("elongation").alias("scratch_component_elongation"),
        of_line("linear_score").alias("scratch_component_linear_score"),
        of_line("radial_span").alias("scratch_component_radial_span"),
        of_line("angular_span").alias("scratch_component_angular_span"))
    whole = F.transform("p", lambda s: F.struct(s["r"].cast("int").alias("r"), s["c"].cast("int").alias("c")))
    spread = cmp.array_mean(cmp.pair_distances(whole)) / cmp.grid_diagonal()
    return (packed.withColumn("local_component_top3_spread", spread)
            .withColumn("local_component_triangle_score", cmp.triangle_score(F.col("p")))
            .drop("p", "grid_rows", "grid_cols"))


def edge_localized(chip_rows: DataFrame, angular: int = 12) -> DataFrame:
    tested = _tested(with_chip_polar(chip_rows, "n_valid"))
    edge, center = F.col("radius") >= 0.78, F.col("radius") < 0.55
    whole = tested.groupBy("sample_id").agg(
        F.max(F.when(edge, F.col("value"))).alias("peak"), F.avg(F.when(center, F.col("value"))).alias("center_mean"),
        F.percentile("value", F.lit(0.5)).alias("median"))
    sectors = (tested.filter(edge).groupBy("sample_id", bin_index(F.col("theta"), angular).alias("s"))
               .agg(F.avg("value").alias("v"))
               .groupBy("sample_id").agg(F.array_sort(F.collect_list("v")).alias("vs")))
    s = F.col("vs")
    n = F.size(s)
    mean = cmp.array_mean(s)
    med = array_median(s)
    sd = F.sqrt(F.aggregate(s, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / n)
    joined = whole.join(sectors, "sample_id", "left").withColumns({"med": med, "sd": sd})
    level = F.col("med") + F.col("sd")
    zero = F.lit(0.0)
    return joined.select(
        "sample_id",
        F.coalesce(F.col("peak") - F.coalesce("center_mean", "median"), zero).alias("edge_chip_peak_contrast"),
        F.coalesce(F.array_max("vs") - F.col("med"), zero).alias("edge_sector_peak_contrast"),
        F.coalesce(F.array_max("vs") / F.greatest(mean * n, F.lit(1e-6)), zero).alias("edge_sector_concentration"),
        F.coalesce(F.size(F.filter("vs", lambda v: v > level)) / n.cast("double"), zero)
        .alias("edge_localized_sector_ratio"))


# fixed values: shot layouts (chip rows, chip columns) and the anchors of a repeating exposure defect
SHOT_LAYOUTS = ((3, 3), (3, 2), (2, 3))
SHOT_ANCHORS = ("lower_left", "bottom_edge", "left_edge")


def anchor_weight(x: float, y: float, anchor: str) -> float:
    """Bell-shaped template over the shot-relative position."""
    def bell(v: float, mid: float, width: float) -> float:
        return math.exp(-0.5 * ((v - mid) / width) ** 2)
    # fixed values: centres and widths of the three templates
    if anchor == "lower_left":
        return math.exp(-0.5 * (((x - 0.18) / 0.16) ** 2 + ((y - 0.82) / 0.18) ** 2))
    if anchor == "bottom_edge":
        return bell(y, 0.92, 0.11) * (0.55 + 0.45 * bell(x, 0.42, 0.36))
    return bell(x, 0.08, 0.11) * (0.55 + 0.45 * bell(y, 0.58, 0.34))


def shot_weights(spark: SparkSession) -> DataFrame:
    """Weight of each slot of each layout, 63 rows."""
    rows = [(f"{R}x{C}", R, C, r, c, a, anchor_weight((c + 0.5) / C, (r + 0.5) / R, a))
            for R, C in SHOT_LAYOUTS for r in range(R) for c in range(C) for a in SHOT_ANCHORS]
    return spark.createDataFrame(rows, "layout string, shot_rows int, shot_cols int, slot_r int, slot_c int, "
                                       "anchor string, weight double")


def shot_phases(spark: SparkSession) -> DataFrame:
    """For each layout, offset and anchor: which chip residues (mod 6) count as high or low."""
    w = shot_weights(spark)
    best = Window.partitionBy("layout", "anchor")
    slots = w.withColumn("peak", F.max("weight").over(best)).select(
        "*", (F.col("weight") >= F.greatest(F.col("peak") * 0.38, F.lit(0.06))).alias("high"),
        (F.col("weight") < F.greatest(F.col("peak") * 0.22, F.lit(0.03))).alias("low"))
    six = F.sequence(F.lit(0), F.lit(5))
    return (
        slots.select("*", F.explode(six).alias("m_row")).select("*", F.explode(six).alias("m_col"))
        # the offset that puts chip residue m into this slot
        .withColumn("row_offset", F.pmod(F.col("m_row") - F.col("slot_r"), F.col("shot_rows")))
        .withColumn("col_offset", F.pmod(F.col("m_col") - F.col("slot_c"), F.col("shot_cols")))
        .filter("high or low")
        .select("layout", "row_offset", "col_offset", "anchor", "m_row", "m_col", "high", "low"))


def shot_contrasts(chip_rows: DataFrame) -> DataFrame:
    """Best high-minus-low contrast over all layouts and offsets, per anchor.

    Every layout repeats within six rows and columns, so the chips are first summed per residue: 36 rows per wafer meet
    the fixed phase table.
    """
    residue = (_tested(chip_rows)
               .groupBy("sample_id", (F.col("chip_row") % 6).alias("m_row"), (F.col("chip_col") % 6).alias("m_col"))
               .agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")))
    phases = F.broadcast(shot_phases(chip_rows.sparkSession))
    high, low = F.col("high"), F.col("low")
    contrast = (
        residue.join(phases, ["m_row", "m_col"])
        .groupBy("sample_id", "layout", "row_offset", "col_offset", "anchor")
        .agg((F.sum(F.when(high, F.col("s"))) / F.sum(F.when(high, F.col("n")))
              - F.sum(F.when(low, F.col("s"))) / F.sum(F.when(low, F.col("n")))).alias("contrast")))
    best = [F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("anchor") == a, F.col("contrast"))), F.lit(0.0)))
            .alias(f"shot_{a}_contrast") for a in SHOT_ANCHORS]
    return (contrast.groupBy("sample_id").agg(*best)
            .withColumn("shot_best_contrast", F.greatest(*[f"shot_{a}_contrast" for a in SHOT_ANCHORS])))


def mask_ratios(pixels: DataFrame, classes: tuple[str, ...], clipped: bool = False) -> DataFrame:
    """Class pixels over wafer pixels; ``clipped`` counts class pixels inside the wafer only."""
    wafer = F.col("in_wafer") == 1
    return pixels.groupBy("sample_id").agg(*[
        ratio(F.count_if((F.col(c) > 0) & wafer if clipped else F.col(c) > 0), F.count_if(wafer))
        .alias(f"{c}_mask_ratio") for c in classes])


def class_labels(pixels: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """One 0/1 column per class: does any pixel of the wafer carry it."""
    return pixels.groupBy("sample_id").agg(*[F.max((F.col(c) > 0).cast("int")).alias(f"label_{c}") for c in classes])


# one pass over the pixels: every pixel counts once in each of these groupings of its wafer
PROFILE_COUNTS = ("n_px", "n_wafer", "n_valid", "n_stby", "n_fail", "sev_sum")


def wafer_profile(polar: DataFrame, geo: Geometry) -> DataFrame:
    """Counts per chip, radial zone, angular sector and fine profile bin, from one pass and one shuffle.

    A wafer shrinks from its millions of pixels to some hundred rows before it moves. Staged by wafer, what follows
    groups and joins by wafer without another shuffle.
    """
    bins = {"zone": bin_index(F.col("radius"), 5), "sector": bin_index(F.col("theta"), 12),
            "radius_bin": bin_index(F.col("radius"), 24), "theta_bin": bin_index(F.col("theta"), 24)}
    valid, wafer = _valid(), F.col("in_wafer") == 1
    size = {"height": F.col("height"), "width": F.col("width"), "chip_h": geo.col("chip_h"),
            "chip_w": geo.col("chip_w"), "grid_rows": geo.col("rows"), "grid_cols": geo.col("cols")}
    whole, chip = ["sample_id", *size], ["chip_row", "chip_col"]
    counted = (
        polar.select("sample_id", *[c.alias(n) for n, c in size.items()], *chip, *[c.alias(n) for n, c in bins.items()],
                     "valid", "in_wafer", "stby", "severity")
        .groupingSets([[*whole, *chip], *[[*whole, b] for b in bins]], *whole, *chip, *bins)
        .agg(F.count(F.lit(1)).alias("n_px"), F.count_if(wafer).alias("n_wafer"), F.count_if(valid).alias("n_valid"),
             F.count_if(wafer & (F.col("stby") == 1)).alias("n_stby"), F.count_if(_fails()).alias("n_fail"),
             F.sum(F.when(valid, F.col("severity")).otherwise(0)).alias("sev_sum"),
             *[F.grouping(c).alias(f"_no_{c}") for c in ("chip_row", *bins)]))

    def by_family(of_chip: Column, of_bin) -> Column:
        out = F.when(F.col("_no_chip_row") == 0, of_chip)
        for b in bins:
            out = out.when(F.col(f"_no_{b}") == 0, of_bin(b))
        return out

    return counted.select(
        *whole, by_family(F.lit("chip"), lambda b: F.lit(b.removesuffix("_bin"))).alias("family"),
        by_family(F.col("chip_row"), F.col).alias("a"), by_family(F.col("chip_col"), lambda b: F.lit(0)).alias("b"),
        "n_px", "n_wafer", "n_valid", "n_stby", "n_fail", "sev_sum")


def profile_chips(profile: DataFrame) -> DataFrame:
    """The chip table of a wafer profile, with the columns of ``geometry.chips``."""
    return profile.filter(F.col("family") == "chip").select(
        "sample_id", F.col("a").alias("chip_row"), F.col("b").alias("chip_col"),
        (F.col("chip_w") * (2 * F.col("b") + 1) - (F.col("width") - 1)).cast("int").alias("dx2"),
        (F.col("chip_h") * (2 * F.col("a") + 1) - (F.col("height") - 1)).cast("int").alias("dy2"),
        "grid_rows", "grid_cols", *PROFILE_COUNTS,
        F.when(F.col("n_valid") > 0, F.col("sev_sum") / (F.lit(7.0) * F.col("n_valid"))).otherwise(F.lit(0.0))
        .alias("value"),
    ).withColumn("d2", (F.col("dx2") * F.col("dx2") + F.col("dy2") * F.col("dy2")).cast("int"))


def profile_families(profile: DataFrame) -> DataFrame:
    """Densities, zones, sectors, edge rates and profile peaks of a wafer profile, one aggregate."""
    def total(name: str, family: str, a: int | None = None) -> Column:
        hit = F.col("family") == family
        return F.sum(F.when(hit if a is None else hit & (F.col("a") == a), F.col(name)).otherwise(0))

    def grade_mean(family: str, a: int | None = None) -> Column:
        return total("sev_sum", family, a).cast("double") / (
            F.greatest(total("n_valid", family, a), F.lit(1)) * F.lit(7.0))

    def rate(zone: int) -> Column:
        return ratio(total("n_fail", "zone", zone), total("n_valid", "zone", zone))

    def means(family: str) -> Column:
        entry = F.struct("a", (F.col("sev_sum").cast("double") / (F.lit(7.0) * F.col("n_valid"))).alias("m"))
        return F.map_from_entries(F.collect_list(F.when((F.col("family") == family) & (F.col("n_valid") > 0), entry)))

    wide = profile.groupBy("sample_id").agg(
        ratio(total("n_fail", "chip"), total("n_valid", "chip")).alias("total_fail_density"),
        grade_mean("chip").alias("grade_weighted_severity"),
        ratio(total("n_stby", "chip"), total("n_wafer", "chip")).alias("stby_ratio"),
        *[grade_mean("zone", i).alias(n) for i, n in enumerate(_zone_names(5))],
        *[grade_mean("sector", i).alias(n) for i, n in enumerate(_sector_names(12))],
        rate(4).alias("edge_density"), rate(0).alias("center_density"),
        (rate(4) - rate(0)).alias("edge_minus_center_density"),
        means("radius").alias("m_radius"), means("theta").alias("m_theta"))
    for family, prefix in (("radius", "ring_radial"), ("theta", "scratch_angular")):
        found = F.col(f"m_{family}")
        filled = F.transform(F.sequence(F.lit(0), F.lit(23)), _value_or_zero(found))
        wide = wide.withColumn("profile", filled).withColumns(_peaks(prefix)).drop("profile", f"m_{family}")
    return wide


def _value_or_zero(found: Column):
    return lambda i: F.coalesce(F.element_at(found, i), F.lit(0.0))


def compact_features(pixels: DataFrame, geo: Geometry) -> DataFrame:
    """The fifty compact features, one row per wafer."""
    return _assemble(pixels, geo, location_aware=False)


def all_features(pixels: DataFrame, geo: Geometry) -> DataFrame:
    """Compact and location-aware features, one row per wafer."""
    return _assemble(pixels, geo, location_aware=True)


def _assemble(pixels: DataFrame, geo: Geometry, location_aware: bool) -> DataFrame:
    polar = with_polar(pixels)
    profile = stage_by(wafer_profile(polar, geo), "sample_id")
    chip_rows = profile_chips(profile)
    families = [profile_families(profile), edge_face_rates(polar, geo)]
    if location_aware:
        families.append(polar_features(chip_rows))
    families += [local_hotspots(chip_rows), component_features(chip_rows), edge_localized(chip_rows),
                 shot_contrasts(chip_rows)]
    out = families[0]
    for f in families[1:]:
        out = out.join(f, "sample_id", "left")
    return out.selectExpr("sample_id", *[f"coalesce({c}, 0.0D) AS {c}" for c in out.columns if c != "sample_id"])
