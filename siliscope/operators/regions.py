"""Defect regions of labelled or predicted class masks: where they sit, how large they are, how classes overlap."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.functions import columns as fc
from siliscope.operators.geometry import pixel_dx, pixel_dy
from siliscope.operators.ordering import exact_quantiles

MIN_RATIO = 1e-5


def class_pixels(pixels: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """One row per in-wafer pixel and class it carries."""
    named = F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in classes])
    return (pixels.filter(F.col("in_wafer") == 1)
            .withColumn("class_name", F.explode(F.array_compact(named))))


def region_rows(pixels: DataFrame, classes: tuple[str, ...] = C.REPORT_CLASSES, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per wafer and class present: size, clock position, radial zone, sector concentration, hidden share.

    Class pixels are counted per twelfth of the circle before they move, so a region travels as at most twelve rows.
    """
    wafers = pixels.groupBy("sample_id").agg(F.count_if(F.col("in_wafer") == 1).alias("n_wafer"),
                                             F.max("wafer_extent").alias("extent"))
    sectors = (class_pixels(pixels, classes)
               .groupBy("sample_id", "class_name", fc.sector12(pixel_dx(), pixel_dy()).alias("sector"))
               .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stby")).alias("n_stby"),
                    F.sum(2 * F.col("x") - (F.col("width") - 1)).alias("sx"),
                    F.sum(2 * F.col("y") - (F.col("height") - 1)).alias("sy"),
                    F.sum(F.sqrt(F.col("d2").cast("double"))).alias("sd")))
    regions = sectors.groupBy("sample_id", "class_name").agg(
        F.sum("n").alias("n"), F.sum("n_stby").alias("n_stby"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"),
        F.sum("sd").alias("sd"),
        F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("n", "sector")))), 1, 3).alias("top"))
    n = F.col("n").cast("double")
    radius = F.col("sd") / n / F.greatest(F.sqrt(F.col("extent").cast("double")), F.lit(2.0))
    placed = regions.join(wafers, "sample_id").select(
        "sample_id", "class_name", fc.ratio(F.col("n"), F.col("n_wafer")).alias("pixel_ratio"),
        fc.clock_position(F.col("sx") / (2 * n), F.col("sy") / (2 * n)).alias("centroid_clock"),
        F.transform("top", lambda t: fc.hour_label(t["sector"])).alias("top_clock_positions"),
        (F.col("top")[0]["n"] / n).alias("top_sector_share"), radius.alias("radius"),
        F.when(F.col("class_name") == "stby_pattern", F.lit(1.0)).otherwise(F.col("n_stby") / n)
        .alias("stby_overlap_ratio"),
    ).filter(F.col("pixel_ratio") >= min_ratio)
    cls = F.col("class_name")
    label = fc.location_label(cls, F.col("top_clock_positions")[0], F.col("centroid_clock"), F.col("top_sector_share"),
                              F.col("radius"))
    named = (placed.withColumn("radial_zone", fc.radial_zone(F.col("radius"))).withColumn("location_label", label)
             .withColumn("feature_key", fc.feature_key(cls, F.col("location_label"), F.col("radial_zone"))))
    return named


def in_report_order(regions: DataFrame) -> DataFrame:
    """Number each wafer's regions by class priority, then size; hidden scratches count up to double."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in C.CLASS_PRIORITY.items() for v in p]),
                                   F.col("class_name")), F.lit(9))
    weight = F.when(F.col("class_name") == "scratch", 1.0 + F.col("stby_overlap_ratio")).otherwise(F.lit(1.0))
    order = Window.partitionBy("sample_id").orderBy(rank, (-F.col("pixel_ratio") * weight), "class_name")
    return regions.withColumn("position", F.row_number().over(order))


def region_metrics(regions: DataFrame, sample_count: Column) -> DataFrame:
    """Presence, mean size and hidden share per class, with the exact 95th percentile of the hidden share."""
    base = regions.groupBy("class_name").agg(
        F.countDistinct("sample_id").alias("sample_count"), F.avg("pixel_ratio").alias("mean_pixel_ratio"),
        F.avg("stby_overlap_ratio").alias("mean_stby_overlap"))
    p95 = exact_quantiles(regions, ["class_name"], "stby_overlap_ratio", {"p95_stby_overlap": 0.95})
    return (base.join(p95, "class_name", "left")
            .withColumn("presence_rate", F.col("sample_count") / F.greatest(sample_count, F.lit(1))))


def class_ratio_rows(pixels: DataFrame, classes: tuple[str, ...] = C.PATTERN_CLASSES) -> DataFrame:
    """(sample, class, ratio) of class pixels inside the wafer, zero rows included."""
    wafer = F.col("in_wafer") == 1
    sums = pixels.groupBy("sample_id").agg(F.count_if(wafer).alias("n"), *[
        F.count_if(wafer & (F.col(c) > 0)).alias(c) for c in classes])
    return sums.select("sample_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("class_name"), fc.ratio(F.col(c), F.col("n")).alias("ratio")) for c in classes]))
        .alias("x")).select("sample_id", "x.*")


def class_balance(ratios: DataFrame) -> DataFrame:
    """Positives, presence, mean ratio, median and 95th percentile of the positives, capped loss weight per class."""
    base = ratios.groupBy("class_name").agg(
        F.count_if(F.col("ratio") > 0).alias("positive_samples"), F.count(F.lit(1)).alias("n"),
        F.avg("ratio").alias("mean_pixel_ratio"))
    q = exact_quantiles(ratios.filter("ratio > 0"), ["class_name"], "ratio",
                        {"median_positive_ratio": 0.5, "p95_positive_ratio": 0.95})
    mean = F.col("mean_pixel_ratio")
    return base.join(q, "class_name", "left").select(
        "class_name", "positive_samples", (F.col("positive_samples") / F.col("n")).alias("sample_presence_rate"),
        "mean_pixel_ratio", F.coalesce("median_positive_ratio", F.lit(0.0)).alias("median_positive_ratio"),
        F.coalesce("p95_positive_ratio", F.lit(0.0)).alias("p95_positive_ratio"),
        F.least((1.0 - mean) / F.greatest(mean, F.lit(1e-9)), F.lit(50.0)).alias("suggested_pos_weight_capped"))


def class_combinations(pixels: DataFrame, classes: tuple[str, ...], stride: int) -> DataFrame:
    """In-wafer pixels per wafer and class combination, all of them and those on every ``stride``-th row and column."""
    bits = fc.label_signature([(F.col(c) > 0).cast("int") for c in classes])
    on_grid = (F.col("y") % stride == 0) & (F.col("x") % stride == 0)
    return (pixels.filter(F.col("in_wafer") == 1).groupBy("sample_id", bits.alias("bits"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(on_grid).alias("n_grid")))


def pair_overlap(combos: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Co-occurrence rate and mean overlap of every class pair; wafers move as their few class combinations."""
    aggs, out = [F.sum("n_grid").alias("grid")], []
    for i, j in combinations(range(len(classes)), 2):
        both = (1 << i) | (1 << j)
        hit = F.col("bits").bitwiseAND(F.lit(both).cast("long")) == both
        aggs.append(F.coalesce(F.sum(F.when(hit, F.col("n_grid"))), F.lit(0)).alias(f"o_{i}_{j}"))
        out.append(F.struct(F.lit(f"{classes[i]}+{classes[j]}").alias("pair"),
                            (F.col(f"a_{i}") * F.col(f"a_{j}")).alias("both"),
                            fc.ratio(F.col(f"o_{i}_{j}"), F.col("grid")).alias("overlap")))
    present = [F.max(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) > 0).cast("int").alias(f"a_{i}")
               for i in range(len(classes))]
    rows = combos.groupBy("sample_id").agg(*aggs, *present).select(F.explode(F.array(*out)).alias("p")).select("p.*")
    return rows.groupBy("pair").agg(F.avg("both").alias("cooccurrence_rate"),
                                    F.avg("overlap").alias("mean_overlap_pixel_ratio"))


def scratch_risk(pixels: DataFrame) -> DataFrame:
    """Among wafers with a scratch: how often other classes occur, and how much of the scratch untested chips hide."""
    wafer = F.col("in_wafer") == 1
    per = pixels.groupBy("sample_id").agg(
        F.count_if(wafer & (F.col("scratch") > 0)).alias("scratch"),
        *[F.max((wafer & (F.col(c) > 0)).cast("int")).alias(c) for c in ("ring", "local", "stby_pattern")],
        F.count_if(wafer & (F.col("scratch") > 0) & (F.col("stby_pattern") > 0)).alias("hidden")
    ).filter("scratch > 0").withColumn("share", F.col("hidden") / F.col("scratch"))
    base = per.agg(F.count(F.lit(1)).alias("scratch_positive_samples"),
                   *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"scratch_{n}_cooccurrence_rate")
                     for c, n in (("ring", "ring"), ("local", "local"), ("stby_pattern", "stby"))],
                   F.coalesce(F.avg("share"), F.lit(0.0)).alias("scratch_pixels_hidden_by_stby_mean"))
    p95 = exact_quantiles(per.withColumn("g", F.lit(1)), ["g"], "share", {"p95": 0.95}).select("p95")
    return base.withColumn("scratch_pixels_hidden_by_stby_p95", F.coalesce(p95.scalar(), F.lit(0.0)))


def grade_histogram(pixels: DataFrame) -> DataFrame:
    valid = F.col("valid") == 1
    return pixels.groupBy("sample_id").agg(*[
        F.count_if(valid & (F.col("severity") == g)).alias(f"grade_{g}") for g in range(C.MAX_GRADE + 1)])


def sample_realism(polar: DataFrame, chip_area: Column) -> DataFrame:
    """Per wafer: share of good pixels, centre and edge means and fail rates, untested area in chips."""
    valid = F.col("valid") == 1
    radius = F.sqrt(F.col("d2").cast("double")) / F.greatest(F.sqrt(F.col("wafer_extent").cast("double")), F.lit(2.0))
    rows = polar.withColumn("zone", F.when(~valid, None).when(radius < 0.55, "center").when(radius > 0.78, "edge"))

    def zone(name: str, value: Column) -> Column:
        return fc.ratio(F.sum(F.when(F.col("zone") == name, value).otherwise(0)), F.count_if(F.col("zone") == name))

    fail = (F.col("severity") > 0).cast("int")
    return rows.groupBy("sample_id").agg(
        fc.ratio(F.count_if(valid & (F.col("severity") == 0)), F.count_if(valid)).alias("grade0_ratio"),
        zone("center", F.col("severity")).alias("center_mean_grade"), zone("edge", F.col("severity")).alias("edge_mean_grade"),
        zone("center", fail).alias("center_fail_density"), zone("edge", fail).alias("edge_fail_density"),
        F.sum("stby").alias("stby_pixels"), (F.sum("stby") / chip_area).alias("stby_chips_est"))


def batch_realism(samples: DataFrame) -> DataFrame:
    """The batch on one row; ``face_difference`` is the outer-minus-inner rate of edge chips."""
    lift = F.col("edge_fail_density") - F.col("center_fail_density")
    majority = F.ceil(F.count(F.lit(1)) * 0.6)
    return samples.agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("grade0_ratio").alias("grade0_ratio_mean"),
        F.min("grade0_ratio").alias("grade0_ratio_min"), F.max("grade0_ratio").alias("grade0_ratio_max"),
        F.avg(lift).alias("edge_minus_center_fail_density_mean"), F.count_if(lift > 0).alias("edge_higher_count"),
        F.avg("face_difference").alias("face_difference_mean"),
        F.count_if(F.col("face_difference") > 0).alias("face_higher_count"),
        (F.min("grade0_ratio") > 0).alias("grade0_present_all_samples"),
        (F.count_if(lift > 0) >= majority).alias("edge_higher_majority"),
        (F.count_if(F.col("face_difference") > 0) >= majority).alias("face_higher_majority"),
        (F.min("stby_pixels") > 0).alias("stby_present_all_samples"))


def pattern_modes(patterns: DataFrame) -> DataFrame:
    """Count patterns by type and mode; ``patterns`` is an array of (type, parameters)."""
    return (patterns.select(F.explode("patterns").alias("p"))
            .groupBy(F.col("p.type").alias("type"), F.col("p.parameters")["mode"].alias("mode"))
            .agg(F.count(F.lit(1)).alias("n")))


def pattern_label(ptype: Column, params: Column) -> Column:
    """Short display name of a pattern instance."""
    mode = F.coalesce(params["mode"], F.lit(""))
    seeded = F.coalesce(params["seeded_stby_chip_count"].cast("int"), F.lit(0))
    latent = F.coalesce(params["latent_weighted_stby_chip_count_est"].cast("int"), F.lit(0))
    anchor = F.coalesce(params["anchor_region"], F.lit(""))
    stby = (F.when(params["seeded_stby_chip_count"].isNull() & mode.startswith("origin_coupled"), "stby:origin-unverified")
            .when((seeded > 0) & (latent > 0), "stby:origin+latent").when(seeded > 0, "stby:origin")
            .when((latent > 0) | mode.startswith("latent_weighted"), "stby:latent").otherwise("stby"))
    local = (F.when(mode == "single_blob", "local:single").when(mode == "double_blob", "local:double")
             .when(mode == "triple_triangle", "local:tri").otherwise("local"))
    shot = F.when(anchor == "", "shot").otherwise(F.concat(F.lit("shot:"), F.replace(anchor, F.lit("lower_left"), F.lit("LL"))))
    return (F.when(ptype == "stby_pattern", stby).when(ptype == "local", local).when(ptype == "shot_grid", shot)
            .when(ptype.isin("scratch", "ring") & (mode != ""), F.concat_ws(":", ptype, mode)).otherwise(ptype))


def active_labels(flags: dict[str, Column]) -> Column:
    """Names of the set labels, or "background"."""
    names = F.array_compact(F.array(*[F.when(v == 1, F.lit(n)) for n, v in flags.items()]))
    return F.when(F.size(names) == 0, "background").otherwise(F.array_join(names, ", "))


def stable_split(sample_id: Column, fraction: float, seed: int) -> Column:
    """Train or val from the digest of the id, the same on every run and machine."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), sample_id), 256)
    score = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
    return F.when(score < fraction, "val").otherwise("train")


def segmentation_manifest(pixels: DataFrame, fraction: float, seed: int,
                          classes: tuple[str, ...] = C.PATTERN_CLASSES) -> DataFrame:
    wafer = F.col("in_wafer") == 1
    ratios = pixels.groupBy("sample_id").agg(*[
        fc.ratio(F.count_if(wafer & (F.col(c) > 0)), F.count_if(wafer)).alias(f"{c}_mask_ratio") for c in classes])
    has = [(F.col(f"{c}_mask_ratio") > 0).cast("int") for c in classes]
    active = has[0]
    for h in has[1:]:
        active = active + h
    return ratios.select("*", stable_split(F.col("sample_id"), fraction, seed).alias("split"),
                         *[h.alias(f"has_{c}") for c, h in zip(classes, has)], active.alias("active_target_count"))
