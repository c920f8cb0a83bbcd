"""Rule checks on wafers, manifests and geometry: every rule is one conditional count of a single aggregate."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siliscope import constants as C


def _messages(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(broken, F.lit(text)) for text, broken in rules.items()]))


def _any(cond: Column) -> Column:
    return F.coalesce(F.max(cond.cast("int")), F.lit(0)) > 0


def _not_binary(name: str) -> Column:
    return _any(~F.col(name).isin(0, 1))


def _missing(name: str) -> Column:
    """The array does not cover the wafer: a pixel of the severity array has no value in it."""
    return _any(F.col(name).isNull())


def _mask_rules() -> dict[str, Column]:
    out, stby, sev = F.col("in_wafer") == 0, F.col("stby") > 0, F.col("severity")
    return {
        "severity outside wafer_mask must be 0": _any(out & (sev != 0)),
        "stby pixels must be inside wafer_mask": _any(out & (F.col("stby") != 0)),
        "stby pixels must have severity 0": _any(stby & (sev != 0)),
        "stby pixels must be invalid test pixels": _any(stby & (F.col("valid") != 0)),
        "pixels outside wafer must be invalid": _any(out & (F.col("valid") != 0)),
        "chip_index outside wafer_mask must be -1": _any(out & (F.col("chip_id") != -1)),
    }


def labelled_sample_errors(pixels: DataFrame, classes: tuple[str, ...] = C.PATTERN_CLASSES) -> DataFrame:
    """(sample, errors) of labelled wafers."""
    masks = ("in_wafer", "valid", "stby")
    rules = {f"{n} shape does not match severity": _missing(n) for n in (*masks, "chip_id")}
    rules["pattern_masks shape does not match severity"] = _any(F.greatest(*[F.col(c).isNull() for c in classes]))
    rules |= {f"{n} must be binary": _not_binary(n) for n in masks}
    rules["pattern_masks must be binary"] = _any(F.greatest(*[~F.col(c).isin(0, 1) for c in classes]))
    rules["severity must be in grade range 0..7"] = _any(~F.col("severity").between(0, C.MAX_GRADE))
    rules["image_shape must match severity shape"] = (
        (F.max("y") + 1 != F.max("height")) | (F.max("x") + 1 != F.max("width"))
        | (F.count(F.lit(1)) != F.max("height") * F.max("width")))
    rules |= _mask_rules()
    return pixels.groupBy("sample_id").agg(_messages(rules).alias("errors"))


def pattern_type_errors(patterns: DataFrame) -> DataFrame:
    """Pattern entries whose type is not a registered class."""
    return (patterns.select("sample_id", F.explode("patterns").alias("p")).select("sample_id", F.col("p.type").alias("type"))
            .filter(~F.col("type").isin(*C.PATTERN_CLASSES)))


def class_list_errors(meta: DataFrame) -> DataFrame:
    """Wafers whose metadata lists other classes, or the same in another order."""
    expected = F.array(*[F.lit(c) for c in C.PATTERN_CLASSES])
    return meta.filter(~F.col("pattern_classes").eqNullSafe(expected)).select("sample_id")


def sample_sanity(pixels: DataFrame, geo) -> DataFrame:
    """Errors, warnings and size figures of unlabelled wafers, one pass.

    The number of dies is counted from the pixels by chip first, so the distinct count never sees single pixels.
    """
    chip_area = geo.col("chip_w") * geo.col("chip_h")
    net_die = geo.col("net_die")
    valid = F.col("valid") > 0
    masks = ("in_wafer", "valid", "stby")
    stby_area = F.count_if(F.col("stby") > 0)
    dies = F.size(F.collect_set(F.when(F.col("chip_id") >= 0, F.col("chip_id"))))
    errors = {f"{n} shape does not match severity": _missing(n) for n in (*masks, "chip_id")}
    errors["severity contains NaN or inf"] = _any(F.col("severity").isNull() | F.isnan(F.col("severity").cast("double")))
    errors["severity must be in grade range 0..7"] = _any(~F.col("severity").between(0, C.MAX_GRADE))
    errors |= {f"{n} must be binary": _not_binary(n) for n in masks}
    errors["severity on invalid-test pixels must be 0"] = _any((F.col("valid") == 0) & (F.col("severity") != 0))
    errors |= _mask_rules()
    errors["chip_index inside wafer_mask must be non-negative"] = _any((F.col("in_wafer") > 0) & (F.col("chip_id") < 0))
    errors["net die does not match chip_index die count"] = (net_die > 0) & (dies != net_die)
    errors["sample has no valid tested pixels"] = F.count_if(valid) == 0
    errors["sample has no wafer pixels"] = F.count_if(F.col("in_wafer") > 0) == 0
    strategy = F.max("mask_strategy") if "mask_strategy" in pixels.columns else F.lit("")
    warnings = {
        "grid and chip_blocks do not match the severity shape":
            (geo.col("rows") * geo.col("chip_h") != F.max("height")) | (geo.col("cols") * geo.col("chip_w") != F.max("width")),
        "stby area is not a multiple of chip area": (stby_area > 0) & (stby_area % chip_area != 0),
        "sample has no stby pixels": stby_area == 0,
        "sample has no measured grade 0 pixels": F.count_if(valid & (F.col("severity") == 0)) == 0,
        "wafer mask is the full grid": strategy == "full_grid_from_png",
        "wafer mask is an inferred ellipse": strategy == "centered_ellipse_from_png",
    }
    return pixels.groupBy("sample_id").agg(
        _messages(errors).alias("errors"), _messages(warnings).alias("warnings"),
        F.max("height").alias("height"), F.max("width").alias("width"),
        F.count_if(valid).alias("valid_pixel_count"), stby_area.alias("stby_pixel_count"),
        dies.alias("chip_index_die_count"), (stby_area / F.greatest(chip_area, F.lit(1))).alias("stby_chip_count_est"),
        F.min("severity").alias("grade_min"), F.max("severity").alias("grade_max"))


def passing(sanity: DataFrame) -> DataFrame:
    return sanity.filter(F.size("errors") == 0).select("sample_id")


def full_gray_chips(pixels: DataFrame, gray: str = "gray") -> DataFrame:
    """Chips whose whole block has the code of an untested chip."""
    return (pixels.groupBy("sample_id", "chip_row", "chip_col")
            .agg(F.min(gray).alias("lo"), F.max(gray).alias("hi"))
            .select("sample_id", "chip_row", "chip_col",
                    ((F.col("lo") == C.STBY_GRAY) & (F.col("hi") == C.STBY_GRAY)).cast("int").alias("stby")))


def unknown_grays(pixels: DataFrame, gray: str = "gray") -> DataFrame:
    """Codes outside the eight, per wafer."""
    return (pixels.filter(~F.col(gray).isin(*C.GRADE_GRAYS)).groupBy("sample_id")
            .agg(F.array_sort(F.collect_set(gray)).alias("unknown_values")))


# fixed values: fields each source type needs
REQUIRED_FIELDS = {
    C.SOURCE_NPZ: ("arrays_npz", "chip_blocks", "grid", "parser_name", "parser_version", "orientation"),
    C.SOURCE_PNG: ("png_path", "parser_name", "parser_version", "orientation"),
    C.SOURCE_DIR: ("sample_dir",),
}


def manifest_errors(samples: DataFrame) -> DataFrame:
    """(sample index, id, errors) of exploded manifest entries; header versions come along as columns."""
    src, sid = F.col("source_type"), F.coalesce("sample_id", F.lit(""))
    real = src.isin(C.SOURCE_NPZ, C.SOURCE_PNG)
    repeated = (samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
                .withColumnRenamed("sample_id", "repeated_id"))
    rules = {
        "unsupported schema_version": ~F.col("schema_version").eqNullSafe(C.MANIFEST_VERSION),
        "unsupported feature_schema_version": ~F.col("feature_schema_version").eqNullSafe(C.FEATURE_VERSION),
        "missing source_type": src.isNull(),
        "unsupported source_type": src.isNotNull() & ~src.isin(*REQUIRED_FIELDS),
        "sample_id has other than letters, numbers and ._-": ~sid.rlike(C.SAMPLE_ID_PATTERN),
        "duplicate sample_id": F.col("repeated_id").isNotNull(),
        "sample_id is not opaque": real & ~sid.rlike(C.OPAQUE_ID_PATTERN),
        "not pseudonymized": real & ~F.coalesce("pseudonymized", F.lit(False)),
        "geometry missing": (src == C.SOURCE_PNG) & (F.col("chip_blocks").isNull() | F.col("grid").isNull())
        & ~F.coalesce("allow_geometry_inference", F.lit(False)),
    }
    for source, fields in REQUIRED_FIELDS.items():
        for f in fields:
            rules[f"{source} needs {f}"] = (src == source) & F.col(f).isNull()
    return (samples.join(repeated, F.col("sample_id") == F.col("repeated_id"), "left").withColumn("errors", _messages({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}))
            .select("sample_id", "source_type", "errors"))


def resolved_geometry(entries: DataFrame) -> DataFrame:
    """Chip size and grid of an entry from what it states, else by exact division of the image; with errors."""
    h, w = F.col("height"), F.col("width")
    cb, grid = F.col("chip_blocks"), F.col("grid")
    even = (grid["rows"] >= 1) & (grid["cols"] >= 1) & (h % grid["rows"] == 0) & (w % grid["cols"] == 0)
    chip_h = F.coalesce(cb["height"], F.when(even, F.floor(h / grid["rows"]).cast("int")))
    chip_w = F.coalesce(cb["width"], F.when(even, F.floor(w / grid["cols"]).cast("int")))
    sized = entries.withColumns({"chip_h": chip_h, "chip_w": chip_w})
    fits = (F.col("chip_h") >= 1) & (F.col("chip_w") >= 1) & (h % F.col("chip_h") == 0) & (w % F.col("chip_w") == 0)
    placed = sized.withColumns({
        "rows": F.coalesce(grid["rows"], F.when(fits, F.floor(h / F.col("chip_h")).cast("int"))),
        "cols": F.coalesce(grid["cols"], F.when(fits, F.floor(w / F.col("chip_w")).cast("int")))})
    rules = {
        "grid must evenly divide the image": cb.isNull() & grid.isNotNull() & ~F.coalesce(even, F.lit(False)),
        "chip_blocks or grid needed": cb.isNull() & grid.isNull(),
        "chip_blocks must be positive": (F.col("chip_h") < 1) | (F.col("chip_w") < 1),
        "chip_blocks must evenly divide the image": cb.isNotNull() & grid.isNull() & ~F.coalesce(fits, F.lit(False)),
        "geometry must exactly match the image": (F.col("rows") * F.col("chip_h") != h) | (F.col("cols") * F.col("chip_w") != w),
    }
    return placed.withColumn("errors", _messages({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}))


def geometry_rows(raw: DataFrame) -> DataFrame:
    """Explicit product geometry, checked: positive sizes, net die not negative and not above the grid."""
    cb, grid, die = F.col("chip_blocks"), F.col("grid"), F.col("actual_net_die")
    rules = {
        "chip_blocks and grid required": cb.isNull() | grid.isNull(),
        "chip_blocks must be positive": (cb["width"] < 1) | (cb["height"] < 1),
        "grid must be positive": (grid["rows"] < 1) | (grid["cols"] < 1),
        "net die must be non-negative": die < 0,
        "net die exceeds the grid": die > grid["rows"] * grid["cols"],
    }
    return raw.withColumn("errors", _messages({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}))


def production_gate(products: DataFrame, geometry: DataFrame) -> DataFrame:
    """Products that lack explicit geometry by name or alias, or have no positive net die."""
    by_name = geometry.select(F.col("product").alias("name"), F.col("net_die").alias("by_name"), F.lit(True).alias("has_name"))
    by_alias = geometry.select(F.col("product").alias("alias"), F.col("net_die").alias("by_alias"), F.lit(True).alias("has_alias"))
    joined = products.join(by_name, "name", "left").join(by_alias, "alias", "left")
    die = F.when(F.col("has_name"), F.col("by_name")).otherwise(F.col("by_alias"))
    issue = (F.when(F.col("has_name").isNull() & F.col("has_alias").isNull(), "geometry missing")
             .when(F.coalesce(die, F.lit(0)) <= 0, "net die not positive"))
    return joined.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select("name", "alias", "issue")


def shape_mismatches(files: DataFrame, geometry: DataFrame) -> DataFrame:
    """Files whose image size is not what the product's geometry implies."""
    expected = geometry.select("product", (F.col("rows") * F.col("chip_h")).alias("eh"), (F.col("cols") * F.col("chip_w")).alias("ew"))
    return (files.join(expected, "product").filter((F.col("height") != F.col("eh")) | (F.col("width") != F.col("ew")))
            .select("product", "path", "height", "width", "eh", "ew"))


def inconsistent_geometry(inferred: DataFrame) -> DataFrame:
    """Products whose files led to more than one inferred geometry."""
    geo = F.struct("chip_w", "chip_h", "rows", "cols")
    return (inferred.groupBy("product", geo.alias("g")).agg(F.count(F.lit(1)).alias("files"))
            .groupBy("product").agg(F.count(F.lit(1)).alias("geometries"), F.sum("files").alias("files"))
            .filter("geometries > 1"))


def acceptance(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Compare narrow metrics (metric, value) with (check_name, metric, op, bound)."""
    v, b = F.col("value"), F.col("bound")
    ok = (F.when(F.col("op") == ">=", v >= b).when(F.col("op") == "<=", v <= b).when(F.col("op") == ">", v > b)
          .otherwise(v == b))
    return (F.broadcast(thresholds).join(metrics, "metric", "left")
            .select("check_name", "metric", "value", "bound", F.coalesce(ok, F.lit(False)).alias("passed")))


def reconcile(counts: DataFrame) -> DataFrame:
    """Checks (name, rule, expected, found): exact counts, minimum counts."""
    ok = F.when(F.col("rule") == "exact", F.col("found") == F.col("expected")).otherwise(F.col("found") >= F.col("expected"))
    return counts.withColumn("passed", ok)


def overall_status(stages: DataFrame) -> DataFrame:
    """Roll-up of PASS / CHECK / PENDING: the worst status wins."""
    n = {s: F.count_if(F.col("status") == s) for s in ("PASS", "CHECK", "PENDING")}
    return stages.agg(*[c.alias(s.lower()) for s, c in n.items()],
                      F.when(n["PENDING"] > 0, "PENDING").when(n["CHECK"] > 0, "CHECK").otherwise("PASS").alias("overall_status"))


def feature_drift(queries: DataFrame, references: DataFrame, names: list[str], top: int = 12) -> DataFrame:
    """Features whose query mean is farthest from the reference mean, in reference deviations (floored)."""
    def moments(df: DataFrame, prefix: str) -> DataFrame:
        long = df.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "feature", "v")
        return long.groupBy("feature").agg(F.avg("v").alias(f"{prefix}_mean"), F.stddev_pop("v").alias(f"{prefix}_std"))
    joined = moments(queries, "query").drop("query_std").join(moments(references, "reference"), "feature")
    std = F.greatest("reference_std", F.lit(1e-6))
    return (joined.withColumn("reference_std", std)
            .withColumn("z_delta", (F.col("query_mean") - F.col("reference_mean")) / F.col("reference_std"))
            .orderBy(F.round(F.abs("z_delta"), 9).desc(), "feature").limit(top))


