"""Scalar column expressions. Everything here stays inside whole-stage code generation."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from siliscope import constants as C

TWO_PI = 2 * math.pi


def r6(col: Column) -> Column:
    """Six-digit view of a float that was summed in an unspecified order."""
    return F.round(col, 6)


def ratio(num: Column, den: Column) -> Column:
    """Integer sums divided once; an empty denominator counts as one."""
    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")


def flag(cond: Column) -> Column:
    return cond.cast("int")


def gray_to_grade(gray: Column) -> Column:
    """Exact code lookup; NULL for any code outside the eight."""
    out = F.when(gray == C.GRADE_GRAYS[0], 0)
    for grade, code in enumerate(C.GRADE_GRAYS[1:], start=1):
        out = out.when(gray == code, grade)
    return out


def grade_to_gray(severity: Column, in_wafer: Column, stby: Column) -> Column:
    codes = F.array(*[F.lit(c) for c in C.GRADE_GRAYS])
    grade = F.least(F.greatest(severity.cast("int"), F.lit(0)), F.lit(C.MAX_GRADE))
    return F.when(stby == 1, C.STBY_GRAY).when(in_wafer == 1, F.element_at(codes, grade + 1)).otherwise(0)


def normalised_severity(severity: Column) -> Column:
    return F.least(F.greatest(severity, F.lit(0)), F.lit(C.MAX_GRADE)) / F.lit(float(C.MAX_GRADE))


def quantise(value: Column, thresholds: list[float]) -> Column:
    """Number of ascending thresholds reached, i.e. grade 0..len(thresholds)."""
    out = F.lit(0)
    for t in thresholds:
        out = out + flag(value >= F.lit(float(t)))
    return out


def clock_turn(dx: Column, dy: Column) -> Column:
    """Angle in turns [0, 1), clockwise from twelve o'clock; y grows downwards."""
    return ((F.atan2(dx, -dy) + F.lit(TWO_PI)) % F.lit(TWO_PI)) / F.lit(TWO_PI)


def bin_index(scaled: Column, bins: int) -> Column:
    """Equal-width bin of a position in [0, 1]."""
    clipped = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(0.999999))
    return F.least(F.floor(clipped * F.lit(float(bins))).cast("int"), F.lit(bins - 1))


def hour_label(hour: Column) -> Column:
    return F.concat(F.lpad(F.when(hour == 0, 12).otherwise(hour).cast("string"), 2, "0"), F.lit(":00"))


def clock_position(dx: Column, dy: Column) -> Column:
    """Nearest hour (ties to even) of an offset from the wafer centre."""
    hour = F.rint(F.pmod(F.atan2(dx, -dy), F.lit(TWO_PI)) / F.lit(TWO_PI) * F.lit(12.0)).cast("int")
    return F.when((dx == 0) & (dy == 0), "center").otherwise(hour_label(hour))


def sector12(dx: Column, dy: Column) -> Column:
    return F.pmod(F.rint(clock_turn(dx, dy) * F.lit(12.0)).cast("int"), F.lit(12))


def radial_zone(radius: Column) -> Column:
    return F.when(radius < 0.33, "center").when(radius < 0.72, "middle").otherwise("edge-side")


def location_label(cls: Column, top_clock: Column, centroid_clock: Column, share: Column, radius: Column) -> Column:
    return (
        F.when((cls == "ring") & (share < 0.20), "ring_global")
        .when((cls == "edge") & (radius >= 0.72) & (share < 0.24), "edge_global")
        .when((cls == "shot_grid") & (share < 0.22), "wafer_global")
        .when(share < 0.16, "wafer_global")
        .otherwise(F.coalesce(top_clock, centroid_clock))
    )


def feature_key(cls: Column, location: Column, zone: Column) -> Column:
    loc = F.lower(F.regexp_replace(F.regexp_replace(location, ":", ""), " ", "_"))
    return F.concat_ws("__", cls, loc, F.lower(F.translate(zone, "-", "_")))


def circular_member(index: Column, start: Column, width: Column, bins: int) -> Column:
    return F.pmod(index - start, F.lit(bins)) < width


def label_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two bit-packed label sets; two empty sets agree fully."""
    union = F.bit_count(a.bitwiseOR(b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.bit_count(a.bitwiseAND(b)) / union)


def label_signature(flags: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for i, f in enumerate(flags):
        out = out + f.cast("long") * F.lit(1 << i)
    return out


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))
