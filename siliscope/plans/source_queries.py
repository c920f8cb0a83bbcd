"""Files: wafers of the given tables are written through the sinks, read back through the sources and compared with what was written."""
from __future__ import annotations

from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.functions import columns as fc
from siliscope.operators import validation as va
from siliscope.plans import demo
from siliscope.plans.registry import part, query
from siliscope.plans.review_queries import CODES, gray_pixels, numbered_pixels
from siliscope.sources import arrays, catalog, folders, png, samples
from siliscope.sources.sinks import write_files
from siliscope.sources.staging import shared_folder

# Images whose grid is to be found out: chips of 3x3 on the 24x24 map, two products, and per product some images of seven chip columns
SIDE = 3
part("chip3", f"""SELECT *, (stby3=0 AND in3=1)::INT AS valid3, CASE WHEN stby3=1 THEN 255 WHEN in3=1 THEN {CODES}[least(severity, 6)+1] ELSE 0 END AS gray3 FROM (
   SELECT sample_id, w, y, x, severity, CASE WHEN w%8=5 THEN 21 ELSE 24 END AS width3, in3, (in3=1 AND w%4<>0 AND (7*w+5*(y//3)+3*(x//3))%11=0)::INT AS stby3 FROM (
     SELECT *, ((2*(y//3)-7)*(2*(y//3)-7)+(2*(x//3)-7)*(2*(x//3)-7)<=64)::INT AS in3 FROM px)) WHERE x<width3""", ("px",))


def small_chips(spark, sf):
    """Gray images with chips of SIDE x SIDE pixels; every eighth wafer lost its last chip column."""
    w, r, c = F.col("w"), F.expr(f"y div {SIDE}").cast("int"), F.expr(f"x div {SIDE}").cast("int")
    wafer = ((2 * r - 7) * (2 * r - 7) + (2 * c - 7) * (2 * c - 7) <= 64).cast("int")
    stby = ((wafer == 1) & (w % 4 != 0) & ((7 * w + 5 * r + 3 * c) % 11 == 0)).cast("int")
    width = F.when(w % 8 == 5, 21).otherwise(24)
    return (demo.pixels(spark, sf).withColumns({"in_wafer": wafer, "stby": stby, "width": width, "severity": F.least("severity", F.lit(6))})
            .withColumn("gray", fc.grade_to_gray(F.col("severity"), F.col("in_wafer"), F.col("stby")))
            .filter(F.col("x") < F.col("width")))


def image_folder(spark, pixels, name):
    """The pixels as <folder>/<product>/<wafer>.png; the product is the wafer's number modulo two."""
    folder = shared_folder(spark, name)
    path = F.concat(F.lit("p"), (F.col("w") % 2).cast("string"), F.lit("/"), "sample_id", F.lit(".png"))
    write_files(png.pack_images(pixels.withColumn("path", path)), folder)
    return folder


def wafer_of(path):
    return F.regexp_extract(path, r"([^/]+)\.png$", 1)


@query("s04_gray_images", "SELECT sample_id, 'p'||(w%2)::VARCHAR AS product, y, x, gray FROM gray", ("gray",))
def _(spark, sf):
    folder = image_folder(spark, gray_pixels(spark, sf), "images")
    return catalog.placed_files(png.read_gray(spark, folder), folder).select(wafer_of("path").alias("sample_id"), "product", "y", "x", "gray")


@query("s05_folder_wafers", """SELECT sample_id, y, x, CASE WHEN stby3=1 THEN 0 ELSE CASE WHEN in3=1 THEN least(severity, 6) ELSE 0 END END AS severity, in3 AS in_wafer, stby3 AS stby, valid3 AS valid
   FROM chip3 WHERE width3=24""", ("chip3",))
def _(spark, sf):
    pixels = small_chips(spark, sf)
    folder = image_folder(spark, pixels, "images")
    wafers = folders.read_folder(spark, folder, "secret")
    # the names of wafers come back through the digest that hides them
    known = pixels.select("sample_id", "w").distinct().select("sample_id", F.concat_ws(
        "_", catalog.product_alias(F.concat(F.lit("p"), (F.col("w") % 2).cast("string")), "secret"),
        catalog.wafer_alias(F.concat("sample_id", F.lit(".png")))).alias("opaque"))
    return wafers.pixels.withColumnRenamed("sample_id", "opaque").join(known, "opaque").select(
        "sample_id", "y", "x", "severity", "in_wafer", "stby", "valid")


@query("s05_folder_errors", "SELECT DISTINCT sample_id, 'p'||(w%2)::VARCHAR AS product, 'chip grid does not cover the image' AS error FROM chip3 WHERE width3=21", ("chip3",))
def _(spark, sf):
    folder = image_folder(spark, small_chips(spark, sf), "images")
    return folders.read_folder(spark, folder, "secret").errors.select(wafer_of("path").alias("sample_id"), "product", "error")


@query("v08_agreed_geometry", """SELECT 'p'||(w%2)::VARCHAR AS product, 3 AS chip_h, 3 AS chip_w, 8 AS rows, 8 AS cols FROM chip3 WHERE stby3=1 AND width3=24 GROUP BY w%2""", ("chip3",))
def _(spark, sf):
    folder = image_folder(spark, small_chips(spark, sf), "images")
    return folders.read_folder(spark, folder, "secret").geometry.select("product", "chip_h", "chip_w", "rows", "cols")


@query("s13_archive_files", "SELECT sample_id, y, x, severity, in_wafer, valid, stby, CASE WHEN in_wafer=1 THEN chip_id ELSE -1 END AS chip_id FROM cpid", ("cpid",))
def _(spark, sf):
    folder = shared_folder(spark, "archives")
    arrays.write_archives(numbered_pixels(spark, sf), folder)
    return arrays.read_pixels(arrays.archive_files(spark, folder)).select("sample_id", "y", "x", "severity", "in_wafer", "valid", "stby", "chip_id")


@query("s12_json_table", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, sf):
    events = demo.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    folder = shared_folder(spark, "tables")
    catalog.write_table(events, folder, "json")
    return spark.read.schema(events.schema).json(folder)


# ---- sample folders: archives with documents; some documents are missing, some list other classes or unknown pattern types
def sample_folder(spark, sf):
    folder = shared_folder(spark, "samples")
    pixels = numbered_pixels(spark, sf)
    arrays.write_archives(pixels, folder)
    wafers = pixels.select("sample_id", "w").distinct().filter("w % 7 <> 3")
    classes = F.array(*[F.lit(c) for c in C.PATTERN_CLASSES])
    listed = F.when(F.col("w") % 5 == 1, F.reverse(classes)).when(F.col("w") % 5 == 2, F.slice(classes, 1, 2)).otherwise(classes)
    types = F.when(F.col("w") % 3 == 1, F.array(F.lit("ring"), F.lit("smear"))).otherwise(F.array(F.lit("scratch")))
    document = F.to_json(F.struct("sample_id", listed.alias("pattern_classes"), F.transform(types, lambda t: F.struct(t.alias("type"))).alias("patterns"),
                                  F.array(F.lit(24), F.lit(24)).alias("image_shape")))
    document = F.when(F.col("w") % 11 == 9, F.lit("[1, 2]")).otherwise(document)
    write_files(wafers.select(F.concat("sample_id", F.lit("/metadata.json")).alias("path"), document.cast("binary").alias("content")), folder)
    return samples.read_samples(spark, folder)


part("wafers", "SELECT DISTINCT sample_id, w FROM px", ("px",))


@query("s01_sample_folders", """SELECT sample_id, count(*) AS pixels, sum(severity)::BIGINT AS severity, sum(stby)::BIGINT AS stby FROM px WHERE w%7<>3 AND w%11<>9 GROUP BY 1""", ("px",))
def _(spark, sf):
    return sample_folder(spark, sf).pixels.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("severity").alias("severity"), F.sum("stby").alias("stby"))


@query("s01_sample_folder_errors", """SELECT sample_id, CASE WHEN w%7=3 THEN 'metadata.json is missing' ELSE 'metadata.json is not an object' END AS error FROM wafers WHERE w%7=3 OR w%11=9""", ("wafers",))
def _(spark, sf):
    return sample_folder(spark, sf).errors.select("sample_id", F.explode("errors").alias("error"))


@query("v01_class_lists", "SELECT sample_id FROM wafers WHERE w%7<>3 AND w%11<>9 AND w%5 IN (1, 2)", ("wafers",))
def _(spark, sf):
    return va.class_list_errors(sample_folder(spark, sf).metadata)


@query("v01_pattern_types", "SELECT sample_id, 'smear' AS type FROM wafers WHERE w%7<>3 AND w%11<>9 AND w%3=1", ("wafers",))
def _(spark, sf):
    return va.pattern_type_errors(sample_folder(spark, sf).metadata)
