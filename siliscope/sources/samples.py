"""Folders of samples: each holds an archive of arrays and a metadata document; both, or what is wrong, become rows.

A sample is named by its folder. Every folder that has one of the two files is in the sample table or in the error table.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siliscope.sources import arrays
from siliscope.sources.staging import stage

ARCHIVE, DOCUMENT = "arrays.npz", "metadata.json"
METADATA = ("sample_id string, pattern_classes array<string>, patterns array<struct<type: string>>, image_shape array<int>, "
            "actual_net_die int, wafer_mask_strategy string")


class Samples(NamedTuple):
    pixels: DataFrame    # arrays.PIXEL_SCHEMA of the usable samples
    metadata: DataFrame  # sample_id and the fields of METADATA under their names; the document's own id as stated_id
    errors: DataFrame    # sample_id, errors


def _folder(path: Column) -> Column:
    """The folder of a file; readers name a local file with one slash or three after the scheme."""
    return F.regexp_replace(F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/"), "/[^/]+$", "")


def read_samples(spark: SparkSession, root: str) -> Samples:
    """Pair documents with archives below a folder; archives are read once for their pixels and once for what is wrong with them."""
    archives = arrays.archive_files(spark, root, ARCHIVE).withColumn("folder", _folder(F.col("path")))
    text = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", DOCUMENT).text(root, wholetext=True)
            .select(_folder(F.col("_metadata.file_path")).alias("folder"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
            .select("folder", F.from_json("value", METADATA).alias("m"),
                    (F.get_json_object("value", "$").isNotNull() & F.ltrim("value").startswith("{")).alias("object")))
    documents = stage(text.withColumn("sample_id", F.element_at(F.split("folder", "/"), -1)), slim=True)
    held = archives.select("folder", "sample_id")
    both = documents.select("folder", F.col("sample_id").alias("of_document"), "object").join(
        held.withColumnRenamed("sample_id", "of_archive"), "folder", "full")
    judged = stage(both.select("folder", F.coalesce("of_archive", "of_document").alias("sample_id"), F.array_compact(F.array(
        F.when(F.col("of_archive").isNull(), F.lit(f"{ARCHIVE} is missing")), F.when(F.col("of_document").isNull(), F.lit(f"{DOCUMENT} is missing")),
        F.when(~F.col("object"), F.lit(f"{DOCUMENT} is not an object")))).alias("errors")), slim=True)
    unreadable = arrays.read_errors(archives)
    errors = judged.select("sample_id", "errors").filter(F.size("errors") > 0).unionByName(unreadable.select("sample_id", "errors"))
    errors = errors.groupBy("sample_id").agg(F.flatten(F.collect_list("errors")).alias("errors"))
    whole = judged.filter(F.size("errors") == 0).select("folder")
    metadata = documents.join(whole, "folder", "left_semi").select("sample_id", F.col("m.sample_id").alias("stated_id"), *[
        f"m.{c}" for c in ("pattern_classes", "patterns", "image_shape", "actual_net_die", "wafer_mask_strategy")])
    return Samples(arrays.read_pixels(archives.join(whole, "folder", "left_semi")), metadata, errors)
