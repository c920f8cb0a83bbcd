"""Input catalogue: product folders, opaque ids, manifests, geometry documents, and the tables written from them."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.functions.columns import safe_div

BLOCKS = "struct<width int, height int>"
GRID = "struct<rows int, cols int>"
MANIFEST_SCHEMA = (
    "schema_version string, feature_schema_version string, samples array<struct<sample_id string, source_type string, "
    "png_path string, arrays_npz string, sample_dir string, metadata_json string, pseudonymized boolean, "
    "allow_geometry_inference boolean, parser_name string, parser_version string, orientation string, "
    f"wafer_mask_strategy string, array_keys map<string,string>, chip_blocks {BLOCKS}, grid {GRID}, actual_net_die int>>")
GEOMETRY_SCHEMA = f"map<string, struct<chip_blocks: {BLOCKS}, grid: {GRID}, actual_net_die: int>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample entry, with the header versions."""
    doc = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return doc.select("schema_version", "feature_schema_version", F.explode("samples").alias("s")).select(
        "schema_version", "feature_schema_version", "s.*")


def manifest_lines(entries: DataFrame) -> DataFrame:
    """Entries as JSON records with the version strings of the contract; a document has one record per line."""
    return entries.select(F.lit(C.MANIFEST_VERSION).alias("schema_version"),
                          F.lit(C.FEATURE_VERSION).alias("feature_schema_version"),
                          F.array(F.struct(*entries.columns)).alias("samples"))


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Product geometry documents, an object keyed by product name or alias, as one row per product."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json(F.regexp_replace("value", "^\ufeff", ""), GEOMETRY_SCHEMA)
    return (text.select(F.explode(parsed).alias("product", "g"))
            .select("product", "g.chip_blocks", "g.grid", "g.actual_net_die"))


def placed_files(files: DataFrame, root: str) -> DataFrame:
    """Files with their product, the first folder below the root, and their path below it.

    Without any folder the root itself is the product; beside product folders, files of the root belong to none and are left out.
    """
    context = files.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString().rstrip("/")
    # readers name a local file with one slash or three after the scheme
    start = len(re.sub("^([a-z0-9]+):/+", r"\1:/", full)) + 2
    inside = F.substr(F.regexp_replace(F.col("path"), "^([a-z0-9]+):/+", "$1:/"), F.lit(start))
    parted = files.withColumn("_parts", F.split(inside, "/"))
    nested = parted.agg(F.max(F.size("_parts") > 1)).scalar()
    deep = F.size("_parts") > 1
    return (parted.filter(deep | ~nested)
            .withColumn("product", F.when(deep, F.col("_parts")[0]).otherwise(F.lit(full.split("/")[-1])))
            .withColumn("relative_path", F.array_join(F.when(deep, F.slice("_parts", 2, F.size("_parts"))).otherwise(F.col("_parts")), "/"))
            .drop("_parts"))


def discover(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """(product, path, length, relative_path) of the images below the product folders, at any depth."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
             .load(root).select("path", "length"))
    return placed_files(files, root).select("path", "length", "relative_path", "product")


def first_per_product(files: DataFrame, n: int) -> DataFrame:
    """First n files of every product by path; each task keeps its own first n before anything moves."""
    place = F.row_number().over(Window.partitionBy("product").orderBy("path"))
    return files.withColumn("place", place).filter(F.col("place") <= n)


def wafer_alias(relative_path: Column) -> Column:
    return F.concat(F.lit("w"), F.substring(F.sha2(F.lower(relative_path), 256), 1, 10))


def product_alias(product: Column, secret: str) -> Column:
    """Opaque product name: a digest salted with a secret that is drawn once per run."""
    return F.concat(F.lit("product_"), F.substring(F.sha2(F.concat(F.lit(secret), product), 256), 1, 10))


def opaque_entries(files: DataFrame, secret: str) -> DataFrame:
    return files.select("product", "path", F.concat_ws("_", product_alias(F.col("product"), secret),
                                                       wafer_alias(F.col("relative_path"))).alias("sample_id"))


def product_geometry(products: DataFrame, geometry: DataFrame) -> DataFrame:
    """Explicit geometry of each product by its folder name, else by its alias."""
    cols = [c for c in geometry.columns if c != "product"]
    a, b = geometry.alias("a"), geometry.alias("b")
    joined = products.join(a, F.col("name") == F.col("a.product"), "left").join(b, F.col("alias") == F.col("b.product"), "left")
    return joined.select("name", "alias", *[F.when(F.col("a.product").isNotNull(), F.col(f"a.{c}"))
                                            .otherwise(F.col(f"b.{c}")).alias(c) for c in cols])


def batch_metadata(entries: DataFrame, geometry: DataFrame) -> DataFrame:
    """Products, samples, explicit geometries and positive net dies of a batch, one row."""
    per = entries.groupBy("product").agg(F.count(F.lit(1)).alias("samples")).join(
        geometry.select("product", F.lit(1).alias("explicit"), "net_die"), "product", "left")
    return per.agg(F.count(F.lit(1)).alias("product_count"), F.sum("samples").alias("sample_count"),
                   F.count("explicit").alias("explicit_geometry_count"),
                   F.count_if(F.col("net_die") > 0).alias("positive_net_die_count"),
                   safe_div(F.count("explicit"), F.count(F.lit(1))).alias("explicit_share"))


def normalised_metadata(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Entry values over the metadata document over defaults; image shape and geometry always from the image."""
    meta = F.from_json("metadata_json", "sample_id string, actual_net_die int, wafer_mask_strategy string")
    return entries.withColumn("_m", meta).select(
        *keep, F.coalesce("sample_id", "_m.sample_id", F.lit("real_png_unlabeled")).alias("sample_id"),
        F.coalesce("actual_net_die", "_m.actual_net_die", F.lit(0)).alias("actual_net_die"),
        F.coalesce("wafer_mask_strategy", F.lit("centered_ellipse_from_png")).alias("wafer_mask_strategy"),
        F.struct("height", "width").alias("image_shape"), "chip_blocks", "grid")


def read_csv(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return df if split is None else df.filter(F.col("split") == split)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write one table; an empty one is written with its columns."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
