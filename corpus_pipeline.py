"""From raw documents to token ids: drop toxic ones, keep one of each group of near copies, mask secrets, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next stage's docs.
All but the last keep the columns of documents. The operators of siliscope.llm decide; a stage only maps columns and applies
the decision.

Null texts are empty, a null source is a source of its own, rows without an id are kept by the filters. Rows that repeat an id and all
else are copies of one document: the near-copy stage keeps one. An empty table gives empty tables.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siliscope.llm import bpe, budget_mix, credential_links, ngram_join, toxicity
from siliscope.llm.common import table
from siliscope.llm.queries import reviews_of, tokenizer_path
from siliscope.sources.staging import shared_folder, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject. The models learn from the labelled documents of the learning fold."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "review_case_id")
    model = toxicity.fit(reviews_of(docs), toxicity.learning_fold(labels))
    return toxicity.score(docs.select(*COLUMNS), model, comment="text").filter("predicted = 0").select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word n-grams at a likeness of 0.8 or more: the one with the smallest id."""
    joined = stage(ngram_join.join(reviews_of(docs), percent=80, width=5).select(F.col("review_case_id").alias("doc_id"), "component_id"))
    dropped = joined.filter("component_id < doc_id").select("doc_id").distinct()
    repeated = joined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 AND doc_id IS NOT NULL").select("doc_id")
    own = docs.select(*COLUMNS)
    single = own.join(dropped.unionByName(repeated), "doc_id", "left_anti")
    copies = own.join(repeated, "doc_id", "left_semi").join(dropped, "doc_id", "left_anti").distinct()
    return single.unionByName(copies).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the spans of its secrets masked and its length counted anew where that changed it."""
    found = credential_links.find(docs.select(*COLUMNS), review_case_id="doc_id", comment="text")
    has = F.size("spans") > 0
    # under a name of its own: a column called text in the same select would be taken for the text to mask
    masked = found.withColumn("masked", credential_links.redacted(F.col("text"), F.col("spans")))
    return masked.select("doc_id", F.col("masked").alias("text"), "lang", "source",
                         F.when(has, F.length("masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document stands in it as often as it was taken. Rows that share id, source and size are taken alike."""
    taken = budget_mix.mix(reviews_of(docs)).filter("taken > 0").groupBy(
        F.col("review_case_id").alias("id"), F.col("product").alias("grp"), "size").agg(
        F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    sized = docs.select(*COLUMNS).withColumn("size", budget_mix.words_of("text"))
    met = sized.join(taken, sized["doc_id"].eqNullSafe(taken["id"]) & sized["source"].eqNullSafe(taken["grp"]) & (sized["size"] == taken["size"]))
    return met.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    decoded = bpe.encode(docs.select(*COLUMNS), tokenizer_path(), comment="text", decoded="decoded_comment", pieces=100_000)
    return decoded.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
                          (F.col("decoded_comment") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("toxicity", toxic_stage), ("n-gram Jaccard join", near_copy_stage), ("secret scans", secret_stage),
          ("mixing sources to target weights", mix_stage), ("BPE encoding and decoding", token_stage)]

#: the models of the first stage and the seeded mix cannot be stated in SQL; tests compare each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; what each returns is written to the session's shared folder and read back."""
    folder = shared_folder(spark, "pipeline")

    def apply(docs: DataFrame, numbered) -> DataFrame:
        k, (_, stage_of) = numbered
        stage_of(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        return spark.read.parquet(f"{folder}/{k}")

    return reduce(apply, enumerate(STAGES), table(spark, sf_dir, "documents"))
