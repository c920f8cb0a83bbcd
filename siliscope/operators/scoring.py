"""Scoring unlabelled wafers with a stored encoder: from pixels and their sanity to statuses, probabilities and look-alikes."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siliscope.operators import models, pooling, retrieval, search, statistics, validation
from siliscope.operators.geometry import Geometry
from siliscope.sources import manifest, model_store
from siliscope.sources.staging import stage

NEIGHBORS = 5


class Scored(NamedTuple):
    predictions: DataFrame
    neighbors: DataFrame


def score(pixels: DataFrame, sanity: DataFrame, model: models.Encoder, size: int, reference: DataFrame, k: int = NEIGHBORS) -> Scored:
    """Score the wafers that passed their checks.

    ``pixels`` is a pixel table, ``sanity`` one row per wafer with ``errors`` and ``warnings`` (see ``validation.sample_sanity``; a wafer
    that could not be read has errors and no pixels), ``reference`` the encoder's stored wafers (id, embedding, y).

    Predictions have one row per row of ``sanity``: ``status`` PASS or FAIL, ``scoring_status`` SCORED or SKIPPED, the messages, and
    for scored wafers a probability per label, the best label with its probability, the margin to the second, the mean entropy,
    the review priority and the embedding; NULL for all others. A wafer is scored if it has no errors and all its probabilities
    are finite. Neighbours are the k most similar stored wafers of every scored one, with a flag per label.
    """
    fit = sanity.filter(F.size("errors") == 0).select("sample_id")
    cells = pooling.pooled(pixels.join(fit, "sample_id", "left_semi"), size)
    encoded = models.encode(model, pooling.input_tensor(cells, size)).drop("vec", "logits")
    finite = F.forall("probs", lambda p: ~F.isnan(p) & (F.abs(p) < float("inf"))) & F.forall("embedding", lambda e: ~F.isnan(e))
    encoded = stage(encoded.filter(finite))
    rated = encoded.withColumns(statistics.score_uncertainty(F.col("probs"), model.labels)).select(
        F.col("id").alias("sample_id"), *[F.get("probs", F.lit(i)).alias(f"prob_{n}") for i, n in enumerate(model.labels)],
        F.col("top_label").alias("top_label_hint"), "top_probability", "confidence_margin", "mean_binary_entropy", "review_priority",
        *[F.get("embedding", F.lit(i)).alias(f"embedding_{i:02d}") for i in range(model.w2.shape[1])])
    status = sanity.select(
        "sample_id", F.when(F.size("errors") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))
    scored = F.when(F.col("top_probability").isNotNull(), "SCORED").otherwise("SKIPPED")
    names = [c for c in rated.columns if c != "sample_id"]
    predictions = status.join(rated, "sample_id", "left").select("sample_id", "status", scored.alias("scoring_status"), "errors", "warnings", *names)
    return Scored(predictions, stored_neighbors(encoded, reference, model.labels, k))


def stored_neighbors(encoded: DataFrame, reference: DataFrame, labels: tuple[str, ...], k: int = NEIGHBORS) -> DataFrame:
    """(query_id, rank, neighbor_id, similarity, neighbor_has_*) of (id, embedding) rows among stored ones; none without stored ones."""
    has = [F.get("y", F.lit(i)).cast("int").alias(f"neighbor_has_{n}") for i, n in enumerate(labels)]
    if reference.isEmpty():
        none = encoded.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.lit("").alias("neighbor_id"), F.lit(0.0).alias("similarity"),
                              *[F.lit(0).alias(f"neighbor_has_{n}") for n in labels])
        return none.limit(0)
    found = search.cosine_neighbors(encoded.select("id", F.col("embedding").alias("vec")),
                                    reference.select("id", F.col("embedding").alias("vec")), k, exclude_same_id=False)
    return found.join(reference.select(F.col("id").alias("neighbor_id"), "y"), "neighbor_id").select(
        "query_id", "rank", "neighbor_id", "similarity", *has)


def score_pixels(spark: SparkSession, pixels: DataFrame, geometry: Geometry, model_path: str, version: int | None = None, k: int = NEIGHBORS,
                 unreadable: DataFrame | None = None) -> Scored:
    """Check, pool, encode and compare a pixel table with a published encoder, in one call.

    ``unreadable`` lists further wafers as (sample_id, errors): they fail and are skipped.
    """
    model = model_store.load(spark, model_path, version)
    size = model_store.output_size(spark, model_path, version)
    if 4 * size * size != len(model.mean):
        raise ValueError("the stored encoder does not take input tensors")
    sanity = validation.sample_sanity(pixels, geometry).select("sample_id", "errors", "warnings")
    if unreadable is not None:
        sanity = sanity.unionByName(unreadable.select("sample_id", "errors", F.array().cast("array<string>").alias("warnings")))
    reference, odd = model_store.load_reference(spark, model_path, model, version)
    if not odd.isEmpty():
        raise ValueError("stored reference rows do not have the encoder's width")
    return score(pixels, stage(sanity, slim=True), model, size, reference, k)


def score_manifest(spark: SparkSession, path: str, geometry: Geometry, model_path: str, version: int | None = None, k: int = NEIGHBORS) -> Scored:
    """Score every wafer that a manifest document lists; entries that cannot be read fail with what was wrong."""
    pixels, errors = manifest.read(spark, path)
    return score_pixels(spark, stage(pixels), geometry, model_path, version, k, unreadable=errors)


def evaluate(model: models.Encoder, reference: DataFrame, queries: DataFrame, k: int = NEIGHBORS, threshold: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How an encoder does on labelled wafers (id, vec, y, signature): (loss, per class, retrieval).

    Loss is the mean binary cross-entropy over wafers and labels; per class precision, recall and loss at the threshold;
    retrieval compares every query with its nearest reference wafers by embedding.
    """
    queried = stage(models.encode(model, queries))
    rows = F.array(*[F.struct(F.lit(n).alias("class_name"), F.get("y", F.lit(i)).cast("int").alias("truth"), F.get("probs", F.lit(i)).alias("p"))
                     for i, n in enumerate(model.labels)])
    long = queried.select(F.explode(rows).alias("r")).select("r.*").withColumn("pred", (F.col("p") >= threshold).cast("int"))
    entropy = F.avg(statistics.cross_entropy(F.col("truth").cast("double"), F.col("p"))).alias("bce")
    per_class = statistics.confusion(long).join(long.groupBy("class_name").agg(entropy), "class_name")
    held = models.encode(model, reference)
    points = [df.select("id", F.col("embedding").alias("vec")) for df in (queried, held)]
    found = search.cosine_neighbors(points[0], points[1], k)
    signed = queries.select("id", "signature").unionByName(reference.select("id", "signature")).distinct()
    return long.agg(entropy), per_class, retrieval.embedding_metrics(found, signed, queries.select("id"), reference.select("id"))
