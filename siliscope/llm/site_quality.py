"""Quality of review comments by hierarchical empirical Bayes: the comment's own evidence, its folder's and its product's record.

A logistic classifier on plain text statistics gives each comment evidence. Labelled comments count by their label, all others
by their evidence; summed per product (the host level) and per folder of a product (the path level) these give posteriors.
A product is shrunk towards the global rate and a folder towards its product, by strengths that the spread between groups
sets: a site with few comments keeps its parent's rate. A comment's score joins its evidence with its folder's posterior as odds.

The sums are combined before the shuffle. The join back is salted, so a product that holds a third of the table is dealt to many
tasks. The classifier is fitted on a bounded sample of labels; sums and scores cover every comment.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siliscope.llm.common import small_batches, text_of
from siliscope.llm.toxicity import _logistic
from siliscope.sources.staging import stage

SALTS = 16
FEATURES = ("log_words", "mean_word", "distinct_words", "top_word", "distinct_lines", "letters", "digits", "marks", "capitals", "ends", "log_word_2")
_DIGITS, _LETTERS = bytes(range(48, 58)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_UPPER, _MARKS = bytes(range(65, 91)), bytes(b for b in range(33, 127) if not chr(b).isalnum())


def statistics(text: str) -> list[float]:
    """Length, variety of words and lines, and shares of kinds of characters of a whole text."""
    data = text.encode()
    words, size = data.split(), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, kinds = len(words), {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    mean = sum(map(len, words)) / max(1, n)
    return [np.log1p(n), mean, len(kinds) / max(1, n), max(kinds.values(), default=0) / max(1, n),
            len(set(lines)) / max(1, len(lines)), share(_LETTERS), share(_DIGITS), share(_MARKS), share(_UPPER),
            (data.count(b".") + data.count(b"!") + data.count(b"?")) / max(1, n), np.log1p(n) ** 2]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "x"])


def fit_evidence(reviews: DataFrame, labels: DataFrame, sample_rows: int = 20_000, review_case_id: str = "review_case_id",
                 comment: str = "safe_comment", quality: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray] | float:
    """Weights, mean and spread of the evidence curve from at most ``sample_rows`` labelled comments picked by the hash of their
    id; or, where only one class is labelled, the share of good labels (one half without labels)."""
    own = labels.filter(F.col(review_case_id).isNotNull() & F.col(quality).isNotNull()).groupBy(
        F.col(review_case_id).alias("id")).agg(F.min(F.when(F.col(quality) > 0, 1).otherwise(0)).alias("good"))
    picked = own.orderBy(F.xxhash64("id"), "id").limit(sample_rows)  # bounded, so it may be broadcast
    sample = reviews.select(F.col(review_case_id).alias("id"), text_of(comment).alias("__text")).join(F.broadcast(picked), "id")
    got = sample.select("good", "__text").mapInArrow(_described, "good int, x array<double>").toArrow()
    y = got.column("good").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.5
    x = np.array(got.column("x").to_pylist())
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    return _logistic((x - mean) / spread, y), mean, spread


def _strength(groups: DataFrame, rate: Column) -> float:
    """Prior strength by the method of moments: how many comments the parent's rate is worth.

    ``groups`` has n and good; ``rate`` is the parent's rate of each group.
    """
    g = groups.withColumn("m", rate).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col("m")) ** 2).alias("between"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("inside"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("mass")).first()
    if not g.n or not g.mass:
        return 1.0
    # expected squared deviation of a group: m(1-m)/n within plus m(1-m)/(strength+1) between
    extra = (g.between - g.inside) / g.mass
    return float(np.clip(1 / extra - 1, 1.0, 1e6)) if extra > 0 else 1e6


def classify(reviews: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = 20_000,
             review_case_id: str = "review_case_id", comment: str = "safe_comment", product: str = "product", folder: str = "folder",
             quality: str = "quality") -> DataFrame:
    """Score every comment's quality.

    Returns the id, ``evidence`` (probability from the text alone), ``product_rate`` and ``folder_rate`` (posteriors),
    ``score`` and ``predicted`` (1 if score >= threshold), one row per input row. ``labels`` gives the quality, 0 or 1, of some ids; of
    several labels of an id the lowest holds. A missing comment is empty, a null product or folder is a site of its own.
    """
    small_batches(reviews)
    fitted = fit_evidence(reviews, labels, sample_rows, review_case_id, comment, quality)
    rows = reviews.select(F.col(review_case_id).alias("id"), F.col(product).cast("string").alias("product"),
                          F.col(folder).cast("string").alias("folder"), text_of(comment).alias("__text"))
    schema = rows.select("id", "product", "folder", F.lit(0.0).alias("evidence")).schema

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _described(batches):
            if isinstance(fitted, float):
                p = np.full(batch.num_rows, fitted)
            else:
                curve, mean, spread = fitted
                x = np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, len(FEATURES))
                p = 1 / (1 + np.exp(-np.clip(((x - mean) / spread) @ curve[:-1] + curve[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], ["id", "product", "folder", "evidence"])

    known = labels.filter(F.col(quality).isNotNull()).groupBy(F.col(review_case_id).alias("id")).agg(
        F.min(F.when(F.col(quality) > 0, 1.0).otherwise(0.0)).alias("good"))
    scored = stage(rows.mapInArrow(weigh, schema).join(known, "id", "left"))
    folders = stage(scored.groupBy("product", "folder").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", "evidence")).alias("good")))
    products = folders.groupBy("product").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = products.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = float(np.clip(total.good / total.n, 1e-6, 1 - 1e-6)) if total.n else 0.5
    strength = _strength(products, F.lit(rate))
    hosts = products.select("product", ((F.col("good") + strength * rate) / (F.col("n") + strength)).alias("product_rate"))
    placed = folders.alias("f").join(hosts.alias("h"), F.col("f.product").eqNullSafe(F.col("h.product"))).select("f.*", "product_rate")
    inner = _strength(placed, F.col("product_rate"))
    sites = placed.select("product", "folder", "product_rate", (
        (F.col("good") + inner * F.col("product_rate")) / (F.col("n") + inner)).alias("folder_rate"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("id", "evidence"), F.lit(SALTS)).cast("int"))
    met = salted.alias("s").join(sites.alias("t"), F.col("s.product").eqNullSafe(F.col("t.product")) &
                                 F.col("s.folder").eqNullSafe(F.col("t.folder")) & (F.col("s.salt") == F.col("t.salt")))
    held = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = lambda c: F.log(held(c) / (1 - held(c)))
    z = odds("evidence") + odds("folder_rate") - F.lit(float(np.log(rate / (1 - rate))))
    return met.select("id", "evidence", "product_rate", "folder_rate", (1 / (1 + F.exp(-z))).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)).withColumnRenamed("id", review_case_id)
