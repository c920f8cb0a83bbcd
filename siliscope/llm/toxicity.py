"""Toxicity of review comments by two class-conditional Kneser-Ney models, one of toxic and one of ordinary comments.

A word after another has, in each class, its discounted share of what followed, backed off to the class's continuation
share of the word (in how many different contexts it stands, so that copies of a comment count once), backed off to the
continuation counts that both classes share, and at last to a uniform share for unknown words. Rare expressions thus lean on the
counts of both classes: a word seen once says far less than one seen often in one class alone.

A comment is described by its length-normalised log-likelihood difference, log P(words | toxic) - log P(words | ordinary) per word,
and, since a few words may make a long comment toxic, by the largest differences of single expressions and by how many come near
the largest difference the counts allow. A logistic curve fitted on labelled comments that were kept out of the counts turns that into
a probability.

The labelled sample is bounded by a parameter, and with it all its words and pairs, so the model may be broadcast. Every comment
of the table is then scored whole in one pass without a shuffle.
"""
from __future__ import annotations

import dataclasses
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siliscope.llm.common import crc_remainder, small_batches, text_of
from siliscope.operators.ordering import row_index
from siliscope.sources.staging import stage

DISCOUNT = 0.75
WORDS = re.compile(r"\w+")
#: distances below the largest difference at which expressions are counted
STEPS = (0.25, 0.6, 1.2, 2.0)
N_FEATURES = 4 + len(STEPS)
SAMPLE_ROWS = 12_000


@dataclasses.dataclass
class Model:
    """``difference`` is log P(word | toxic) - log P(word | ordinary) without context, ``backoff`` the difference of the
    two backoff weights after a word; index 0 stands for unknown words. ``pairs`` (sorted, previous * n + word) holds
    the differences of all pairs that were seen. ``curve`` are the logistic weights, the last one the constant."""

    words: list[str]
    difference: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    pair_difference: np.ndarray
    ceiling: float
    curve: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    constant: float | None = None
    known: dict[str, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def index(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words, 1)}

    def features(self, texts: list[str], index: dict[str, int]) -> np.ndarray:
        known, ids, lengths = index.get, [], []
        for text in texts:
            words = WORDS.findall(text.lower())
            lengths.append(len(words))
            ids.append(np.fromiter((known(w, 0) for w in words), np.int64, len(words)))
        ends = np.cumsum(lengths)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        single = self.difference[flat]
        out = np.zeros((len(texts), N_FEATURES))
        if not len(flat):
            return out
        before = np.zeros(len(flat), np.int64)
        before[1:] = flat[:-1]
        first = np.concatenate([[0], ends[:-1]])
        before[first[first < len(flat)]] = 0
        key = before * (len(self.words) + 1) + flat
        paired = single + self.backoff[before]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            paired[hit] = self.pair_difference[at[hit]]
        for i, (a, b) in enumerate(zip(first.tolist(), ends.tolist())):
            n = b - a
            if not n:
                continue
            own = single[a:b]
            top = np.sort(own if n <= 8 else np.partition(own, n - 8)[n - 8:])[::-1]
            out[i] = [paired[a:b].mean(), top[0], top[:3].mean(), np.log1p(n),
                      *[np.log1p((own > self.ceiling - s).sum()) for s in STEPS]]
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None or self.curve is None:
            return np.full(len(features), self.constant or 0.0)
        z = ((features - self.mean) / self.spread) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    ridge = np.eye(x.shape[1]) * penalty
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word follows another in toxic and in ordinary comments, per batch."""
    for batch in batches:
        counts = [Counter(), Counter()]
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = WORDS.findall(text.lower())
            counts[toxic].update(zip(["", *words], words))
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({
            "h": pa.array([k[0] for k in keys], pa.string()), "w": pa.array([k[1] for k in keys], pa.string()),
            "n0": pa.array([counts[0].get(k, 0) for k in keys], pa.int64()), "n1": pa.array([counts[1].get(k, 0) for k in keys], pa.int64())})


def shares(pairs: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Both classes' shares from counts (h, w, n0, n1) of words after others; h is empty at a comment's start.

    Words: (i, w, share0, share1, weight0, weight1), i from 1 by order of the word, with its continuation shares and the weights of
    backing off after it, and a row with i = 0 for unknown words. Pairs: (i_h, i_w, p0, p1) of those after a word. The last is what
    the difference of a word of toxic comments alone, however common, comes near.
    """
    seen = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    words = pairs.groupBy("w").agg(seen("n0").alias("c0"), seen("n1").alias("c1"))
    heads = pairs.groupBy(F.col("h").alias("w")).agg(F.sum("n0").alias("f0"), F.sum("n1").alias("f1"), seen("n0").alias("t0"), seen("n1").alias("t1"))
    known = stage(row_index(words.join(heads, "w", "left").fillna(0), ["w"], "i").withColumn("i", F.col("i") + 1))
    tot = known.agg(F.count(F.lit(1)).alias("v"), *[f(c).alias(n) for f, c, n in (
        (F.sum, "c0", "c0"), (F.sum, "c1", "c1"), (seen, "c0", "t0"), (seen, "c1", "t1"))]).first()
    total = {0: float(tot.c0), 1: float(tot.c1)}
    kinds, shared, v = {0: float(tot.t0), 1: float(tot.t1)}, float(tot.c0 + tot.c1), float(tot.v)

    def discounted(count: Column) -> Column:
        return F.greatest(count.cast("double") - DISCOUNT, F.lit(0.0))

    base = (discounted(F.col("c0") + F.col("c1")) + DISCOUNT * v / (v + 1)) / shared
    share = {c: ((discounted(F.col(f"c{c}")) + DISCOUNT * kinds[c] * base) / total[c]).alias(f"share{c}") for c in (0, 1)}
    weight = {c: F.when(F.col(f"f{c}") > 0, DISCOUNT * F.col(f"t{c}") / F.col(f"f{c}")).otherwise(1.0).alias(f"weight{c}") for c in (0, 1)}
    unknown = known.sparkSession.createDataFrame([(0, "", 0, 0, 0, 0, 0, 0)], "i long, w string, c0 long, c1 long, f0 long, f1 long, t0 long, t1 long")
    every = known.select("i", "w", "c0", "c1", "f0", "f1", "t0", "t1").unionByName(unknown)
    table = stage(every.select("i", "w", *share.values(), *weight.values(), "f0", "f1"))
    after = table.filter("i > 0").select(F.col("w").alias("h"), F.col("i").alias("i_h"), "weight0", "weight1", "f0", "f1")
    word = table.filter("i > 0").select("w", F.col("i").alias("i_w"), "share0", "share1")
    chance = [F.when(F.col(f"f{c}") > 0, discounted(F.col(f"n{c}")) / F.col(f"f{c}") + F.col(f"weight{c}") * F.col(f"share{c}"))
              .otherwise(F.col(f"share{c}")).alias(f"p{c}") for c in (0, 1)]
    ceiling = float(np.log((1 / total[1] + DISCOUNT * kinds[1] / total[1] / shared) / (DISCOUNT * kinds[0] / total[0] / shared)))
    return table, pairs.join(after, "h").join(word, "w").select("i_h", "i_w", *chance), ceiling


def fit(reviews: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, review_case_id: str = "review_case_id",
        comment: str = "safe_comment", toxic: str = "toxic") -> Model:
    """Count and calibrate on at most ``sample_rows`` labelled comments, picked by the hash of their id.

    Three quarters of the sample are counted, one quarter fits the curve. The model keeps every word and every pair of the counted
    comments. Ids with several labels are toxic if one label says so; rows without an id or label teach nothing. If a class
    has no comment, every score is the share of toxic labels.
    """
    small_batches(reviews)
    spark = reviews.sparkSession
    own = labels.filter(F.col(review_case_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(
        F.col(review_case_id).alias("id")).agg(F.max(F.when(F.col(toxic) > 0, 1).otherwise(0)).alias("toxic"))
    # at most sample_rows ids and marks, so the broadcast is bounded
    picked = own.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = reviews.select(F.col(f"`{review_case_id}`").alias("id"), text_of(f"`{comment}`").alias("text"))
    sample = stage(texts.join(F.broadcast(picked), "id").withColumn("curve", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) == 0))
    classes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model([], np.zeros(1), np.zeros(1), np.empty(0, np.int64), np.empty(0), 0.0)
    if len(classes) < 2:
        none.constant = float(bool(classes.get(1)))
        return none
    pairs = stage(sample.filter(~F.col("curve")).select("text", "toxic").mapInArrow(
        _pair_counts, "h string, w string, n0 long, n1 long").groupBy("h", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    counted = pairs.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not counted.n0 or not counted.n1:
        none.constant = classes[1] / (classes[0] + classes[1])
        return none
    words, chances, ceiling = shares(pairs)
    rows = words.select("i", "w", F.log(F.col("share1") / F.col("share0")).alias("d"), F.log(F.col("weight1") / F.col("weight0")).alias("b")).orderBy("i").toArrow()
    n = rows.num_rows
    # numbers alone: a key and a difference per pair of the bounded sample
    seen = chances.select((F.col("i_h") * n + F.col("i_w")).alias("key"), F.log(F.col("p1") / F.col("p0")).cast("float").alias("d")).toArrow()
    key, d = seen.column("key").to_numpy(), seen.column("d").to_numpy()
    order = np.argsort(key)
    model = Model(rows.column("w").to_pylist()[1:], rows.column("d").to_numpy(), rows.column("b").to_numpy(), key[order], d[order], ceiling)
    shared_model = spark.sparkContext.broadcast(model)
    schema = "toxic int, features array<double>"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, index = _held(shared_model)
        for batch in batches:
            x = model.features(batch.column("text").to_pylist(), index)
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic").cast(pa.int32()), "features": pa.array(list(x), pa.list_(pa.float64()))})

    curve = sample.filter("curve").select("text", "toxic").mapInArrow(describe, schema).toArrow()
    shared_model.unpersist()
    y = curve.column("toxic").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):  # too few labels to fit a curve
        model.constant = classes[1] / (classes[0] + classes[1])
        return model
    x = np.array(curve.column("features").to_pylist())
    model.mean, model.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.curve = _logistic((x - model.mean) / model.spread, y)
    return model


def _held(shared) -> tuple[Model, dict[str, int]]:
    """The model and its word index, made once per worker and dropped with the broadcast."""
    model = shared.value
    if model.known is None:
        model.known = model.index()
    return model, model.known


def score(reviews: DataFrame, model: Model, threshold: float = 0.7, comment: str = "safe_comment") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold) to every comment.

    All other columns pass through under whatever names; columns of these two are replaced. A missing comment is scored as an
    empty one. Only the comment's text is looked at.
    """
    shared = reviews.sparkSession.sparkContext.broadcast(model)
    names = [c for c in reviews.columns if c not in ("score", "predicted")]
    plain = [f"c{i}" for i in range(len(names))]  # names of the operator's own, so that no column of the table clashes
    held = reviews.select(*[F.col(f"`{n}`").alias(p) for n, p in zip(names, plain)], text_of(f"`{comment}`").alias("text"))
    schema = held.select(*plain, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, index = _held(shared)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                p = model.probability(model.features(batch.column(batch.num_columns - 1).to_pylist(), index))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                                                 [*plain, "score", "predicted"])

    scored = held.mapInArrow(run, schema)
    return scored.select(*[F.col(p).alias(n) for n, p in zip(names, plain)], "score", "predicted")


def learning_fold(labels: DataFrame, review_case_id: str = "review_case_id") -> DataFrame:
    """Labels that may teach: those whose crc32 of the id as text leaves no 1 modulo 3."""
    return labels.filter(crc_remainder(review_case_id, 3) != 1)
