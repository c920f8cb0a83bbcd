"""How good is a search: label agreement of neighbours against chance, per class, per target and per feature set."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siliscope.functions import names as nm
from siliscope.functions.columns import label_jaccard, label_signature, safe_div
from siliscope.operators import search
from siliscope.operators.ordering import row_index

FLOOR = 1e-9


def signatures(labels: DataFrame, classes: tuple[str, ...], id_col: str = "sample_id") -> DataFrame:
    """(id, signature): the label columns of a wafer packed into one integer."""
    return labels.select(F.col(id_col).alias("id"), label_signature([F.col(f"label_{c}") for c in classes])
                         .alias("signature"))


def with_signatures(neighbors: DataFrame, sigs: DataFrame) -> DataFrame:
    """Neighbour rows with the label sets of both sides and their Jaccard agreement."""
    q = sigs.select(F.col("id").alias("query_id"), F.col("signature").alias("query_signature"))
    n = sigs.select(F.col("id").alias("neighbor_id"), F.col("signature").alias("neighbor_signature"))
    return (neighbors.join(q, "query_id").join(n, "neighbor_id")
            .withColumn("jaccard", label_jaccard(F.col("query_signature"), F.col("neighbor_signature"))))


def signature_pairs(sigs: DataFrame) -> DataFrame:
    """(sa, sb, pairs): how many unordered pairs of wafers have these two label sets.

    There are at most 2^classes different label sets, so the pairs formed here are pairs of label sets, not of wafers.
    """
    counts = sigs.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.collect_list(F.struct("signature", "n"))).scalar()
    rows = counts.withColumn("every", every).select(
        F.col("signature").alias("sa"), F.col("n").alias("na"), F.explode("every").alias("o")).select(
        "sa", "na", F.col("o.signature").alias("sb"), F.col("o.n").alias("nb")).filter("sa <= sb")
    same = F.floor(F.col("na") * (F.col("na") - 1) / 2)
    return rows.select("sa", "sb", F.when(F.col("sa") == F.col("sb"), same).otherwise(F.col("na") * F.col("nb"))
                       .cast("long").alias("pairs"))


def random_pair_jaccard(sigs: DataFrame) -> DataFrame:
    """Mean agreement of all unordered pairs of wafers, from the counts of their label sets."""
    pairs = F.col("pairs").cast("double")
    return signature_pairs(sigs).agg(
        F.coalesce(F.sum(pairs * label_jaccard(F.col("sa"), F.col("sb"))) / F.sum(pairs), F.lit(0.0))
        .alias("random_pair_label_jaccard"), F.sum(pairs).alias("pair_count"))


def label_lift(neighbors: DataFrame, sigs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean neighbour agreement over the mean agreement of random pairs, optionally per search space."""
    chance = random_pair_jaccard(sigs).select("random_pair_label_jaccard")
    near = with_signatures(neighbors, sigs).groupBy(*by).agg(F.avg("jaccard").alias("mean_neighbor_label_jaccard"))
    return near.withColumn("random_pair_label_jaccard", chance.scalar()).withColumn(
        "lift", F.col("mean_neighbor_label_jaccard") / F.greatest(F.col("random_pair_label_jaccard"), F.lit(FLOOR)))


def class_hits(neighbors: DataFrame, labels: DataFrame, classes: tuple[str, ...], by: tuple[str, ...] = (),
               id_col: str = "sample_id") -> DataFrame:
    """Per class and positive query: share of positive neighbours, any hit, reciprocal rank of the first."""
    flags = F.array(*[F.col(f"label_{c}") for c in classes])
    q = labels.select(F.col(id_col).alias("query_id"), flags.alias("q"))
    n = labels.select(F.col(id_col).alias("neighbor_id"), flags.alias("n"))
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("class_name"), F.col("q"), F.col("n"))
    rows = (neighbors.join(q, "query_id").join(n, "neighbor_id")
            .select(*by, "query_id", "rank", F.explode(pairs).alias("p"))
            .select(*by, "query_id", "rank", F.col("p.class_name"), F.col("p.q").alias("q"), F.col("p.n").alias("n"))
            .filter(F.col("q") == 1))
    return rows.groupBy(*by, "class_name", "query_id").agg(
        F.avg("n").alias("precision"), F.max("n").alias("hit"),
        F.coalesce(1.0 / F.min(F.when(F.col("n") == 1, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"))


def class_base_rates(labels: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    wide = labels.agg(F.array(*[F.struct(F.lit(c).alias("class_name"), F.sum(f"label_{c}").alias("positives"),
                                         F.count(F.lit(1)).alias("n")) for c in classes]).alias("x"))
    return wide.select(F.explode("x").alias("x")).select("x.*").withColumn(
        "base_rate", safe_div(F.col("positives"), F.col("n")))


def class_metrics(neighbors: DataFrame, labels: DataFrame, classes: tuple[str, ...],
                  by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, base rate, lift, hit rate and MRR per class over the queries that carry the class."""
    found = class_hits(neighbors, labels, classes, by).groupBy(*by, "class_name").agg(
        F.avg("precision").alias("precision_at_k"), F.avg("hit").alias("hit_rate_at_k"),
        F.avg("reciprocal_rank").alias("mrr"))
    rates = class_base_rates(labels, classes)
    if by:
        grid = neighbors.select(*by).distinct().withColumn("class_name", F.explode(F.array(*map(F.lit, classes))))
        rates = grid.join(rates, "class_name")
    zero = F.lit(0.0)
    return (rates.join(found, [*by, "class_name"], "left")
            .select(*by, "class_name", F.col("positives").alias("positive_queries"), "base_rate",
                    F.coalesce("precision_at_k", zero).alias("precision_at_k"),
                    (F.coalesce("precision_at_k", zero) / F.greatest("base_rate", F.lit(FLOOR))).alias("lift"),
                    F.coalesce("hit_rate_at_k", zero).alias("hit_rate_at_k"), F.coalesce("mrr", zero).alias("mrr")))


# fixed values: target kinds in report order
TARGET_KINDS = ("class", "class_radial", "class_location", "feature_key")


def target_rows(regions: DataFrame) -> DataFrame:
    """Four target keys per defect region."""
    c = F.col("class_name")
    keys = F.array(*[F.struct(F.lit(kind).alias("target_kind"), value.alias("target_id")) for kind, value in (
        ("class", c), ("class_radial", F.concat_ws("__", c, F.col("radial_zone"))),
        ("class_location", F.concat_ws("__", c, F.col("location_label"))), ("feature_key", F.col("feature_key")))])
    return regions.select("sample_id", "class_name", F.explode(keys).alias("k")).select("sample_id", "class_name", "k.*")


def targets(regions: DataFrame, samples: DataFrame, min_support: int) -> DataFrame:
    """Targets carried by at least ``min_support`` and not all wafers, with their most frequent class."""
    rows = target_rows(regions).join(samples.select("sample_id").distinct(), "sample_id", "left_semi")
    per_class = rows.groupBy("target_kind", "target_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    cls = per_class.groupBy("target_kind", "target_id").agg(
        F.min_by("class_name", F.struct(-F.col("n"), F.col("class_name"))).alias("class_name"))
    support = (rows.select("target_kind", "target_id", "sample_id").distinct()
               .groupBy("target_kind", "target_id").agg(F.count(F.lit(1)).alias("support")))
    total = samples.agg(F.countDistinct("sample_id").alias("n")).scalar()
    return (support.join(cls, ["target_kind", "target_id"])
            .filter((F.col("support") >= min_support) & (F.col("support") < total)))


def target_members(regions: DataFrame, chosen: DataFrame) -> DataFrame:
    return (target_rows(regions).select("target_kind", "target_id", "sample_id").distinct()
            .join(chosen.select("target_kind", "target_id"), ["target_kind", "target_id"], "left_semi"))


def target_neighbor_rows(regions: DataFrame, chosen: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Neighbours of every positive query of each target; the search space is the class and kind of the target."""
    members = target_members(regions, chosen)
    keys = ["target_kind", "target_id"]
    queries = members.withColumnRenamed("sample_id", "query_id").join(chosen.select(*keys, "class_name"), keys)
    space = F.concat_ws("|", "class_name", F.when(F.col("target_kind").isin(*nm.LOCATION_KINDS), "location")
                        .otherwise("plain"))
    hits = members.select(*keys, F.col("sample_id").alias("neighbor_id"), F.lit(1).alias("neighbor_has_target"))
    return (queries.withColumn("space", space).join(neighbors, ["space", "query_id"])
            .join(hits, [*keys, "neighbor_id"], "left").fillna(0, ["neighbor_has_target"]).drop("space"))


def target_metrics(rows: DataFrame, chosen: DataFrame, samples: DataFrame) -> DataFrame:
    """Retrieval quality per target against drawing a random other wafer."""
    keys = ["target_kind", "target_id"]
    per_query = rows.groupBy(*keys, "query_id").agg(
        F.avg("neighbor_has_target").alias("precision"), F.max("neighbor_has_target").alias("hit"),
        F.coalesce(1.0 / F.min(F.when(F.col("neighbor_has_target") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"))
    total = samples.agg(F.countDistinct("sample_id").alias("n")).scalar()
    return (per_query.groupBy(*keys).agg(F.avg("precision").alias("precision_at_k"),
                                         F.avg("hit").alias("hit_rate_at_k"), F.avg("rr").alias("mrr"))
            .join(chosen, keys)
            .withColumn("random_precision", (F.col("support") - 1) / F.greatest(total - 1, F.lit(1)))
            .withColumn("lift", F.col("precision_at_k") / F.greatest("random_precision", F.lit(FLOOR)))
            .select(*keys, "class_name", "support", "random_precision", "precision_at_k", "lift", "hit_rate_at_k",
                    "mrr"))


def kind_summary(metrics: DataFrame) -> DataFrame:
    """Support-weighted means per target kind; a kind without targets has a zero row."""
    def mean(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name) * F.col("support")) / F.sum("support"), F.lit(0.0)).alias(f"mean_{name}")
    kinds = metrics.sparkSession.createDataFrame([(k,) for k in TARGET_KINDS], "target_kind string")
    return kinds.join(metrics, "target_kind", "left").groupBy("target_kind").agg(
        F.count("target_id").alias("target_count"), mean("lift"), mean("precision_at_k"), mean("hit_rate_at_k"))


def family_ablation(features: DataFrame, columns: list[str], sigs: DataFrame, k: int) -> DataFrame:
    """Lift lost when one family of features is left out of the search; all searches run as one job."""
    spaces = {"baseline": columns}
    for family, members in nm.family_map(columns).items():
        kept = [c for c in columns if c not in members]
        if kept:
            spaces[family] = kept
    lifts = label_lift(search.neighbors_in_spaces(features, spaces, k), sigs, by=("space",))
    base = lifts.filter(F.col("space") == "baseline").select("lift").scalar()
    sizes = features.sparkSession.createDataFrame(
        [(s, len(columns) - len(c), len(c)) for s, c in spaces.items() if s != "baseline"],
        "removed_family string, removed_feature_count int, remaining_feature_count int")
    return (sizes.join(lifts.withColumnRenamed("space", "removed_family"), "removed_family")
            .select("removed_family", "removed_feature_count", "remaining_feature_count",
                    F.col("lift").alias("jaccard_lift"), (base - F.col("lift")).alias("lift_delta_vs_baseline")))


def neighbor_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Share of a query's neighbours that the other search also found, averaged over the queries."""
    both = right.select("query_id", "neighbor_id").distinct().withColumn("shared", F.lit(1))
    return (left.join(both, ["query_id", "neighbor_id"], "left")
            .groupBy("query_id").agg((F.count("shared") / F.count(F.lit(1))).alias("overlap"))
            .agg(F.avg("overlap").alias("mean_neighbor_overlap"), F.count(F.lit(1)).alias("queries")))


def query_scores(neighbors: DataFrame, sigs: DataFrame) -> DataFrame:
    return with_signatures(neighbors, sigs).groupBy("query_id").agg(F.avg("jaccard").alias("score"))


def bootstrap_lift(neighbors: DataFrame, sigs: DataFrame, runs: int, seed: int) -> DataFrame:
    """2.5 and 97.5 percent bounds of the lift over resampled queries and resampled pairs.

    Drawing n values with replacement is a multinomial draw over the distinct values, and an agreement of a few label
    sets takes few distinct values; so a run needs the value counts only, and the runs spread over the cluster.
    """
    q = query_scores(neighbors, sigs).groupBy(F.round("score", 9).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    p = (signature_pairs(sigs).groupBy(F.round(label_jaccard(F.col("sa"), F.col("sb")), 9).alias("v"))
         .agg(F.sum("pairs").alias("n")))

    def packed(df: DataFrame) -> Column:
        return df.agg(F.array_sort(F.collect_list(F.struct("v", "n")))).scalar()

    @F.pandas_udf("double")
    def resampled_mean(run: pd.Series, values: pd.Series, sizes: pd.Series, stream: pd.Series) -> pd.Series:
        out = np.zeros(len(run))
        for i, r in enumerate(run):
            v, n = np.asarray(values.iloc[i], dtype=float), np.asarray(sizes.iloc[i], dtype=np.int64)
            total = int(n.sum())
            if total:
                rng = np.random.default_rng([seed, int(stream.iloc[i]), int(r)])
                out[i] = float(rng.multinomial(total, n / total) @ v) / total
        return pd.Series(out)

    draws = (neighbors.sparkSession.range(runs).withColumnRenamed("id", "run")
             .withColumns({"q": packed(q), "p": packed(p)})
             .select("run", resampled_mean("run", F.col("q.v"), F.col("q.n"), F.lit(1)).alias("near"),
                     resampled_mean("run", F.col("p.v"), F.col("p.n"), F.lit(2)).alias("chance"))
             .withColumn("lift", F.col("near") / F.greatest("chance", F.lit(FLOOR))))
    bounds = []
    for name, col in (("neighbor_mean", "near"), ("random_mean", "chance"), ("lift", "lift")):
        bounds += [F.percentile(col, F.lit(0.025)).alias(f"{name}_ci_low"),
                   F.percentile(col, F.lit(0.975)).alias(f"{name}_ci_high")]
    return draws.agg(*bounds)


def _shuffled_position(position: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """A keyed one-to-one map of 0..size-1 onto itself: a four-round Feistel network with cycle walking."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def once(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for r in range(4):
            mixed = (right + k + np.uint64(0x9E3779B97F4A7C15) * np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & low)
        return (left << np.uint64(half)) | right

    x, k = position.astype(np.uint64), key.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = once(x, k)
        while True:
            outside = x >= np.uint64(size)
            if not outside.any():
                return x.astype(np.int64)
            x[outside] = once(x[outside], k[outside])


def relabelled(position: np.ndarray, run: int, seed: int, ends: np.ndarray) -> np.ndarray:
    """Which label set the wafers at these row positions get in a run.

    A relabelling hands the table's label sets out anew. Laid out set by set, set i holds the places up to ``ends[i]``; a wafer
    goes to the place that the run's permutation gives its own, so nothing has to be looked up.
    """
    with np.errstate(over="ignore"):
        key = (np.uint64(run) + np.uint64(1)) * np.uint64(2654435761) + np.uint64(seed)
    return np.searchsorted(ends, _shuffled_position(position, np.full(len(position), key), int(ends[-1])), side="right")


def permutation_p_value(neighbors: DataFrame, sigs: DataFrame, runs: int, seed: int) -> DataFrame:
    """How often relabelled wafers agree with their neighbours at least as well as the real labels do.

    A pair of neighbours carries its two row positions; the task that holds it works out both ends' label sets in every run and
    adds up the agreement per run, so a run costs no row. Agreements are counted in whole parts, sums are exact.
    """
    sets = sigs.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).orderBy("signature").collect()  # at most 2^classes
    spark = sigs.sparkSession
    if not sets:
        return spark.createDataFrame([], "p_value double, runs long")
    ends = np.cumsum([r["n"] for r in sets])
    values = [int(r["signature"]) for r in sets]
    parts = math.lcm(*range(1, max(2, max(v.bit_length() for v in values) + 1)))
    agree = np.array([[parts * bin(x & y).count("1") // bin(x | y).count("1") if x | y else parts for y in values] for x in values], np.int64)
    indexed = row_index(sigs.select("id"), ["id"])
    pairs = (neighbors.join(indexed.select(F.col("id").alias("query_id"), F.col("idx").alias("qi")), "query_id")
             .join(indexed.select(F.col("id").alias("neighbor_id"), F.col("idx").alias("ni")), "neighbor_id").select("qi", "ni"))
    observed = with_signatures(neighbors, sigs).agg(F.sum(F.round(F.col("jaccard") * parts)).cast("long")).scalar()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(runs, np.int64)
        for batch in batches:
            ends_of = [np.unique(batch.column(c).to_numpy(), return_inverse=True) for c in ("qi", "ni")]  # a wafer is relabelled once a batch
            for run in range(runs):
                (q, n) = (relabelled(ids, run, seed, ends)[at] for ids, at in ends_of)
                totals[run] += int(agree[q, n].sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(runs), pa.int32()), pa.array(totals)], ["run", "total"])

    sums = pairs.mapInArrow(count, "run int, total long").groupBy("run").agg(F.sum("total").alias("total"))
    return sums.agg(((F.count_if(F.col("total") >= observed) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("runs"))


def embedding_metrics(found: DataFrame, sigs: DataFrame, queries: DataFrame, references: DataFrame,
                      same_table: bool = True) -> DataFrame:
    """Top-1, best and mean agreement of embedding neighbours, against one fixed other reference per query."""
    near = with_signatures(found, sigs).groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("jaccard"))).alias("top1"), F.max("jaccard").alias("best"),
        F.avg("jaccard").alias("mean"))
    q = row_index(queries.select(F.col("id").alias("query_id")), ["query_id"], "qi")
    r = row_index(references.select(F.col("id").alias("neighbor_id")), ["neighbor_id"], "ri")
    m = references.count()
    # position among the references other than the query itself; with one reference it is that one
    own = q.join(r.withColumnRenamed("neighbor_id", "query_id"), "query_id", "left")
    others = F.when(F.col("ri").isNotNull() & F.lit(m > 1), m - 1).otherwise(m)
    slot = F.pmod(F.col("qi") * 997 + 17, others)
    picked = own.select("query_id", F.when(F.col("ri").isNotNull() & F.lit(m > 1) & (slot >= F.col("ri")), slot + 1)
                        .otherwise(slot).alias("ri"))
    chance = with_signatures(picked.join(r, "ri"), sigs).select("query_id", F.col("jaccard").alias("chance"))
    return near.join(chance, "query_id").agg(
        F.avg("top1").alias("top1_mean_jaccard"), F.avg("best").alias("topk_best_mean_jaccard"),
        F.avg("mean").alias("topk_mean_jaccard"), F.avg("chance").alias("baseline_mean_jaccard"),
        ((F.avg("top1") + FLOOR) / (F.avg("chance") + FLOOR)).alias("lift_vs_baseline"))


def label_covering_rows(labels: DataFrame, classes: tuple[str, ...], limit: int) -> DataFrame:
    """The first not yet chosen positive of every class in turn, then further wafers by id, ``limit`` in all.

    Class by class at most ``len(classes)`` wafers are chosen before, so only that many first positives per class can
    matter; these few rows settle the choice.
    """
    depth = len(classes)
    flags = F.array(*[F.struct(F.lit(i).alias("ci"), F.col(f"label_{c}").alias("f")) for i, c in enumerate(classes)])
    firsts = (labels.select("sample_id", F.explode(flags).alias("x")).filter("x.f = 1")
              .select("sample_id", F.col("x.ci").alias("ci"))
              .withColumn("place", F.row_number().over(Window.partitionBy("ci").orderBy("sample_id")))
              .filter(F.col("place") <= depth).collect())
    chosen: list[str] = []
    for ci in range(depth):
        if len(chosen) >= limit:
            break
        for row in sorted((r for r in firsts if r["ci"] == ci), key=lambda r: r["place"]):
            if row["sample_id"] not in chosen:
                chosen.append(row["sample_id"])
                break
    order = F.array_position(F.array(*[F.lit(c) for c in chosen]).cast("array<string>"), F.col("sample_id"))
    return (labels.select("sample_id", order.alias("o"))
            .select("sample_id", F.when(F.col("o") > 0, F.col("o")).otherwise(F.lit(depth + 1)).alias("o"))
            .orderBy("o", "sample_id").limit(limit)
            .withColumn("position", F.row_number().over(Window.orderBy("o", "sample_id"))).drop("o"))
