"""Separation scores, detection counts and losses over long tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siliscope.functions.columns import safe_div
from siliscope.operators.ordering import running_totals

EPS = 1e-6


def class_auc(values: DataFrame, classes: tuple[str, ...], keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """ROC AUC of a value for every class flag, ties counted half, by ranks.

    ``values`` holds the keys, ``v`` and one 0/1 column per class. Equal values are counted together first, so the
    order statistics run over distinct values, spread over the cluster, whatever the size of one feature.
    """
    counts = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(c) for c in classes])
    placed = running_totals(counts, list(keys), ["v"], ["n", *classes])
    wins = [F.sum(F.col(c) * ((F.col("n_before") - F.col(f"{c}_before")) + (F.col("n") - F.col(c)) / 2.0)).alias(f"w_{c}")
            for c in classes]
    sums = placed.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(f"p_{c}") for c in classes], *wins)
    rows = F.array(*[F.struct(F.lit(c).alias("class_name"), F.col(f"p_{c}").alias("positives"),
                              (F.col("n") - F.col(f"p_{c}")).alias("negatives"), F.col(f"w_{c}").alias("wins")) for c in classes])
    out = sums.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    pairs = F.col("positives") * F.col("negatives")
    return out.withColumn("auc", F.when(pairs == 0, F.lit(0.5)).otherwise(F.col("wins") / pairs)).drop("wins")


def group_auc(values: DataFrame, group: str, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """ROC AUC of a value for each group against all others; ``values`` holds the keys, ``v`` and the group as a column.

    Values are ranked once, whatever the number of groups; a group's wins follow from the ranks of its own values.
    """
    own = values.groupBy(*keys, group, "v").agg(F.count(F.lit(1)).alias("p"))
    ranked = own.join(mid_ranks(values, list(keys)).drop("n"), [*keys, "v"])
    sums = ranked.groupBy(*keys, group).agg(F.sum("p").alias("positives"), F.sum(F.col("p") * F.col("mid_rank")).alias("ranks"))
    totals = own.groupBy(*keys).agg(F.sum("p").alias("n"))
    p, n = F.col("positives"), F.col("n") - F.col("positives")
    wins = F.col("ranks") - p * (p + 1) / 2.0
    return sums.join(totals, list(keys)).select(*keys, F.col(group).alias("class_name"), "positives", n.alias("negatives"),
                                                F.when(p * n == 0, F.lit(0.5)).otherwise(wins / (p * n)).alias("auc"))


def mid_ranks(values: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values per key with the mean rank their rows share."""
    counts = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, keys, ["v"], ["n"]).select(
        *keys, "v", "n", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("mid_rank"))


def separation_score(values: DataFrame, classes: tuple[str, ...], keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Between-class over within-class variance of a value, zero with fewer than two rows in a class."""
    flags = F.array(*[F.struct(F.lit(c).alias("class_name"), F.col(c).alias("f")) for c in classes])
    rows = values.select(*keys, "v", F.explode(flags).alias("x")).select(*keys, "v", "x.*")
    m = rows.groupBy(*keys, "class_name").agg(
        F.avg("v").alias("grand"), F.count(F.lit(1)).alias("n"),
        *[f(F.when(F.col("f") == k, F.col("v"))).alias(f"{name}{k}")
          for k in (0, 1) for f, name in ((F.count, "n"), (F.avg, "m"), (F.var_pop, "s"))])
    between = sum((F.col(f"n{k}") * F.pow(F.col(f"m{k}") - F.col("grand"), 2) for k in (0, 1)), F.lit(0.0))
    within = F.col("n0") * F.col("s0") + F.col("n1") * F.col("s1")
    score = between / F.greatest(within / F.greatest(F.col("n") - 2, F.lit(1)), F.lit(1e-9))
    return m.select(*keys, "class_name", F.when((F.col("n0") < 2) | (F.col("n1") < 2), F.lit(0.0)).otherwise(score)
                    .alias("discriminability_score"))


def top_features(values: DataFrame, classes: tuple[str, ...], top: int = 8) -> DataFrame:
    """The features that best separate each class, by AUC of the better direction, then by separation."""
    auc = class_auc(values, classes).filter((F.col("positives") >= 2) & (F.col("negatives") >= 2))
    joined = auc.join(separation_score(values, classes), ["feature", "class_name"]).withColumns({
        "direction": F.when(F.col("auc") >= 0.5, "high").otherwise("low"),
        "auc": F.greatest(F.col("auc"), 1.0 - F.col("auc"))})
    order = Window.partitionBy("class_name").orderBy(F.round("auc", 9).desc(), F.round("discriminability_score", 6).desc(), "feature")
    return joined.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def confusion(rows: DataFrame, by: tuple[str, ...] = ("class_name",)) -> DataFrame:
    """Counts and rates per class; ``rows`` hold 0/1 columns ``truth`` and ``pred``."""
    tp = F.count_if((F.col("truth") == 1) & (F.col("pred") == 1))
    fp = F.count_if((F.col("truth") == 0) & (F.col("pred") == 1))
    fn = F.count_if((F.col("truth") == 1) & (F.col("pred") == 0))
    return rows.groupBy(*by).agg(
        F.count_if(F.col("truth") == 1).alias("positives"), F.count_if(F.col("pred") == 1).alias("predicted"),
        safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"), safe_div(tp, tp + fp + fn).alias("iou"))


def cross_entropy(y: Column, p: Column, weight: Column | None = None) -> Column:
    positive = y * F.log(p + EPS)
    return -((positive if weight is None else weight * positive) + (1.0 - y) * F.log(1.0 - p + EPS))


def positive_weight(prevalence: Column) -> Column:
    p = F.least(F.greatest(prevalence, F.lit(EPS)), F.lit(1.0))
    return F.least((1.0 - p) / p, F.lit(50.0))


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))


def mask_detection(pixels: DataFrame, truth: str, pred: str) -> DataFrame:
    """IoU, recall and precision of a predicted mask, averaged over the wafers where each is defined."""
    t, p = F.col(truth) > 0, F.col(pred) > 0
    per = pixels.groupBy("sample_id").agg(F.count_if(t & p).alias("both"), F.count_if(t | p).alias("either"),
                                          F.count_if(t).alias("t"), F.count_if(p).alias("p"))

    def mean(den: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col(den) > 0, F.col("both") / F.col(den))), F.lit(1.0))
    return per.agg(mean("either").alias("mean_iou"), mean("t").alias("mean_recall"), mean("p").alias("mean_precision"))


def score_uncertainty(probs: Column, names: tuple[str, ...]) -> dict[str, Column]:
    """Mean binary entropy, margin of the two best, best label and review priority of a probability array."""
    clipped = F.transform(probs, lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1.0 - 1e-6)))
    total = F.aggregate(clipped, F.lit(0.0), lambda acc, p: acc - (p * F.log(p) + (1.0 - p) * F.log(1.0 - p)))
    entropy = total / F.size(probs)
    ordered = F.sort_array(probs, asc=False)
    margin = F.when(F.size(probs) > 1, ordered[0] - F.get(ordered, F.lit(1))).otherwise(ordered[0])
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(probs, F.array_max(probs)).cast("int"))
    return {"mean_binary_entropy": entropy, "confidence_margin": margin, "top_label": label,
            "top_probability": F.array_max(probs), "review_priority": review_priority(F.array_max(probs), margin, entropy)}


def review_priority(top: Column, margin: Column, entropy: Column) -> Column:
    return (F.when((entropy >= 0.60) | (margin < 0.10), "review_high_uncertain")
            .when(top >= 0.75, "review_high_strong_synthetic_match").otherwise("review_medium"))


def readiness_issues(val_samples: DataFrame, per_class: DataFrame, bce: DataFrame, minimum: int = 10) -> DataFrame:
    """What speaks against a trained model: few validation wafers, classes without positives, no finite loss."""
    few = val_samples.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < minimum).select(F.lit("few validation samples").alias("issue"))
    empty = per_class.filter(F.col("positives") == 0).select(F.concat(F.lit("no positives: "), "class_name").alias("issue"))
    value = F.col("bce")
    odd = bce.filter(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).select(F.lit("loss not finite").alias("issue"))
    return few.unionByName(empty).unionByName(odd)
