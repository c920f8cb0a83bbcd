"""Mixing groups of review text to target weights: whole comments are picked so that each group comes near its budget.

Every group (a product, a lot, a source) gets a target in words. The comments of a group are counted by exact length; a
bulk of whole rounds and proportional shares is taken first, the rest of the budget is filled by a bounded knapsack over
the counts that are left. Which comments of a length are taken is settled by a seeded hash, so reruns agree.

Only lengths and counts are planned per group, never comments. The comments of one length in one group may be a third of
the table: they are cut into hash buckets, whole buckets are taken by count, and only the bucket at the edge is ranked.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siliscope.llm.common import WORD, text_of
from siliscope.sources.staging import stage

BUCKETS = 256
#: a rest of the budget beyond this many words is first brought down greedily, so the table of sums stays this small
KNAPSACK_WORDS = 1 << 17


def source_targets(totals: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                   most: float = 2.0) -> dict[str | None, float]:
    """Words to take from each group: ``share`` of all words by weight, at most ``most`` times what the group has.

    Weights repeat over the groups in code point order, null last. What a capped group cannot hold is shared again by
    weight among the others until none is above its cap.
    """
    names = sorted((x for x in totals if x is not None), key=lambda x: x.encode()) + [None] * (None in totals)
    weight = {x: float(weights[i % len(weights)]) for i, x in enumerate(names)}
    cap = {x: most * totals[x] for x in names}
    target, free, left = {}, set(names), share * sum(totals.values())
    while free:
        unit = left / sum(weight[x] for x in names if x in free)
        over = [x for x in names if x in free and weight[x] * unit > cap[x]]
        if not over:
            return target | {x: weight[x] * unit for x in names if x in free}
        for x in over:
            target[x] = cap[x]
            free.discard(x)
            left -= cap[x]
    return target


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many comments of each length to take, each at most once, so that the words come as near the budget as can be.

    Takes the same share of every length, brings the rest below the knapsack's size with the longest that fit, and fills
    it by bounded dynamic programming over the counts left.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    goal = int(min(total, round(budget)))
    if goal <= 0:
        return np.zeros(len(sizes), np.int64)
    take = (counts * (goal / total)).astype(np.int64)
    rest = goal - int((take * sizes).sum())
    while rest < 0:  # the share was rounded up in the last digit
        i = int(np.flatnonzero(take)[0])
        take[i] -= 1
        rest += int(sizes[i])
    long_first = np.argsort(-sizes, kind="stable")
    for i in long_first:
        over = rest - KNAPSACK_WORDS // 2
        if over <= 0:
            break
        more = int(min(counts[i] - take[i], over // sizes[i]))
        take[i] += more
        rest -= more * int(sizes[i])
    return take + _knapsack(sizes, counts - take, rest)


def _knapsack(sizes: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the largest reachable sum within the budget or, if nearer, the smallest one beyond it."""
    most = budget + (int(sizes[left > 0].min()) if (left > 0).any() else 0)
    via = np.full(most + 1, -1, np.int64)  # the length by which a sum was first reached
    via[0] = len(sizes)
    used = np.zeros(most + 1, np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size, n = int(sizes[i]), int(left[i])
        if n <= 0 or size > most or via[budget] >= 0:
            continue
        used[:] = 0
        for lo in range(size, most + 1, size):  # each step continues sums reached one comment earlier
            hi = min(lo + size, most + 1)
            new = (via[lo:hi] < 0) & (via[lo - size:lo - size + hi - lo] >= 0) & (used[lo - size:lo - size + hi - lo] < n)
            at = np.flatnonzero(new) + lo
            via[at], used[at] = i, used[at - size] + 1
    reached = np.flatnonzero(via >= 0)
    best = int(reached[np.argmin(np.abs(reached - budget))])
    take = np.zeros(len(sizes), np.int64)
    while best:
        i = int(via[best])
        take[i] += 1
        best -= int(sizes[i])
    return take


def words_of(comment: str) -> Column:
    """Length of a comment in words; a missing one has none."""
    return F.regexp_count(text_of(comment), F.lit(WORD)).cast("long")


def mix(reviews: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17,
        review_case_id: str = "review_case_id", group: str = "product", comment: str = "safe_comment") -> DataFrame:
    """Words to take of every comment so that the groups meet their target weights.

    Returns one row per input row: the id, the group, ``size`` (words), ``source_size`` and ``target`` of its group and
    ``taken``: 0, size or up to ``most`` times size. A missing comment is empty; a comment without words is never
    taken. A null group is a group of its own, last in order. Repeated rows are taken each for itself, ties of the seeded
    hash go to the smaller id. An empty table gives no rows. Groups are as few as the weights' table is: their totals go to the driver.
    """
    # staged: hash ranks of equal rows must not be dealt anew when a task is repeated
    rows = stage(reviews.select(
        F.col(review_case_id).alias("id"), F.col(group).cast("string").alias("grp"),
        words_of(comment).alias("size"),
        F.xxhash64(F.lit(seed), F.col(review_case_id), F.col(group)).alias("h")), slim=True)
    hist = stage(rows.groupBy("grp", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = {r.grp: int(r.total) for r in hist.groupBy("grp").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()}
    targets = source_targets(totals, weights, share, most)

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        grp = part["grp"].iloc[0]
        grp = None if pd.isna(grp) else grp
        whole = totals[grp]
        rounds = int(min(most, targets[grp] // whole)) if whole else 0
        words = part["size"].to_numpy() > 0
        extra = np.zeros(len(part), np.int64)
        if whole and rounds < most:
            extra[words] = fit_counts(part["size"].to_numpy()[words], part["n"].to_numpy()[words], targets[grp] - rounds * whole)
        return pd.DataFrame({"grp": part["grp"], "size": part["size"], "rounds": np.where(words, rounds, 0), "extra": extra,
                             "source_size": whole, "target": float(targets[grp])})

    planned = hist.groupBy("grp").applyInPandas(
        plan, "grp string, size long, rounds long, extra long, source_size long, target double")
    cut = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(BUCKETS)).cast("int"))
    edges = Window.partitionBy("grp", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = cut.groupBy("grp", "size", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(edges), F.lit(0)))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    quota = quota.alias("q").join(planned.alias("p"), same(quota, planned, ("grp", "size"))).select(
        "q.grp", "q.size", "q.bucket", "rounds", "source_size", "target", "n",
        F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("quota"))
    met = cut.alias("c").join(quota.alias("q"), same(cut, quota, ("grp", "size", "bucket"))).select(
        "id", "c.grp", "c.size", "c.bucket", "h", "rounds", "source_size", "target", "n", "quota")
    whole = met.filter("quota = 0 OR quota = n").withColumn("more", F.when(F.col("quota") > 0, 1).otherwise(0))
    rank = F.row_number().over(Window.partitionBy("grp", "size", "bucket").orderBy("h", "id"))
    partly = met.filter("quota > 0 AND quota < n").withColumn("more", F.when(rank <= F.col("quota"), 1).otherwise(0))
    return whole.unionByName(partly).select(
        F.col("id").alias(review_case_id), F.col("grp").alias(group), "size", "source_size", "target",
        (F.col("size") * (F.col("rounds") + F.col("more"))).alias("taken"))
