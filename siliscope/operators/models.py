"""Models with a fit step: projections, clusters and their stability, encoder, segmentation, score forests.

Weights and other small fixed-size results live on the driver between steps; the rows never do.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siliscope.functions.columns import TWO_PI
from siliscope.operators import search
from siliscope.operators.statistics import EPS, class_auc, cross_entropy, sigmoid
from siliscope.sources.staging import stage


def pca(points: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """(id, coords) of standardised points on their leading components, and the explained shares."""
    rows = points.withColumn("features", array_to_vector("vec"))
    model = PCA(k=k, inputCol="features", outputCol="projected").fit(rows)
    coords = model.transform(rows).select("id", vector_to_array("projected").alias("coords"))
    return coords, [float(v) for v in model.explainedVariance.toArray()]


#: columns of the basis beside those asked for, and the change of the leading values at which it counts as settled
SPARE, SETTLED = 8, 1e-10


def leading_axes(vectors: DataFrame, k: int, passes: int = 40, seed: int = 20260618) -> tuple[np.ndarray, np.ndarray]:
    """(axes in columns, explained shares) of centred vectors (vec) of any width, by a randomised range finder.

    A random basis of k and some spare columns is multiplied by X'X pass after pass and made orthonormal anew, until the leading
    values settle; each pass adds up X'(XQ) over the tasks. The driver holds some matrices as wide as a vector and as long as
    the basis has columns, never one that grows with the square of the width. The largest entry of an axis is positive.
    """
    rows = stage(vectors.select("vec"))
    first = rows.agg(F.max(F.size("vec")).alias("d"), F.sum(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).alias("total")).first()
    if first["d"] is None or not first["total"]:
        return np.zeros((first["d"] or 0, 0)), np.zeros(0)
    d, total = first["d"], first["total"]
    columns = min(d, k + SPARE)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, columns)))[0]
    values = np.zeros(columns)
    for _ in range(passes):
        held = rows.sparkSession.sparkContext.broadcast(basis)

        def step(pdf: pd.DataFrame, held=held) -> np.ndarray:
            x = np.stack(pdf["vec"])
            y = x @ held.value
            return np.concatenate([(x.T @ y).ravel(), (y.T @ y).ravel()])

        sums = _tree_sum(rows, step)
        held.destroy()
        image, inner = sums[:d * columns].reshape(d, columns), sums[d * columns:].reshape(columns, columns)
        was, (values, turn) = values, np.linalg.eigh(inner)
        values, axes = values[::-1], basis @ turn[:, ::-1]
        if np.abs(values[:k] - was[:k]).max() <= SETTLED * values[0]:
            break
        basis = np.linalg.qr(image)[0]
    kept = [i for i in range(min(k, columns)) if values[i] > 1e-12 * values[0]]
    axes = axes[:, kept]
    return axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(kept))]), values[kept] / total


def pca_embedding(vectors: DataFrame, k: int) -> DataFrame:
    """(id, vec): unit-length projections of flattened tensors on their leading axes, flat positions left unscaled."""
    rows = stage(search.standardised_vectors(vectors, flat_as_one=True).select("id", "vec"))
    axes = rows.sparkSession.sparkContext.broadcast(leading_axes(rows, k)[0])

    @F.pandas_udf("array<double>")
    def project(vec: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vec) @ axes.value)) if len(vec) else pd.Series([], dtype=object)

    return rows.select("id", project("vec").alias("vec")).select("id", search.unit_vector(F.col("vec")).alias("vec"))


def kmeans_spaces(points: DataFrame, k: int | dict[str, int], seed: int, iterations: int = 80) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Cluster every space of (space, id, vec) on its own, all in the same passes: (space, id, cluster_id, distance), the centres.

    ``k`` is one number or one per space. A space of fewer than k rows gets as many clusters as rows. Starts and replacements of empty clusters come from a
    small pool per space, drawn by a keyed hash; a pass ends with sums per space and cluster, whatever the number of rows.
    """
    most = k if isinstance(k, int) else max(k.values())
    draw = F.xxhash64(F.lit(seed), "space", "id")
    place = F.row_number().over(Window.partitionBy("space").orderBy(draw, "id"))
    pool: dict[str, list] = {}
    for r in points.withColumn("place", place).filter(F.col("place") <= 4 * most).orderBy("space", "place").collect():  # so many rows per space
        pool.setdefault(r["space"], []).append(np.array(r["vec"], dtype=float))
    centers = {s: np.stack(rows[:k if isinstance(k, int) else k[s]]) for s, rows in pool.items()}
    spaces = sorted(centers)
    at, pos = {}, 0
    for s in spaces:
        at[s] = pos
        pos += centers[s].shape[0] * (centers[s].shape[1] + 1)
    size = pos

    for turn in range(iterations):
        now = centers

        def sums(pdf: pd.DataFrame, now=now) -> np.ndarray:
            out = np.zeros(size)
            for s, rows in pdf.groupby("space"):
                x, c = np.stack(rows["vec"]), now[s]
                label = _nearest_center(x, c)[0]
                part = out[at[s]:at[s] + c.shape[0] * (c.shape[1] + 1)].reshape(c.shape[0], -1)
                np.add.at(part[:, 1:], label, x)
                part[:, 0] += np.bincount(label, minlength=len(c))
            return out

        total = _tree_sum(points.select("space", "vec"), sums)
        moved = {}
        for s in spaces:
            c = now[s]
            part = total[at[s]:at[s] + c.shape[0] * (c.shape[1] + 1)].reshape(c.shape[0], -1)
            fresh = np.stack([pool[s][(turn * 7 + i + most) % len(pool[s])] for i in range(len(c))])
            moved[s] = np.where(part[:, :1] > 0, part[:, 1:] / np.maximum(part[:, :1], 1), fresh)
        settled = all(np.abs(moved[s] - now[s]).max() <= 1e-12 for s in spaces)
        centers = moved
        if settled:
            break
    final = centers

    def assign(batches):
        for pdf in batches:
            for s, rows in pdf.groupby("space"):
                label, distance = _nearest_center(np.stack(rows["vec"]), final[s])
                yield pd.DataFrame({"space": s, "id": rows["id"].to_numpy(), "cluster_id": label.astype(np.int32), "distance": distance})

    id_type = points.schema["id"].dataType.simpleString()
    return points.select("space", "id", "vec").mapInPandas(assign, f"space string, id {id_type}, cluster_id int, distance double"), final


def _nearest_center(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.stack([((x - c) ** 2).sum(1) for c in centers], axis=1)
    label = gaps.argmin(1)
    return label, np.sqrt(gaps[np.arange(len(x)), label])


def kmeans(points: DataFrame, k: int, seed: int, iterations: int = 80) -> tuple[DataFrame, list[list[float]]]:
    """(id, cluster_id, distance) and the centres."""
    labelled, centers = kmeans_spaces(stage(points.select(F.lit("all").alias("space"), "id", "vec")), k, seed, iterations)
    return labelled.drop("space"), centers.get("all", np.empty((0, 0))).tolist()


def cluster_deviations(points: DataFrame, clusters: DataFrame, names: list[str], top: int = 6) -> DataFrame:
    """The features whose cluster mean is farthest from the overall mean."""
    keys = F.array(*[F.lit(n) for n in names])
    long = points.join(clusters.select("id", "cluster_id"), "id").select(
        "cluster_id", F.explode(F.arrays_zip(keys.alias("feature"), F.col("vec").alias("z"))).alias("p"))
    means = long.groupBy("cluster_id", F.col("p.feature").alias("feature")).agg(F.avg("p.z").alias("mean_z"))
    order = Window.partitionBy("cluster_id").orderBy(F.round(F.abs("mean_z"), 9).desc(), "feature")
    return means.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def cluster_label_rates(clusters: DataFrame, labels: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    return (clusters.join(labels.withColumnRenamed("sample_id", "id"), "id").groupBy("cluster_id")
            .agg(F.count(F.lit(1)).alias("size"), *[F.avg(f"label_{c}").alias(f"rate_{c}") for c in classes]))


def representatives(clusters: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("cluster_id").orderBy(F.round("distance", 9), "id")
    return clusters.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def coassociation(baseline: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean share of runs in which two wafers of the same, and of different, baseline clusters fall together.

    Both means follow from the counts per run, baseline cluster and run cluster; no pair of wafers is formed.
    """
    counts = runs.join(baseline.select("id", F.col("cluster_id").alias("b")), "id").groupBy(
        "run", "b", F.col("cluster_id").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sq, n = F.col("n") * F.col("n"), F.col("n")
    together = counts.groupBy("run").agg(F.sum(sq - n).alias("same"), F.sum(sq).alias("cell_sq"), F.sum("n").alias("total"))
    by_c = counts.groupBy("run", "c").agg(F.sum("n").alias("n")).groupBy("run").agg(F.sum(sq).alias("c_sq"))
    by_b = counts.groupBy("run", "b").agg(F.sum("n").alias("n")).groupBy("run").agg(F.sum(sq).alias("b_sq"), F.sum(sq - n).alias("b_pairs"))
    diff_pairs = F.col("total") * F.col("total") - F.col("b_sq")
    per = together.join(by_c, "run").join(by_b, "run").select(
        F.when(F.col("b_pairs") > 0, F.col("same") / F.col("b_pairs")).otherwise(F.lit(0.0)).alias("same"),
        F.when(diff_pairs > 0, (F.col("c_sq") - F.col("cell_sq")) / diff_pairs).otherwise(F.lit(0.0)).alias("diff"))
    return per.agg(F.avg("same").alias("same_cluster_mean_coassociation"), F.avg("diff").alias("different_cluster_mean_coassociation"),
                   (F.avg("same") - F.avg("diff")).alias("coassociation_separation"))


def cluster_coassociation(baseline: DataFrame, runs: DataFrame) -> DataFrame:
    """Internal co-association of each baseline cluster; one for a single wafer."""
    counts = runs.join(baseline.select("id", F.col("cluster_id").alias("b")), "id").groupBy(
        "run", "b", F.col("cluster_id").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    per = counts.groupBy("run", "b").agg(F.sum("n").alias("size"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    pairs = F.col("size") * (F.col("size") - 1)
    return per.groupBy(F.col("b").alias("cluster_id")).agg(
        F.max("size").cast("long").alias("size"),
        F.avg(F.when(pairs > 0, F.col("same") / pairs).otherwise(F.lit(1.0))).alias("internal_coassociation"))


PAIR_BLOCK = 2048


def fragile_pairs(baseline: DataFrame, runs: DataFrame, n_runs: int, top: int = 3) -> DataFrame:
    """The pairs inside each baseline cluster that fall together least often.

    Wafers with the same run labels are alike, so of each such set only the ``top`` + 1 lowest ids can matter. Blocks of
    label sets meet pairwise and return ``top`` pairs each; the pairs themselves are never listed.
    """
    paths = runs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "cluster_id"))), lambda s: s["cluster_id"]).alias("path"))
    rows = paths.join(baseline.select("id", "cluster_id"), "id")
    low = Window.partitionBy("cluster_id", "path").orderBy("id")
    rows = rows.withColumn("copy", F.row_number().over(low)).filter(F.col("copy") <= top + 1).drop("copy")
    sizes = rows.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
    placed = stage(rows.join(sizes, "cluster_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.withColumn("o", other).filter("block <= o").select("cluster_id", F.col("block").alias("i"), F.col("o").alias("j"), "id", "path")
    right = placed.withColumn("o", other).filter("o <= block").select(
        F.col("cluster_id").alias("cluster_id"), F.col("o").alias("i"), F.col("block").alias("j"), F.col("id").alias("id"), F.col("path").alias("path"))

    def lowest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"cluster_id": np.empty(0, np.int32), "left_id": np.empty(0, object), "right_id": np.empty(0, object), "coassociation": np.empty(0)})
        if a.empty or b.empty:
            return none
        pa, pb = np.stack(a["path"]), np.stack(b["path"])
        share = np.zeros((len(pa), len(pb)))
        for r in range(pa.shape[1]):
            share += pa[:, r][:, None] == pb[:, r][None, :]
        share /= n_runs
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        if a["i"].iloc[0] == a["j"].iloc[0]:
            share[ia[:, None] >= ib[None, :]] = np.inf
        finite = np.isfinite(share)
        if not finite.any():
            return none
        flat = share[finite]
        limit = np.partition(flat, min(top, len(flat)) - 1)[min(top, len(flat)) - 1]
        x, y = np.nonzero(share <= limit)
        lo = np.where(ia[x] < ib[y], ia[x], ib[y])
        hi = np.where(ia[x] < ib[y], ib[y], ia[x])
        out = pd.DataFrame({"cluster_id": a["cluster_id"].iloc[0], "left_id": lo, "right_id": hi, "coassociation": share[x, y]})
        return out.sort_values(["coassociation", "left_id", "right_id"]).head(top)

    keys = ["cluster_id", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lowest, "cluster_id int, left_id string, right_id string, coassociation double")
    order = Window.partitionBy("cluster_id").orderBy(F.round("coassociation", 9), "left_id", "right_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def keyed_normal(seed: int, *keys) -> Column:
    """A normal draw that depends on the keys alone, so a repeated task draws the same."""
    def unit(tag: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2.0 * F.log(unit(1))) * F.cos(F.lit(TWO_PI) * unit(2))


def perturbed(points: DataFrame, runs: int, dim: int, rate: float, noise: float, seed: int) -> DataFrame:
    """(space, id, vec): per run a random share of the features, with noise; one space per run."""
    keep = max(2, min(dim, round(dim * rate)))
    chosen = [sorted(np.random.default_rng([seed, run]).choice(dim, size=keep, replace=False).tolist()) for run in range(runs)]
    picks = F.array(*[F.array(*[F.lit(i) for i in run]) for run in chosen])  # a constant of runs x features
    wide = points.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).withColumn("p", F.get(picks, F.col("run")))
    noisy = F.transform("p", lambda i: F.get(F.col("vec"), i) + noise * keyed_normal(seed, F.col("run"), F.col("id"), i))
    return wide.select(F.col("run").cast("string").alias("space"), "id", noisy.alias("vec"))


def repeated_clusterings(points: DataFrame, dim: int, runs: int, clusters: dict[int, int], rate: float = 0.85,
                         noise: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(perturbed points, clusters, id, cluster_id, distance of the whole features, clusters, run, id, cluster_id of every run).

    ``clusters`` maps each number of clusters to try to its seed. All runs of all numbers are perturbed and clustered in the same
    jobs, each in a space of its own.
    """
    points = stage(points)
    spaces = None
    for n, seed in clusters.items():
        one = perturbed(points, runs, dim, rate, noise, seed).withColumn("space", F.concat(F.lit(f"{n}/"), "space"))
        spaces = one if spaces is None else spaces.unionByName(one)
    every = stage(spaces)
    number = F.split("space", "/")[0].cast("int").alias("clusters")
    names = {f"{n}/{run}": n for n in clusters for run in range(runs)}
    labelled = stage(kmeans_spaces(every, names, min(clusters.values()) + 1009)[0].select(
        number, F.split("space", "/")[1].cast("int").alias("run"), "id", "cluster_id"))
    based = points.select(F.explode(F.array(*[F.lit(f"{n}/base") for n in clusters])).alias("space"), "id", "vec")
    baseline = stage(kmeans_spaces(stage(based), {f"{n}/base": n for n in clusters}, min(clusters.values()))[0].select(
        number, "id", "cluster_id", "distance"))
    return every, baseline, labelled


def stability(points: DataFrame, dim: int, runs: int, clusters: dict[int, int], k: int, rate: float = 0.85,
              noise: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary rows, baseline clusters and run clusters of repeated clustering on perturbed features; the runs are searched as they
    are clustered, in the same jobs (see ``repeated_clusterings``)."""
    points = stage(points)
    every, baseline, labelled = repeated_clusterings(points, dim, runs, clusters, rate, noise)
    number = F.split("space", "/")[0].cast("int").alias("clusters")
    base_nn = search.nearest(points, points, k, exclude_same_id=True).select("query_id", "neighbor_id", F.lit(1).alias("shared"))
    run_nn = search.nearest(every, every, k, exclude_same_id=True, staged=True).select(number, "query_id", "neighbor_id")
    overlap = run_nn.join(base_nn, ["query_id", "neighbor_id"], "left").groupBy("clusters").agg(
        F.avg(F.coalesce("shared", F.lit(0))).alias("mean_neighbor_overlap"))
    summary = None
    for n in clusters:
        row = coassociation(baseline.filter(F.col("clusters") == n), labelled.filter(F.col("clusters") == n)).withColumn("clusters", F.lit(n))
        summary = row if summary is None else summary.unionByName(row)
    return summary.join(overlap, "clusters"), baseline, labelled


@dataclass(frozen=True)
class Encoder:
    """Two tanh layers and a linear multi-label head over standardised input; a few matrices."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    labels: tuple[str, ...] = field(default=())

    def forward(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = (vectors - self.mean) / self.scale
        h = np.tanh(x @ self.w1 + self.b1)
        z = np.tanh(h @ self.w2 + self.b2)
        return x, h, z, z @ self.wc + self.bc


def fit_input_scale(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    row = search.vector_scaler(vectors.select("id", "vec"), flat_as_one=True).first()
    return np.array(row["mu"]), np.array(row["sd"])


def new_encoder(vectors: DataFrame, hidden: int, embedding: int, labels: tuple[str, ...], seed: int = 20260618) -> Encoder:
    mean, scale = fit_input_scale(vectors)
    rng = np.random.default_rng(seed)
    dims = ((len(mean), hidden, 2.0), (hidden, embedding, 2.0), (embedding, len(labels), 1.0))
    w = [rng.normal(0.0, np.sqrt(gain / max(i, 1)), size=(i, o)) for i, o, gain in dims]
    return Encoder(mean, scale, w[0], np.zeros(hidden), w[1], np.zeros(embedding), w[2], np.zeros(len(labels)), labels)


def _tree_sum(df: DataFrame, step) -> np.ndarray:
    """Add up one equally long vector per partition in two levels; the driver receives as many sums as the root of their number."""
    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                part = step(pdf)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"total": [total.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in pdf["total"]], axis=0)
        return pd.DataFrame({"total": [total.tobytes()]})

    parts = df.mapInPandas(partial, "total binary")
    # as many groups as each has members, so both levels grow with the root of the number of partitions
    fan = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(df.rdd.getNumPartitions())))).alias("g")
    sums = parts.select(fan, "total").groupBy("g").applyInPandas(add, "total binary").collect()
    return np.sum([np.frombuffer(r["total"]) for r in sums], axis=0)


def _jaccard_table(signatures: list[int]) -> np.ndarray:
    out = np.ones((len(signatures), len(signatures)))
    for i, a in enumerate(signatures):
        for j, b in enumerate(signatures):
            if a | b:
                out[i, j] = bin(a & b).count("1") / bin(a | b).count("1")
    return out


def train_encoder(model: Encoder, rows: DataFrame, epochs: int, rate: float, pair_weight: float, l2: float) -> tuple[Encoder, list[dict]]:
    """Full-batch gradient steps on (vec, y array of 0/1, signature).

    The pairwise term compares all wafers with all others, yet needs only sums: z'z and, per label set, the sum of z.
    There are at most 2^labels label sets, so an epoch is two passes over the rows and no pair of rows meets.
    """
    rows = stage(rows.select("vec", "y", "signature"))
    sigs = sorted(r[0] for r in rows.select("signature").distinct().collect())
    at = {s: i for i, s in enumerate(sigs)}
    similar = _jaccard_table(sigs)
    n = rows.count()
    history = []
    for _ in range(epochs):
        m, held = model, rows.sparkSession.sparkContext.broadcast(model)
        d, c = m.w2.shape[1], m.wc.shape[1]

        def moments(pdf: pd.DataFrame, held=held, d=d) -> np.ndarray:
            z = held.value.forward(np.stack(pdf["vec"]))[2]
            which = pdf["signature"].map(at).to_numpy()
            sums, sizes = np.zeros((len(sigs), d)), np.bincount(which, minlength=len(sigs)).astype(float)
            np.add.at(sums, which, z)
            return np.concatenate([(z.T @ z).ravel(), sums.ravel(), sizes])

        total = _tree_sum(rows, moments)
        gram = total[:d * d].reshape(d, d)
        sums = total[d * d:d * d + len(sigs) * d].reshape(len(sigs), d)
        sizes = total[d * d + len(sigs) * d:]
        pulled = similar @ sums

        def gradient(pdf: pd.DataFrame, held=held, d=d, c=c, gram=gram, pulled=pulled) -> np.ndarray:
            m = held.value
            x, h, z, logits = m.forward(np.stack(pdf["vec"]))
            y = np.stack(pdf["y"]).astype(float)
            p = 1.0 / (1.0 + np.exp(-np.clip(logits, -30.0, 30.0)))
            loss = -(y * np.log(p + EPS) + (1 - y) * np.log(1 - p + EPS)).sum()
            dlogits = (p - y) / max(n * c, 1)
            which = pdf["signature"].map(at).to_numpy()
            dz = dlogits @ m.wc.T + pair_weight * 4.0 / max(n * n * d, 1) * (z @ gram / d - pulled[which])
            dz *= 1 - z * z
            dh = (dz @ m.w2.T) * (1 - h * h)
            return np.concatenate([v.ravel() for v in (x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0), z.T @ dlogits, dlogits.sum(0))]
                                  + [np.array([loss])])

        g = _tree_sum(rows, gradient)
        held.destroy()
        shapes = [m.w1.shape, m.b1.shape, m.w2.shape, m.b2.shape, m.wc.shape, m.bc.shape]
        parts, pos = [], 0
        for s in shapes:
            size = int(np.prod(s))
            parts.append(g[pos:pos + size].reshape(s))
            pos += size
        pair_loss = ((gram * gram).sum() / d ** 2 - 2.0 * np.einsum("id,ij,jd->", sums, similar, sums) / d
                     + sizes @ (similar ** 2) @ sizes) / n ** 2
        decay = 0.5 * l2 * sum(float((w * w).sum()) for w in (m.w1, m.w2, m.wc))
        bce = float(g[-1]) / max(n * c, 1)
        history.append({"total": float(bce + pair_weight * pair_loss + decay), "bce": bce, "pairwise": float(pair_loss), "l2": decay})
        model = replace(m, w1=m.w1 - rate * (parts[0] + l2 * m.w1), b1=m.b1 - rate * parts[1],
                        w2=m.w2 - rate * (parts[2] + l2 * m.w2), b2=m.b2 - rate * parts[3],
                        wc=m.wc - rate * (parts[4] + l2 * m.wc), bc=m.bc - rate * parts[5])
    return model, history


def encode(model: Encoder, rows: DataFrame) -> DataFrame:
    """Add ``embedding`` (unit length), ``logits`` and ``probs`` to rows with a ``vec``; rows without one get NULLs.

    The weights go to every executor once, as a broadcast of some matrices.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("embedding array<double>, logits array<double>, probs array<double>")
    def apply(vec: pd.Series) -> pd.DataFrame:
        known = np.flatnonzero(vec.notna().to_numpy())
        columns = {c: np.empty(len(vec), dtype=object) for c in ("embedding", "logits", "probs")}
        if len(known):
            _, _, z, logits = held.value.forward(np.stack(vec.iloc[known]))
            e = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            p = 1.0 / (1.0 + np.exp(-np.clip(logits, -30.0, 30.0)))
            for name, values in (("embedding", e), ("logits", logits), ("probs", p)):
                columns[name][known] = [row for row in values]
        return pd.DataFrame(columns)

    return rows.withColumn("_e", apply("vec")).select("*", "_e.*").drop("_e")


def prediction_table(scored: DataFrame, labels: tuple[str, ...], dims: int) -> DataFrame:
    """Flat columns of scored rows: one probability per label, one column per embedding position."""
    return scored.select(
        "id", *[c for c in scored.columns if c.startswith("label_")],
        *[F.get("probs", F.lit(i)).alias(f"prob_{n}") for i, n in enumerate(labels)],
        F.element_at(F.array(*[F.lit(n) for n in labels]), F.array_position("probs", F.array_max("probs")).cast("int")).alias("top_label"),
        *[F.get("embedding", F.lit(i)).alias(f"embedding_{i:02d}") for i in range(dims)])


def linear_segmentation(cells: DataFrame, channels: list[str], targets: list[str], steps: int, rate: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Weights (channel x class), biases and the loss before each step and after the last, from column sums alone."""
    cells = stage(cells.select(*channels, *targets))
    first = cells.agg(F.count(F.lit(1)).alias("n"), *[F.avg(t).alias(t) for t in targets]).first()
    n = max(int(first["n"]), 1)
    prevalence = np.clip([float(first[t] or 0.0) for t in targets], EPS, 1.0)
    pw = np.minimum((1 - prevalence) / prevalence, 50.0)
    w, b, losses = np.zeros((len(channels), len(targets))), np.zeros(len(targets)), []
    for step in range(steps + 1):
        aggs = []
        for j, t in enumerate(targets):
            logit = F.lit(float(b[j]))
            for i, ch in enumerate(channels):
                logit = logit + F.col(ch) * float(w[i, j])
            p, y = sigmoid(logit), F.col(t).cast("double")
            pull = (p - y) * F.when(y > 0, F.lit(float(pw[j]))).otherwise(F.lit(1.0))
            aggs += [F.sum(cross_entropy(y, p, F.lit(float(pw[j])))).alias(f"l{j}"), F.sum(pull).alias(f"b{j}"),
                     *[F.sum(pull * F.col(ch)).alias(f"w{i}_{j}") for i, ch in enumerate(channels)]]
        row = cells.agg(*aggs).first()
        losses.append(sum(float(row[f"l{j}"]) for j in range(len(targets))) / (n * len(targets)))
        if step < steps:
            for j in range(len(targets)):
                b[j] -= rate * float(row[f"b{j}"]) / n
                for i in range(len(channels)):
                    w[i, j] -= rate * float(row[f"w{i}_{j}"]) / n
    return w, b, losses


def score_forests(points: DataFrame, labels: list[str], trees: int = 220, depth: int = 10, seed: int = 11) -> DataFrame:
    """One regression forest per class on rows (vec, split, labels); error and AUC on the validation rows."""
    rows = stage(points.withColumn("features", array_to_vector("vec")))
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    long = None
    for name in labels:
        model = RandomForestRegressor(featuresCol="features", labelCol=name, predictionCol="p", numTrees=trees, maxDepth=depth, seed=seed).fit(train)
        one = model.transform(val).select(F.lit(name).alias("feature"), F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)).alias("v"),
                                          F.col(name).cast("int").alias("truth"))
        long = one if long is None else long.unionByName(one)
    error = long.groupBy("feature").agg(F.avg(F.abs(F.col("v") - F.col("truth"))).alias("mae"))
    auc = class_auc(long, ("truth",)).drop("class_name").withColumn(
        "auc", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("auc")))
    return error.join(auc, "feature").withColumnRenamed("feature", "class_name")


