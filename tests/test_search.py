"""Exact neighbours against brute force, skewed and copied vectors included; ordering helpers; retrieval figures."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from siliscope.functions import names as nm
from siliscope.operators import ordering, retrieval, search

FEATURES = ["total_fail_density", "stby_ratio"]


def table(spark, x, ids=None):
    ids = ids if ids is not None else [f"p{i:05d}" for i in range(len(x))]
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "id string, vec array<double>")


def brute(x, k, exclude=True):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    if exclude:
        np.fill_diagonal(d, np.inf)
    return {(f"p{q:05d}", r + 1, f"p{n:05d}") for q in range(len(x)) for r, n in enumerate(np.lexsort((np.arange(len(x)), d[q]))[:k])}


def found(df):
    return {(r["query_id"], r["rank"], r["neighbor_id"]) for r in df.collect()}


def test_three_points(spark):
    t = table(spark, np.array([[0, 0], [0.1, 0], [5, 5]]))
    got = {r["query_id"]: r["neighbor_id"] for r in search.nearest(t, t, 1, exclude_same_id=True).collect()}
    assert got == {"p00000": "p00001", "p00001": "p00000", "p00002": "p00001"}
    with pytest.raises(ValueError):
        search.nearest(t, t, 0)


@pytest.mark.parametrize("cell_rows", [10 ** 6, 25])
def test_neighbors_match_brute_force_with_a_third_of_copies(spark, monkeypatch, cell_rows):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)).round(2)
    x[:100] = x[0]
    x[100:180] = x[100] + rng.normal(size=(80, 6)) * 0.01
    monkeypatch.setattr(search, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(search, "BLOCK_ROWS", 40)
    t = table(spark, x)
    assert found(search.nearest(t, t, 4, exclude_same_id=True)) == brute(x, 4)


def test_a_vector_moves_for_blocks_not_for_cells(spark, monkeypatch):
    moved = []
    meet = search._Cells.block_join

    def counted(self, queries, *rest):
        moved.append(queries.count())
        return meet(self, queries, *rest)

    monkeypatch.setattr(search._Cells, "block_join", counted)
    monkeypatch.setattr(search, "CELL_ROWS", 10)
    x = np.random.default_rng(3).normal(size=(400, 12))
    t = table(spark, x)
    assert found(search.nearest(t, t, 3, exclude_same_id=True)) == brute(x, 3)
    assert sum(moved) <= 2 * len(x)
    moved.clear()
    monkeypatch.setattr(search, "BLOCK_ROWS", 100)
    assert found(search.nearest(t, t, 3, exclude_same_id=True)) == brute(x, 3)
    assert sum(moved) <= 10 * len(x)


def test_vectors_with_gaps_hide_no_others(spark, monkeypatch):
    monkeypatch.setattr(search, "CELL_ROWS", 10)
    monkeypatch.setattr(search, "BLOCK_ROWS", 30)
    x = np.random.default_rng(4).normal(size=(120, 3))
    gaps = x.copy()
    gaps[100:, 1] = np.nan
    t = table(spark, gaps)
    assert found(search.nearest(t, t, 3, exclude_same_id=True)) == brute(x[:100], 3)


def test_a_space_with_fewer_whole_vectors_than_asked_for_has_no_neighbors(spark):
    x = np.random.default_rng(5).normal(size=(6, 3))
    x[2:, 0] = np.nan
    t = table(spark, x)
    assert found(search.nearest(t, t, 2, exclude_same_id=True)) == set()


def test_more_neighbors_than_points(spark):
    t = table(spark, np.array([[0.0], [1.0]]))
    assert search.nearest(t, t, 5, exclude_same_id=True).count() == 2


def test_cosine_keeps_the_only_row(spark):
    one = table(spark, np.array([[1.0, 0.0]]))
    assert [(r["query_id"], r["neighbor_id"]) for r in search.cosine_neighbors(one, one, 3).collect()] == [("p00000", "p00000")]
    two = table(spark, np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert {(r["query_id"], r["neighbor_id"]) for r in search.cosine_neighbors(two, two, 3).collect()} == {("p00000", "p00001"), ("p00001", "p00000")}


def test_polar_decoy_is_ignored(spark):
    cols = ["sample_id", *FEATURES, "polar_r00_a00_severity", "stby_polar_r00_a00_ratio"]
    schema = "sample_id string, " + ", ".join(f"{c} double" for c in cols[1:])
    q = spark.createDataFrame([("q", 0.1, 0.0, 100.0, 100.0)], schema)
    ref = spark.createDataFrame([("compact_match", 0.1, 0.0, 0.0, 0.0), ("polar_match_only", 0.9, 0.9, 100.0, 100.0)], schema)
    names = nm.shared_observable(q.columns, ref.columns)
    assert names == FEATURES
    assert search.cross_neighbors(q, ref, names, 1).first()["neighbor_id"] == "compact_match"


def test_cosine_of_zero_vectors(spark):
    t = table(spark, np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 2.0], [3.0, 0.1]]))
    rows = {(r["query_id"], r["neighbor_id"]): r["similarity"] for r in search.cosine_neighbors(t, t, 3).collect()}
    assert all(abs(v) < 1e-9 for (q, n), v in rows.items() if "p00000" in (q, n))
    assert rows[("p00001", "p00003")] > 0.99


def test_observable_columns():
    row = ["sample_id", "actual_net_die", "cluster_id", "pca_0", "pca_1", *FEATURES, "label_edge", "edge_mask_ratio", "polar_r00_a00_severity", "stby_polar_r00_a00_ratio"]
    assert nm.observable(row) == FEATURES
    assert nm.family_of("morph_hot_chip_ratio") == "other"


def test_quantiles_and_index_of_a_hot_group(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([np.full(400, 7.0), rng.normal(size=600).round(3)])
    df = spark.createDataFrame([("hot" if i < 800 else "b", float(x)) for i, x in enumerate(v)], "g string, v double")
    got = {r["g"]: (r["m"], r["p"]) for r in ordering.exact_quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.95}).collect()}
    for g, part in (("hot", v[:800]), ("b", v[800:])):
        assert np.allclose(got[g], np.quantile(part, [0.5, 0.95]))
    idx = ordering.row_index(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"]).collect()
    assert sorted((r["k"], r["idx"]) for r in idx) == [(i, i) for i in range(1000)]


def test_random_pairs_from_signatures(spark):
    rng = np.random.default_rng(4)
    s = rng.integers(0, 8, 60)
    want = [1.0 if not (a | b) else bin(a & b).count("1") / bin(a | b).count("1") for i, a in enumerate(map(int, s)) for b in map(int, s[i + 1:])]
    sigs = spark.createDataFrame([(f"w{i}", int(v)) for i, v in enumerate(s)], "id string, signature long")
    assert np.isclose(retrieval.random_pair_jaccard(sigs).first()["random_pair_label_jaccard"], np.mean(want))


def test_target_quality_by_hand(spark):
    regions = spark.createDataFrame([("a", "scratch", "scratch__1200__middle", "12:00", "middle"), ("b", "scratch", "scratch__1200__middle", "12:00", "middle"),
                                     ("c", "local", "local__0300__center", "03:00", "center")],
                                    "sample_id string, class_name string, feature_key string, location_label string, radial_zone string")
    samples = spark.createDataFrame([(s,) for s in "abcd"], "sample_id string")
    chosen = retrieval.targets(regions, samples, 2)
    assert {r["class_name"] for r in chosen.collect()} == {"scratch"} and chosen.count() == 4
    nn = [("a", 1, "b"), ("a", 2, "c"), ("b", 1, "a"), ("b", 2, "c")]
    neighbors = spark.createDataFrame([(f"scratch|{s}", q, r, n, 0.0) for s in ("plain", "location") for q, r, n in nn],
                                      "space string, query_id string, rank int, neighbor_id string, distance double")
    rows = retrieval.target_metrics(retrieval.target_neighbor_rows(regions, chosen, neighbors), chosen, samples).collect()
    assert len(rows) == 4
    for r in rows:
        assert (r["precision_at_k"], r["hit_rate_at_k"], r["mrr"]) == (0.5, 1.0, 1.0)
        assert np.isclose(r["random_precision"], 1 / 3) and np.isclose(r["lift"], 1.5)


def test_keyed_permutation_is_one_to_one():
    for n in (1, 2, 5, 97, 1000):
        for key in (0, 1, 12345):
            out = retrieval._shuffled_position(np.arange(n), np.full(n, key), n)
            assert sorted(out) == list(range(n))
    assert (retrieval._shuffled_position(np.arange(1000), np.full(1000, 3), 1000) != np.arange(1000)).mean() > 0.9


def test_permutation_equals_relabelling_by_hand(spark):
    rng = np.random.default_rng(6)
    n, runs, seed = 30, 40, 9
    own = rng.integers(0, 8, n)
    sigs = spark.createDataFrame([(f"w{i:03d}", int(s)) for i, s in enumerate(own)], "id string, signature long")
    near = [(f"w{i:03d}", r + 1, f"w{j:03d}") for i in range(n) for r, j in enumerate(rng.choice(n, 3, replace=False).tolist())]
    neighbors = spark.createDataFrame(near, "query_id string, rank int, neighbor_id string")
    got = retrieval.permutation_p_value(neighbors.repartition(4), sigs, runs, seed).first()
    values, counts = np.unique(own, return_counts=True)
    jac = lambda a, b: 1.0 if not a | b else bin(a & b).count("1") / bin(a | b).count("1")
    pairs = [(int(q[1:]), int(m[1:])) for q, _, m in near]
    real, better = np.mean([jac(int(own[a]), int(own[b])) for a, b in pairs]), 0
    for run in range(runs):
        at = retrieval.relabelled(np.arange(n), run, seed, np.cumsum(counts))
        assert sorted(values[at].tolist()) == sorted(own.tolist())  # the same label sets, handed out anew
        better += np.mean([jac(int(values[at[a]]), int(values[at[b]])) for a, b in pairs]) >= real - 1e-12
    assert got["runs"] == runs and np.isclose(got["p_value"], (better + 1) / (runs + 1))


def test_permutation_and_bootstrap_see_a_real_signal(spark):
    n = 40
    sigs = spark.createDataFrame([(f"w{i:03d}", 1 if i < n // 2 else 2) for i in range(n)], "id string, signature long")
    near = [(f"w{i:03d}", r, f"w{(i // 20) * 20 + (i + r) % 20:03d}") for i in range(n) for r in (1, 2, 3)]
    neighbors = spark.createDataFrame(near, "query_id string, rank int, neighbor_id string")
    p = retrieval.permutation_p_value(neighbors, sigs, 50, 1).first()
    assert p["runs"] == 50 and np.isclose(p["p_value"], 1 / 51)
    ci = retrieval.bootstrap_lift(neighbors, sigs, 200, 1).first()
    assert ci["neighbor_mean_ci_low"] == 1.0 and ci["lift_ci_low"] > 1.3 and ci["lift_ci_low"] <= ci["lift_ci_high"]


def test_queries_of_one_block_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    monkeypatch.setattr(search, "PIECE_ROWS", 64)
    met = []
    plain = search._Cells.block_join

    def watched(self, queries, refs, k, id_type):
        joined = plain(self, queries, refs, k, id_type)
        met.append(joined)
        return joined

    monkeypatch.setattr(search._Cells, "block_join", watched)
    got = {(r["query_id"], r["rank"]): r["neighbor_id"] for r in search.nearest(points, points, 3, exclude_same_id=True).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, r + 1): int(j) for i in range(400) for r, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    # one block of 400 references; its queries come in several pieces
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert len(met) == 1 and met[0].select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
