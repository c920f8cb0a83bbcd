"""Hand-computed maps: codes, features, clock labels, regions, pooling, windows, arcs."""
import math

import numpy as np
import pytest
from conftest import pixel_table
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.functions import columns as fc
from siliscope.operators import chipsize, components, features, geometry, models, pixelscores, pooling, proposals, regions
from siliscope.operators.geometry import Geometry


def one_chip(h, w):
    return Geometry(h, w, 1, 1, h, w, h * w)


def test_gray_codes(spark):
    rows = spark.createDataFrame([(g, 1, 0) for g in range(8)] + [(0, 1, 1), (5, 0, 0)], "g int, wafer int, stby int")
    codes = [r[0] for r in rows.select(fc.grade_to_gray(F.col("g"), F.col("wafer"), F.col("stby"))).collect()]
    assert codes == [0, 31, 151, 175, 191, 207, 223, 255, 255, 0]
    back = spark.createDataFrame([(0,), (31,), (151,), (255,), (99,)], "v int").select(fc.gray_to_grade(F.col("v"))).collect()
    assert [r[0] for r in back] == [0, 1, 2, 7, None]


def test_clock_points(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, -1.0), (0.0, 0.0), (-1.0, 0.0)], "dx double, dy double")
    assert [r[0] for r in rows.select(fc.clock_position(F.col("dx"), F.col("dy"))).collect()] == ["03:00", "12:00", "center", "09:00"]


def test_single_valid_pixel(spark):
    px = pixel_table(spark, [[7, 0], [0, 0]], valid=[[1, 0], [0, 0]])
    row = features.compact_features(px, one_chip(2, 2)).first().asDict()
    assert row["total_fail_density"] == 1.0 and row["grade_weighted_severity"] == 1.0
    assert max(row[f"radial_zone_{i:02d}_severity"] for i in range(5)) == 1.0
    assert len(row) == 51


def test_profile_path_equals_direct_path(spark):
    rng = np.random.default_rng(3)
    sev = rng.integers(0, 8, (12, 12))
    stby = np.zeros((12, 12), int)
    stby[4:6, 4:6] = 1
    sev[stby > 0] = 0
    px = pixel_table(spark, sev, stby=stby).withColumns({"chip_row": F.floor(F.col("y") / 2).cast("int"), "chip_col": F.floor(F.col("x") / 2).cast("int")})
    geo = Geometry(12, 12, 2, 2, 6, 6, 36)
    whole = features.all_features(px, geo).first().asDict()
    polar, chips = geometry.with_polar(px), geometry.chips(px, geo)
    for df in (features.global_densities(px), features.radial_zones(polar), features.angular_sectors(polar), features.edge_center_density(polar),
               features.edge_face_density(polar, geo), features.profile_peaks(polar), features.local_hotspots(chips),
               features.polar_features(chips), features.shot_contrasts(chips)):
        for k, v in df.first().asDict().items():
            assert whole[k] == v or abs(whole[k] - v) < 1e-12, k
    assert len(whole) == 159


def test_components_and_span(spark):
    mask = np.zeros((2, 6, 6), bool)
    mask[0, [0, 1, 2], [0, 1, 2]] = True
    mask[0, 5, 5] = True
    mask[1, 0, [0, 1, 3]] = True
    eight, four = components.label_mask(mask, True), components.label_mask(mask, False)
    assert {int(v) for v in eight[0][mask[0]]} == {0, 35} and len({int(v) for v in four[0][mask[0]]}) == 4
    assert {int(v) for v in eight[1][mask[1]]} == {0, 3}
    span = spark.range(1).select(components.circular_span(F.array(F.lit(0.95), F.lit(0.05), F.lit(0.0)))).first()[0]
    assert math.isclose(span, 0.1)


def test_random_maps_label_like_flood_fill():
    rng = np.random.default_rng(1)
    mask = rng.random((5, 15, 15)) < 0.55
    for diagonal in (True, False):
        labels = components.label_mask(mask, diagonal)
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
        for b in range(5):
            seen = {}
            for y, x in np.argwhere(mask[b]):
                if (y, x) in seen:
                    continue
                stack, seen[(y, x)] = [(y, x)], y * 15 + x
                while stack:
                    cy, cx = stack.pop()
                    for dy, dx in steps:
                        n = (cy + dy, cx + dx)
                        if 0 <= n[0] < 15 and 0 <= n[1] < 15 and mask[b][n] and n not in seen:
                            seen[n] = y * 15 + x
                            stack.append(n)
            assert all(labels[b][p] == v for p, v in seen.items())


def test_chip_size():
    raw = np.zeros((6, 8), int)
    raw[0:3, 2:4] = 255
    assert chipsize.chip_size(raw) == (3, 2)
    tall = np.zeros((4, 4), int)
    tall[0:2, 0:4] = 255
    with pytest.raises(ValueError):
        chipsize.chip_size(tall)
    with pytest.raises(ValueError):
        chipsize.chip_size(np.zeros((4, 4), int))


def test_defect_region(spark):
    scratch, stby = np.zeros((24, 24), int), np.zeros((24, 24), int)
    scratch[4:7, 11:13] = 1
    stby[4:5, 11:12] = 1
    px = pixel_table(spark, np.zeros((24, 24), int), stby=stby, classes={"scratch": scratch, "stby_pattern": stby})
    rows = {r["class_name"]: r for r in regions.in_report_order(regions.region_rows(px)).collect()}
    assert rows["scratch"]["centroid_clock"] == "12:00" and rows["scratch"]["feature_key"] == "scratch__1200__middle"
    assert rows["scratch"]["stby_overlap_ratio"] > 0 and rows["scratch"]["position"] == 1
    assert rows["stby_pattern"]["stby_overlap_ratio"] == 1.0


def test_semantic_pool(spark):
    px = pixel_table(spark, [[0, 7], [3, 0]], in_wafer=[[1, 1], [1, 0]], valid=[[1, 1], [0, 0]], stby=[[0, 0], [1, 0]])
    row = pooling.semantic_maps(pooling.pooled(px, 1), 1).first()
    assert (row["severity"], row["fail"], row["high"]) == (0.5, 0.5, 0.5)
    assert math.isclose(row["stby"], 1 / 3) and math.isclose(row["valid"], 2 / 3) and row["wafer"] == 0.75


def test_best_window_and_suppression(spark):
    score = np.zeros((6, 6))
    score[3:5, 3:5] = 1.0
    rows = spark.createDataFrame([("s", "edge", y, x, float(score[y, x])) for y in range(6) for x in range(6)],
                                 "sample_id string, class_name string, gy int, gx int, score double")
    means = proposals.window_means(rows, "score", 2, 6, ["sample_id", "class_name"])
    picked = proposals.suppress_windows(means, 2, 5).orderBy("place").collect()
    assert (picked[0]["gy"], picked[0]["gx"], picked[0]["mean"]) == (3, 3, 1.0)
    for i, a in enumerate(picked):
        for b in picked[:i]:
            inter = max(0, 2 - abs(a["gy"] - b["gy"])) * max(0, 2 - abs(a["gx"] - b["gx"]))
            assert inter / (8 - inter) <= proposals.WINDOW_IOU
    with pytest.raises(ValueError):
        proposals.window_means(rows, "score", 7, 6, ["sample_id", "class_name"])


def test_window_recall_counts_a_pixel_once(spark):
    target = spark.createDataFrame([("s", "edge", y, x, 1) for y in range(4) for x in range(4)], "sample_id string, class_name string, gy int, gx int, n long")
    boxes = spark.createDataFrame([("s", "edge", 0, 0), ("s", "edge", 0, 1)], "sample_id string, class_name string, gy int, gx int")
    assert proposals.window_recall(target, boxes, 2).first()["recall"] == 6 / 16


def test_circular_bins(spark):
    got = spark.range(8).filter(fc.circular_member(F.col("id"), F.lit(6), F.lit(4), 8)).collect()
    assert sorted(r[0] for r in got) == [0, 1, 6, 7]


def brute_arc(grid, c):
    a = np.arange(c.a0, c.a1) % grid.shape[1]
    values = grid[c.r0:c.r1][:, a]
    seen = grid[grid > 0]
    residual = values - (np.median(seen) if seen.size else 0.0)
    hit = residual > max(0.01, 0.2 * (seen.std() if seen.size else 0.0))
    if not hit.any():
        return residual.mean()
    along = hit.any(1).mean() if c.kind == "radial_scratch" else hit.any(0).mean()
    return residual[hit].mean() * (0.15 + along) * math.sqrt(max(hit.mean(), 1 / values.size))


def test_arc_scores_against_brute_force():
    rng = np.random.default_rng(5)
    grid = rng.random((8, 12)) * (rng.random((8, 12)) < 0.7)
    for cls in ("ring", "scratch"):
        arcs = proposals.arc_families(cls, 8, 12)
        fast = proposals.score_arcs(grid, arcs)
        slow = [brute_arc(grid, c) for c in arcs.itertuples()]
        assert np.allclose(fast, slow)


def test_hot_arc_is_found(spark):
    rows = spark.createDataFrame([("s", "ring", r, a, 1.0 if r == 3 and 4 <= a < 8 else 0.05) for r in range(8) for a in range(12)],
                                 "sample_id string, class_name string, r int, a int, score double")
    found = proposals.arc_candidates(rows, 8, 12, 3).orderBy("place").collect()
    assert found[0]["kind"] in ("partial_ring", "annulus") and found[0]["r0"] <= 3 < found[0]["r1"]
    arcs = proposals.random_arcs(rows.select("sample_id", "class_name").distinct(), 8, 12, 6, 1).collect()
    assert len(arcs) == 6 and all(0 <= a["r0"] < a["r1"] <= 8 and a["a0"] < a["a1"] for a in arcs)


def test_split_is_stable(spark):
    import hashlib
    rows = spark.createDataFrame([(f"w{i}",) for i in range(200)], "id string")
    got = {r[0]: r[1] for r in rows.select("id", regions.stable_split(F.col("id"), 0.3, 9)).collect()}
    for k, v in got.items():
        score = int(hashlib.sha256(f"9:{k}".encode()).hexdigest()[:12], 16) / 16 ** 12
        assert v == ("val" if score < 0.3 else "train")
    assert C.REPORT_CLASSES[0] == "scratch"


@pytest.mark.parametrize("half", [0, 1, 3, 5])
def test_box_mean_matches_a_mirrored_window(spark, half):
    rng = np.random.default_rng(half)
    maps = rng.integers(0, 9, size=(2, 5, 7))
    rows = [(f"s{i}", int(y), int(x), int(maps[i, y, x])) for i in range(2) for y in range(5) for x in range(7)]
    df = spark.createDataFrame(rows, "sample_id string, gy int, gx int, v int")
    got = {(r["sample_id"], r["gy"], r["gx"]): r["box_mean"] for r in pooling.box_mean(df, "v", half, 5, 7, ["sample_id"]).collect()}
    assert len(got) == len(rows)
    for i in range(2):
        wide = np.pad(maps[i], half, mode="symmetric")
        for y in range(5):
            for x in range(7):
                assert got[(f"s{i}", y, x)] == pytest.approx(wide[y:y + 2 * half + 1, x:x + 2 * half + 1].mean())


def test_severity_runs_from_the_base_to_the_largest_grade(spark):
    """Tables whose good pixels have grade 1 end at 7 too: the span is six grades and fail grades are the table's own."""
    px = pixel_table(spark, [[1, 7], [4, 2]])
    assert pixelscores.fail_pixels(px, 3).count() == 2
    polar = px.withColumns({"radius": F.lit(0.5), "theta": F.lit(0.1)})
    vec = pixelscores.profile_features(polar, grade_base=1).first()["vec"]
    assert max(vec[7:39]) == pytest.approx((0 + 6 + 3 + 1) / 6 / 4)


def test_clusters_of_several_spaces_in_the_same_passes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for space, gap in (("a", 10.0), ("b", 30.0)):
        rows += [(space, f"{space}{i:02d}", [float(gap * (i % 3) + rng.normal() * 0.1), float(rng.normal() * 0.1)]) for i in range(60)]
    rows += [("few", "f0", [1.0, 2.0]), ("few", "f1", [3.0, 4.0])]
    labelled, centers = models.kmeans_spaces(spark.createDataFrame(rows, "space string, id string, vec array<double>"), 3, seed=1)
    got = {(r["space"], r["id"]): (r["cluster_id"], r["distance"]) for r in labelled.collect()}
    assert len(got) == len(rows) and len(centers["few"]) == 2 and len({got[("few", i)][0] for i in ("f0", "f1")}) == 2
    x = {(s, i): np.array(v) for s, i, v in rows}
    for (space, name), (label, distance) in got.items():
        gaps = np.sqrt(((centers[space] - x[(space, name)]) ** 2).sum(1))
        assert distance == pytest.approx(gaps[label]) and gaps[label] == pytest.approx(gaps.min())
    for space in ("a", "b"):  # settled: each centre is the mean of its members
        for c in range(3):
            members = [x[k] for k, (label, _) in got.items() if k[0] == space and label == c]
            assert not members or centers[space][c] == pytest.approx(np.mean(members, axis=0))


def test_combined_vectors_hold_profiles_and_scores_in_order(spark):
    rng = np.random.default_rng(2)
    px = pixel_table(spark, rng.integers(0, 8, size=(8, 8)))
    polar = px.withColumns({"radius": F.sqrt(F.col("d2").cast("double")) / F.sqrt(F.col("wafer_extent").cast("double")), "theta": (F.col("x") + 0.5) / 8})
    parts = pixelscores.profile_features(polar).first()["vec"]
    scores = pixelscores.rule_scores(polar, 8, 8, 3, 2).first()
    tail = [scores[c] for c in pixelscores.SCORES]
    plain = pixelscores.combined_vectors(polar, 8, 8, 3, 2).first()["vec"]
    assert plain == pytest.approx(parts[:7] + parts[75:107] + parts[107:139] + parts[7:39] + parts[39:75] + tail)
    turned = pixelscores.combined_vectors(polar, 8, 8, 3, 2, invariant=True).first()["vec"]
    waves = np.abs(np.fft.rfft(parts[39:75]))
    assert turned == pytest.approx([*parts[:39], *(waves[1:13] / (waves[0] + 1e-6)), *tail])


def test_coarser_grids_add_up(spark):
    """Counts joined from a fine grid are those of the coarse one, also where edges do not divide the map."""
    rng = np.random.default_rng(3)
    px = pixel_table(spark, rng.integers(0, 8, (29, 22)), stby=(rng.random((29, 22)) < 0.1).astype(int), in_wafer=(rng.random((29, 22)) < 0.9).astype(int))
    fine = pooling.pooled(px, 8)
    for factor in (2, 4):
        joined, direct = pooling.coarser(fine, factor), pooling.pooled(px, 8 // factor)
        assert sorted(map(tuple, joined.select(*direct.columns).collect())) == sorted(map(tuple, direct.collect()))
    spaces = {r["space"]: len(r["vec"]) for r in pooling.representations(px, (4, 8)).collect()}
    assert spaces == {"naive_gray_4": 16, "naive_gray_8": 64, "semantic_pool_4": 96, "semantic_pool_8": 384}
    with pytest.raises(ValueError):
        pooling.representations(px, (3, 8))


def test_leading_axes_equal_a_whole_factorisation(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 5)) @ np.diag([5, 4, 3, 2, 1]) @ rng.standard_normal((5, 80)) + 0.1 * rng.standard_normal((60, 80))
    x -= x.mean(0)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vec array<double>").repartition(4)
    axes, shares = models.leading_axes(table, 3)
    _, s, vt = np.linalg.svd(x)
    assert np.abs(shares - (s ** 2)[:3] / (s ** 2).sum()).max() < 1e-9
    assert np.abs(np.abs(axes.T @ vt[:3].T) - np.eye(3)).max() < 1e-4
    got = np.array([r["vec"] for r in models.pca_embedding(table, 3).orderBy("id").collect()])
    z = x / x.std(0)
    want = z @ np.linalg.svd(z)[2][:3].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-4
    flat = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "id long, vec array<double>")
    assert models.leading_axes(flat.selectExpr("id", "array(0D, 0D) AS vec"), 2)[0].shape == (2, 0)
    assert models.leading_axes(table.limit(0), 2)[1].shape == (0,)


def test_summaries_of_fitted_clusters_by_hand(spark):
    """Every wafer is with its nearest centre; summaries and co-association follow from the assignment."""
    rng = np.random.default_rng(2)
    cloud = np.repeat([0, 1, 2], 12)
    x = np.eye(3)[cloud] * 20 + rng.standard_normal((36, 3)) * 0.1
    x = (x - x.mean(0)) / x.std(0)
    pts = spark.createDataFrame([(f"w{i:02d}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")
    fitted = models.kmeans(pts, 3, 7)[0]
    of = {r["id"]: (r["cluster_id"], r["distance"]) for r in fitted.collect()}
    centre = {c: x[[int(i[1:]) for i in of if of[i][0] == c]].mean(0) for c in range(3)}
    assert all(np.isclose(d, np.linalg.norm(x[int(i[1:])] - centre[c])) for i, (c, d) in of.items())
    assert all(min(np.linalg.norm(x[int(i[1:])] - m) for m in centre.values()) >= d - 1e-9 for i, (_, d) in of.items())
    top = {r["cluster_id"]: r["feature"] for r in models.cluster_deviations(pts, fitted, ["a", "b", "c"], 1).collect()}
    assert all(top[c] == "abc"[np.abs(centre[c]).argmax()] for c in range(3))
    nearest = {r["cluster_id"]: r["id"] for r in models.representatives(fitted, 1).collect()}
    assert all(nearest[c] == min((d, i) for i, (own, d) in of.items() if own == c)[1] for c in range(3))
    _, base, runs = models.repeated_clusterings(pts, 3, 6, {3: 17})
    row = models.coassociation(base.drop("clusters"), runs.drop("clusters")).first()
    paths = {}
    for r in runs.collect():
        paths.setdefault(r["id"], {})[r["run"]] = r["cluster_id"]
    own = {r["id"]: r["cluster_id"] for r in base.collect()}
    share = lambda a, b: np.mean([paths[a][k] == paths[b][k] for k in range(6)])
    ids = sorted(own)
    same = [share(a, b) for a in ids for b in ids if a < b and own[a] == own[b]]
    other = [share(a, b) for a in ids for b in ids if a < b and own[a] != own[b]]
    assert np.isclose(row["same_cluster_mean_coassociation"], np.mean(same)) and np.isclose(row["different_cluster_mean_coassociation"], np.mean(other))
    for top in (1, 3):
        got = {}
        for r in models.fragile_pairs(base.drop("clusters"), runs.drop("clusters"), 6, top).orderBy("cluster_id", "place").collect():
            got.setdefault(r["cluster_id"], []).append((round(r["coassociation"], 9), r["left_id"], r["right_id"]))
        want = {c: sorted((round(share(a, b), 9), a, b) for a in ids for b in ids if a < b and own[a] == own[b] == c)[:top] for c in set(own.values())}
        assert got == {c: pairs for c, pairs in want.items() if pairs}  # alike wafers are pairs as well


def test_profile_counts_each_family(spark):
    sev = np.arange(16).reshape(4, 4) % 8
    px = pixel_table(spark, sev, stby=[[0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]).withColumn("chip_row", F.floor(F.col("y") / 2).cast("int"))
    px = px.withColumn("chip_col", F.when(F.col("x") >= 2, 1))  # the other chips have no column
    rows = features.wafer_profile(geometry.with_polar(px), Geometry(4, 4, 2, 2, 2, 2, 4)).collect()
    chips = {(r["a"], r["b"]): (r["n_px"], r["n_valid"], r["n_stby"], r["sev_sum"]) for r in rows if r["family"] == "chip"}
    assert chips == {(0, None): (4, 3, 1, 5), (0, 1): (4, 4, 0, 18), (1, None): (4, 4, 0, 10), (1, 1): (4, 4, 0, 18)}
    for family in ("zone", "sector", "radius", "theta"):
        held = [r for r in rows if r["family"] == family]
        assert len({r["a"] for r in held}) == len(held) and {r["b"] for r in held} == {0}
        assert sum(r["n_px"] for r in held) == 16 and sum(r["sev_sum"] for r in held) == 51
    # the families are grouping sets of one pass
    assert "Generate" not in features.wafer_profile(geometry.with_polar(px), one_chip(4, 4))._jdf.queryExecution().executedPlan().toString()


def _line_items(spark, folder, orders):
    spark.range(orders).select(
        F.when(F.col("id") % 97 != 5, F.col("id")).alias("l_orderkey"), (F.col("id") * 7 % 101).alias("l_partkey"), (F.col("id") * 3 % 11).alias("l_suppkey"),
        (F.col("id") % 7).cast("int").alias("l_linenumber"), (F.col("id") % 50).cast("double").alias("l_quantity")).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_pixels_are_formed_once(spark, tmp_path):
    from siliscope.plans import demo, search_queries
    sf = _line_items(spark, tmp_path, 5000)
    plain, shared = demo.pixels(spark, sf), search_queries.shared_pixels(spark, sf)
    assert shared.schema.simpleString().count("int") == plain.schema.simpleString().count("int") and set(shared.columns) == set(plain.columns)
    same = shared.select(plain.columns)
    assert plain.filter("sample_id is null").count() > 0
    assert plain.exceptAll(same).count() == same.exceptAll(plain).count() == 0
    assert not any("lineitem" in f for f in search_queries.wafer_features(spark, sf).inputFiles())


def test_pixel_code_is_small_enough_to_be_compiled(spark, tmp_path, capsys):
    import re
    from siliscope.plans import demo
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        demo.pixels(spark, _line_items(spark, tmp_path, 500)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_cells_come_from_the_shared_pixels(spark, tmp_path):
    from siliscope.plans import demo
    from siliscope.plans.map_queries import G, cells
    sf = _line_items(spark, tmp_path, 3000)
    found, plain = cells(spark, sf), pooling.pooled(demo.pixels(spark, sf), G, C.PATTERN_CLASSES)
    assert not any("lineitem" in f for f in found.inputFiles())
    assert found.exceptAll(plain).count() == plain.exceptAll(found).count() == 0


def test_regions_come_from_the_shared_pixels(spark, tmp_path, monkeypatch):
    from siliscope.plans import demo, region_queries, search_queries
    sf = _line_items(spark, tmp_path, 3000)
    plain = regions.region_rows(demo.pixels(spark, sf)).select("sample_id", "class_name", "feature_key", F.round("pixel_ratio", 9).alias("r"))
    search_queries.shared_pixels(spark, sf)
    monkeypatch.setattr(demo, "pixels", lambda *_: pytest.fail("pixels formed anew"))
    found = region_queries.region_table(spark, sf).select("sample_id", "class_name", "feature_key", F.round("pixel_ratio", 9).alias("r"))
    assert found.exceptAll(plain).count() == plain.exceptAll(found).count() == 0


def test_reconciliation_counts_the_shared_pixels(spark, tmp_path, monkeypatch):
    from siliscope.plans import demo, registry, review_queries, search_queries
    sf = _line_items(spark, tmp_path, 3000)
    rng = np.random.default_rng(2)
    spark.range(3).withColumnRenamed("id", "doc_id").write.parquet(f"{sf}/documents.parquet")
    spark.range(2).withColumnRenamed("id", "doc_id").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(10)], "vec_id long, embedding array<float>").write.parquet(f"{sf}/embeddings.parquet")
    search_queries.shared_pixels(spark, sf)
    monkeypatch.setattr(demo, "pixels", lambda *_: pytest.fail("pixels formed anew"))
    rows = {r["name"]: (r["expected"], r["found"], r["passed"]) for r in registry.QUERIES["s16_reconciliation"](spark, sf).collect()}
    assert rows["labelled documents"] == (3, 2, False) and rows["neighbors"] == (10, 50, True)
    assert rows["features"][1] == 16 and review_queries.shared_pixels is search_queries.shared_pixels
