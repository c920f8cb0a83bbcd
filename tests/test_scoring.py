"""Stored encoders: versions, refusal of what does not fit, and one-call scoring against NumPy."""
import json
import math

import numpy as np
import pytest
from conftest import pixel_table
from pyspark.sql import functions as F

from siliscope.operators import models, scoring
from siliscope.operators.geometry import Geometry
from siliscope.sources import arrays, model_store

SIZE, LABELS = 2, ("scratch", "ring")


def encoder(seed=3, size=SIZE):
    rng = np.random.default_rng(seed)
    n = 4 * size * size
    return models.Encoder(rng.random(n) / 4, np.full(n, 0.5), rng.normal(size=(n, 5)), rng.normal(size=5), rng.normal(size=(5, 3)), rng.normal(size=3),
                          rng.normal(size=(3, 2)), rng.normal(size=2), LABELS)


def wafer(spark, name, severity, **more):
    px = pixel_table(spark, severity, sample_id=name, **more)
    return px.withColumn("chip_id", (F.col("chip_row") * 4 + F.col("chip_col")).cast("int"))


GEO = Geometry(4, 4, 1, 1, 4, 4, 16)


def test_versions_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "store")
    assert model_store.versions(spark, path) == []
    with pytest.raises(ValueError, match="no version"):
        model_store.load(spark, path)
    reference = spark.createDataFrame([("a", [1.0, 0.0, 0.0], [1, 0])], "id string, embedding array<double>, y array<int>")
    first, second = encoder(1), encoder(2)
    assert model_store.save(spark, first, path, reference, SIZE) == 1
    assert model_store.save(spark, second, path) == 2
    assert model_store.versions(spark, path) == [1, 2]
    assert np.array_equal(model_store.load(spark, path).w1, second.w1) and np.array_equal(model_store.load(spark, path, 1).w1, first.w1)
    assert model_store.output_size(spark, path, 1) == SIZE and model_store.output_size(spark, path) == 0
    good, odd = model_store.load_reference(spark, path, first, 1)
    assert good.count() == 1 and odd.count() == 0
    assert model_store.load_reference(spark, path, second)[0].count() == 0  # published without one
    with pytest.raises(ValueError, match="no version"):
        model_store.load(spark, path, 3)


def test_models_that_do_not_fit_are_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    model_store.save(spark, encoder(), path, output_size=SIZE)
    row = spark.read.parquet(f"{path}/model/version=1")
    row.withColumn("format", F.lit("encoder/v0")).write.parquet(f"{path}/model/version=2")
    row.withColumn("b1", F.array(F.lit(0.0))).write.parquet(f"{path}/model/version=3")
    with pytest.raises(ValueError, match="unknown model version"):
        model_store.load(spark, path, 2)
    with pytest.raises(ValueError, match="unexpected size"):
        model_store.load(spark, path, 3)
    px = wafer(spark, "w", np.ones((4, 4), int))
    model_store.save(spark, encoder(), str(tmp_path / "flat"))
    with pytest.raises(ValueError, match="input tensors"):
        scoring.score_pixels(spark, px, GEO, str(tmp_path / "flat"))
    wide = spark.createDataFrame([("a", [1.0], [1, 0])], "id string, embedding array<double>, y array<int>")
    model_store.save(spark, encoder(), str(tmp_path / "wide"), wide, SIZE)
    with pytest.raises(ValueError, match="width"):
        scoring.score_pixels(spark, px, GEO, str(tmp_path / "wide"))


def test_scoring_equals_numpy_and_skips_what_fails(spark, tmp_path):
    rng = np.random.default_rng(9)
    maps = {f"w{i}": rng.integers(0, 8, (4, 4)) for i in range(6)}
    px = None
    for name, severity in maps.items():
        one = wafer(spark, name, severity)
        px = one if px is None else px.unionByName(one)
    px = px.unionByName(wafer(spark, "high", np.full((4, 4), 9))).unionByName(wafer(spark, "blank", np.zeros((4, 4), int), valid=np.zeros((4, 4), int)))
    model = encoder()
    stored = [(f"r{i}", e.tolist(), [i % 2, 1]) for i, e in enumerate(rng.normal(size=(5, 3)))]
    reference = spark.createDataFrame(stored, "id string, embedding array<double>, y array<int>")
    path = str(tmp_path / "store")
    model_store.save(spark, model, path, reference, SIZE)
    lost = spark.createDataFrame([("gone", ["file is missing", "second"])], "sample_id string, errors array<string>")
    got = scoring.score_pixels(spark, px, GEO, path, k=2, unreadable=lost)
    rows = {r.sample_id: r for r in got.predictions.collect()}
    assert sorted(rows) == sorted([*maps, "high", "blank", "gone"])
    for name in ("high", "blank", "gone"):
        assert (rows[name].status, rows[name].scoring_status) == ("FAIL", "SKIPPED") and rows[name].prob_ring is None and rows[name].top_label_hint is None
    assert rows["gone"].errors == "file is missing; second" and "sample has no valid tested pixels" in rows["blank"].errors
    near = got.neighbors.collect()
    assert {r.query_id for r in near} == set(maps)
    for name, severity in maps.items():
        block = severity.reshape(2, 2, 2, 2).mean((1, 3)).ravel() / 7
        vec = np.concatenate([block, np.ones(8), np.zeros(4)])
        _, _, z, logits = model.forward(vec[None])
        e, p = z[0] / np.linalg.norm(z[0]), 1 / (1 + np.exp(-logits[0]))
        r = rows[name]
        assert (r.status, r.scoring_status, r.errors) == ("PASS", "SCORED", "")
        assert np.allclose([r.prob_scratch, r.prob_ring], p) and np.allclose([r.embedding_00, r.embedding_01, r.embedding_02], e)
        entropy = float(np.mean(-(p * np.log(p) + (1 - p) * np.log(1 - p))))
        assert r.top_label_hint == LABELS[int(p.argmax())] and math.isclose(r.mean_binary_entropy, entropy) and math.isclose(r.confidence_margin, abs(p[0] - p[1]))
        cos = sorted(((-float(np.dot(e, s) / np.linalg.norm(s)), i, y) for i, s, y in stored))[:2]
        own = sorted((n for n in near if n.query_id == name), key=lambda n: n.rank)
        assert [n.neighbor_id for n in own] == [i for _, i, _ in cos] and np.allclose([n.similarity for n in own], [-c for c, _, _ in cos])
        assert [[n.neighbor_has_scratch, n.neighbor_has_ring] for n in own] == [y for _, _, y in cos]


def test_scoring_without_stored_wafers_or_passing_ones(spark, tmp_path):
    path = str(tmp_path / "store")
    model_store.save(spark, encoder(), path, output_size=SIZE)
    got = scoring.score_pixels(spark, wafer(spark, "high", np.full((4, 4), 9)), GEO, path)
    assert [(r.status, r.scoring_status) for r in got.predictions.collect()] == [("FAIL", "SKIPPED")]
    assert got.neighbors.count() == 0 and "neighbor_has_ring" in got.neighbors.columns


def test_manifest_in_one_call(spark, tmp_path):
    px = wafer(spark, "w1", np.arange(16).reshape(4, 4) % 8)
    arrays.write_archives(px, str(tmp_path)).collect()
    entries = [{"sample_id": "w1", "source_type": "npz_semantic_arrays", "arrays_npz": "w1/arrays.npz"},
               {"sample_id": "w2", "source_type": "npz_semantic_arrays", "arrays_npz": "w2/arrays.npz"}]
    (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": "real_unlabeled_manifest/v1", "samples": entries}))
    path = str(tmp_path / "store")
    model_store.save(spark, encoder(), path, output_size=SIZE)
    got = scoring.score_manifest(spark, str(tmp_path / "manifest.json"), GEO, path)
    assert {(r.sample_id, r.status, r.scoring_status) for r in got.predictions.collect()} == {("w1", "PASS", "SCORED"), ("w2", "FAIL", "SKIPPED")}


def test_evaluation_by_hand(spark):
    model, rng = encoder(), np.random.default_rng(4)
    vectors = rng.random((8, 16))
    y = rng.integers(0, 2, (8, 2))
    rows = spark.createDataFrame([(f"s{i}", v.tolist(), t.tolist(), int(t[0] + 2 * t[1])) for i, (v, t) in enumerate(zip(vectors, y))],
                                 "id string, vec array<double>, y array<int>, signature long")
    reference, queries = rows.filter("id < 's5'"), rows.filter("id >= 's5'")
    loss, per_class, found = scoring.evaluate(model, reference, queries, k=2)
    p = 1 / (1 + np.exp(-model.forward(vectors[5:])[3]))
    ce = -(y[5:] * np.log(p + 1e-6) + (1 - y[5:]) * np.log(1 - p + 1e-6))
    assert math.isclose(loss.first()["bce"], ce.mean())
    by_class = {r.class_name: r for r in per_class.collect()}
    for i, name in enumerate(LABELS):
        assert math.isclose(by_class[name].bce, ce[:, i].mean()) and by_class[name].positives == y[5:, i].sum()
        assert by_class[name].predicted == (p[:, i] >= 0.5).sum()
    assert 0 <= found.first()["topk_mean_jaccard"] <= 1
