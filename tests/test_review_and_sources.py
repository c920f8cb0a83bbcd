"""Review loop by hand; archives and images written and read back; model store; training against plain numpy."""
import io
import json
import math
import struct
import zlib

import numpy as np
import pytest
from conftest import pixel_table
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.operators import hotspots, models, review, validation
from siliscope.operators.geometry import Geometry
from siliscope.sources import manifest
from siliscope.sources import arrays, catalog, images, model_store, png

REVIEW_SCHEMA = "line_no long, " + ", ".join(f"{c} string" for c in C.REVIEW_COLUMNS)


def reviews(spark):
    def row(line, q, rank, decision, missed, clock, comment=""):
        return (line, f"{q}__{rank}", q, rank, "n", "0.1", decision, "edge", "edge", "edge", clock, missed, "none", "feature_weight_tuning", comment)
    return spark.createDataFrame([row(2, "q1", "1", "same_family", "no", "yes"), row(3, "q1", "2", "partial_match", "yes", "no", "looks like lot ABC123 from C:/secure/raw.npy"),
                                  row(4, "q2", "1.0", " Mismatch ", "no", "not_applicable")], REVIEW_SCHEMA)


def test_review_summary(spark):
    m = review.review_metrics(reviews(spark), 5).first()
    assert math.isclose(m["same_family_rate"], 1 / 3) and math.isclose(m["accepted_match_rate"], 2 / 3)
    assert (m["query_topk_same_family_rate"], m["query_topk_accept_rate"], m["query_missed_major_defect_rate"]) == (0.5, 0.5, 0.5)
    assert m["clock_position_accept_rate"] == 0.5 and m["valid_review_rows"] == 3
    assert review.next_actions(reviews(spark)).first()["review_rows"] == 3
    assert review.invalid_values(reviews(spark)).count() == 0


def test_sensitive_comment(spark):
    flags = {r["issue"] for r in review.sensitive_flags(reviews(spark), "safe_comment", ["line_no"]).collect()}
    assert flags == {"lot_identifier", "windows_path", "unix_sensitive_path"}


def test_distance_text(spark):
    values = ["0.000012345678", "1.5", "123456.789", "1234567.89", "0", "abc", "", "100", "0.1234567"]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    got = [r[0] for r in df.select(review.format_distance(F.col("d"))).collect()]
    want = [f"{float(v):.6g}" if v not in ("abc", "") else v for v in values]
    assert got == want


def test_sanity_rules(spark):
    geo = Geometry(4, 4, 2, 2, 2, 2, 4)
    sev, stby = np.zeros((4, 4), int), np.zeros((4, 4), int)
    sev[:2, :2] = 2
    stby[2:, 2:] = 1
    px = pixel_table(spark, sev, stby=stby).withColumn("chip_id", (F.floor(F.col("y") / 2) * 2 + F.floor(F.col("x") / 2)).cast("int"))
    row = validation.sample_sanity(px, geo).first()
    assert row["errors"] == [] and row["warnings"] == [] and row["stby_chip_count_est"] == 1.0
    bad = px.withColumn("severity", F.when(F.col("stby") == 1, 7).otherwise(F.col("severity")))
    assert "stby pixels must have severity 0" in validation.sample_sanity(bad, geo).first()["errors"]


def archive(**extra):
    sev = np.zeros((4, 4), np.uint8)
    sev[:2, :2] = 2
    stby = np.zeros((4, 4), np.uint8)
    stby[2:, 2:] = 1
    data = {"severity": sev, "wafer_mask": np.ones((4, 4), np.uint8), "stby_mask": stby, "valid_test_mask": 1 - stby} | extra
    data = {k: v for k, v in data.items() if v is not None}
    buf = io.BytesIO()
    np.savez_compressed(buf, **data)
    return buf.getvalue()


def test_archives(spark, tmp_path):
    for name, blob in (("good", archive()), ("nan", archive(severity=np.full((4, 4), np.nan))), ("frac", archive(severity=np.full((4, 4), 0.5))),
                       ("shape", archive(wafer_mask=np.ones((2, 2), np.uint8))), ("grade", archive(severity=np.full((4, 4), 9))), ("junk", b"not an archive"), ("novalid", archive(valid_test_mask=None))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "arrays.npz").write_bytes(blob)
    files = arrays.archive_files(spark, str(tmp_path)).withColumn("chip_blocks", F.struct(F.lit(2).alias("width"), F.lit(2).alias("height")))
    px = arrays.read_pixels(files)
    assert {r["sample_id"] for r in px.select("sample_id").distinct().collect()} == {"good"}
    lenient = arrays.read_pixels(files, allow_missing=True)
    assert {r["sample_id"] for r in lenient.select("sample_id").distinct().collect()} == {"good", "novalid"}
    assert px.filter("valid = 1").count() == 12 and px.agg(F.max("chip_id")).first()[0] == 3
    errors = {r["sample_id"]: r["errors"] for r in arrays.read_errors(files).collect()}
    assert set(errors) == {"nan", "frac", "shape", "grade", "junk", "novalid"} and errors["novalid"] == ["valid_test_mask is missing"]
    out = tmp_path / "out"
    assert arrays.write_archives(px, str(out)).count() == 1
    again = arrays.read_pixels(arrays.archive_files(spark, str(out)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, px.collect()))


def write_png(path, samples, colour, depth=8, filters=(0,)):
    samples = np.asarray(samples, dtype=np.uint8)
    h, w = samples.shape[:2]
    lines = samples.reshape(h, -1).astype(int)
    bpp = lines.shape[1] // w
    raw, above = b"", np.zeros(lines.shape[1], int)
    for i in range(h):
        f, cur = filters[i % len(filters)], lines[i]
        left = np.concatenate([np.zeros(bpp, int), cur[:-bpp]])
        corner = np.concatenate([np.zeros(bpp, int), above[:-bpp]])
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        guess = {0: 0 * cur, 1: left, 2: above, 3: (left + above) // 2, 4: np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))}[f]
        raw += bytes([f]) + ((cur - guess) % 256).astype(np.uint8).tobytes()
        above = cur

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_png_filters(tmp_path):
    rng = np.random.default_rng(0)
    for colour, ch in ((0, 1), (4, 2), (2, 3), (6, 4)):
        s = rng.integers(0, 256, (7, 5, ch))
        write_png(tmp_path / "a.png", s, colour, filters=(0, 1, 2, 3, 4))
        assert (png.decode((tmp_path / "a.png").read_bytes()) == s).all()


def test_png_folder(spark, tmp_path):
    gray = np.array([[0, 31], [151, 255]])
    root = tmp_path / "raw"
    write_png(root / "p1" / "l.png", gray, 0)
    write_png(root / "p1" / "la.png", np.dstack([gray, np.full((2, 2), 255)]), 4)
    write_png(root / "p1" / "la_clear.png", np.dstack([gray, np.full((2, 2), 9)]), 4)
    write_png(root / "p2" / "rgb.png", np.dstack([gray] * 3), 2)
    write_png(root / "p2" / "colour.png", np.dstack([gray, gray, gray * 0 + 7]), 2)
    write_png(root / "p2" / "deep.png", np.dstack([gray, gray]), 0, depth=16)
    rows = png.read_gray(spark, str(root)).collect()
    per = {}
    for r in rows:
        per.setdefault(r["path"].split("/")[-1], {})[(r["y"], r["x"])] = r["gray"]
    assert set(per) == {"l.png", "la.png", "rgb.png"}
    assert all(v == {(0, 0): 0, (0, 1): 31, (1, 0): 151, (1, 1): 255} for v in per.values())
    bad = {r["path"].split("/")[-1] for r in png.read_errors(spark, str(root)).collect()}
    assert bad == {"la_clear.png", "colour.png", "deep.png"}
    products = catalog.discover(spark, str(root)).groupBy("product").count().collect()
    assert {r["product"]: r["count"] for r in products} == {"p1": 3, "p2": 3}


def test_partial_255_stays_a_grade(spark):
    gray = np.array([[255, 255, 0, 31], [255, 255, 151, 255]])
    raw = spark.createDataFrame([("s", "p", y, x, int(gray[y, x]), 2, 4) for y in range(2) for x in range(4)],
                                "sample_id string, product string, y int, x int, gray int, height int, width int")
    geo = spark.createDataFrame([("p", 2, 2, 1, 2, 0, "full_grid_from_png")], "product string, chip_h int, chip_w int, rows int, cols int, net_die int, mask_strategy string")
    got = {(r["y"], r["x"]): (r["severity"], r["stby"], r["valid"]) for r in images.assemble(raw, geo).collect()}
    assert got[(0, 0)] == (0, 1, 0) and got[(1, 3)] == (7, 0, 1) and got[(0, 3)] == (1, 0, 1)


def test_wafers_from_a_folder(spark, tmp_path):
    rng = np.random.default_rng(4)
    gray = rng.choice(C.GRADE_GRAYS, size=(6, 8)).astype(int)
    gray[0:3, 2:4] = 255
    gray[3, 0] = 0
    root = tmp_path / "raw"
    write_png(root / "p" / "a.png", gray, 0)
    write_png(root / "q" / "b.png", np.dstack([gray, np.full((6, 8), 255)]), 4)
    geo = spark.createDataFrame([(p, 3, 2, 2, 4, 0, "full_grid_from_png") for p in ("p", "q")],
                                "product string, chip_h int, chip_w int, rows int, cols int, net_die int, mask_strategy string")
    direct = images.read_wafers(spark, str(root), geo, "s")
    raw = png.read_gray(spark, str(root)).withColumns({"product": F.element_at(F.split("path", "/"), -2), "sample_id": F.col("path")})
    joined = images.assemble(raw, geo)
    cols = ["product", "y", "x", "severity", "stby", "valid", "in_wafer", "wafer_extent", "d2"]
    a, b = (sorted(map(tuple, d.select(*cols).collect())) for d in (direct, joined))
    assert a == b and len(a) == 96 and sum(r[4] for r in a) >= 12
    assert direct.select("sample_id").distinct().count() == 2


def test_nested_folders_keep_products_and_names_apart(spark, tmp_path):
    """The product is the first folder below the root, whatever that is called; equal file names stay two wafers."""
    gray = np.array([[0, 31], [151, 255]])
    root = tmp_path / "r.+w"
    for place in ("p/a/x.png", "p/b/x.png", "q/r.+w/x.png", "stray.png", "nogeo/x.png"):
        write_png(root / place, gray, 0)
    found = {(r["product"], r["relative_path"]) for r in catalog.discover(spark, str(root)).collect()}
    assert found == {("p", "a/x.png"), ("p", "b/x.png"), ("q", "r.+w/x.png"), ("nogeo", "x.png")}
    geo = spark.createDataFrame([(p, 1, 1, 2, 2, 0, "full_grid_from_png") for p in ("p", "q")],
                                "product string, chip_h int, chip_w int, rows int, cols int, net_die int, mask_strategy string")
    got = images.read_wafers(spark, str(root), geo, "s")
    per = got.groupBy("product", "sample_id").count().collect()
    assert sorted((r["product"], r["count"]) for r in per) == [("p", 4), ("p", 4), ("q", 4)]
    assert [(r["product"], r["error"]) for r in images.unplaced_files(spark, str(root), geo).collect()] == [("nogeo", "product has no geometry")]
    flat = tmp_path / "flat"
    write_png(flat / "x.png", gray, 0)
    assert [(r["product"], r["relative_path"]) for r in catalog.discover(spark, str(flat)).collect()] == [("flat", "x.png")]


def test_images_that_a_grid_does_not_cover(spark):
    raw = spark.createDataFrame([(s, p, 0, 0, 0, 2, 2) for s, p in (("a", "p"), ("b", "q"), ("c", "none"))],
                                "sample_id string, product string, y int, x int, gray int, height int, width int")
    geo = spark.createDataFrame([("p", 1, 1, 2, 2), ("q", 1, 1, 1, 2)], "product string, chip_h int, chip_w int, rows int, cols int")
    assert {(r["sample_id"], r["error"]) for r in images.assembly_errors(raw, geo).collect()} == {
        ("b", "chip grid does not cover the image"), ("c", "product has no geometry")}


def test_manifest_and_geometry_documents(spark, tmp_path):
    sample = "product_0123456789_w0123456789"
    doc = spark.createDataFrame([(sample, C.SOURCE_PNG, "a.png", True, True)], "sample_id string, source_type string, png_path string, pseudonymized boolean, allow_geometry_inference boolean")
    catalog.manifest_lines(doc).coalesce(1).write.json(str(tmp_path / "m"))
    rows = catalog.read_manifest(spark, str(tmp_path / "m")).collect()
    assert len(rows) == 1 and rows[0]["sample_id"] == sample and rows[0]["schema_version"] == C.MANIFEST_VERSION
    (tmp_path / "g.json").write_text('\ufeff{"p": {"chip_blocks": {"width": 2, "height": 3}, "grid": {"rows": 2, "cols": 4}, "actual_net_die": 9}}')
    geo = validation.geometry_rows(catalog.read_geometry(spark, str(tmp_path / "g.json"))).first()
    assert geo["product"] == "p" and geo["errors"] == ["net die exceeds the grid"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", 1.5), ("b", "val", 2.5)], "id string, split string, v double")
    catalog.write_table(df, str(tmp_path / "t"), "csv")
    back = catalog.read_csv(spark, str(tmp_path / "t"), "id string, split string, v double", split="val")
    assert [tuple(r) for r in back.collect()] == [("b", "val", 2.5)]


def test_binomial_tail_and_q_values(spark):
    for n, p in ((4, 0.3), (30, 0.01), (200, 0.7)):
        for k in (0, 1, 2, n // 2, n):
            want = sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k, n + 1))
            assert math.isclose(hotspots.binomial_tail(np.array([k]), np.array([n]), np.array([p]))[0], want, rel_tol=1e-9, abs_tol=1e-300)
    assert 0 < hotspots.binomial_tail(np.array([50_050_000]), np.array([100_000_000]), np.array([0.5]))[0] < 1e-10
    p = [0.01, 0.04, 0.03, 0.5]
    rows = spark.createDataFrame([("g", i, v, 6) for i, v in enumerate(p)], "g string, i int, p double, tests int")
    got = {r["i"]: r["q_value"] for r in hotspots.benjamini_hochberg(rows, "g", "p", "tests", ["i"]).collect()}
    full = np.array(p + [1.0, 1.0])
    order = np.argsort(full)
    q = np.minimum.accumulate((full[order] * 6 / np.arange(1, 7))[::-1])[::-1]
    for place, i in enumerate(order):
        if i < 4:
            assert math.isclose(got[int(i)], q[place])


def plain_step(m, v, y, rate, pw, l2):
    """One full-batch step with the pair matrix written out."""
    x, h, z, g = m.forward(v)
    p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    n, c = y.shape
    d = z.shape[1]
    inter, union = y @ y.T, (y[:, None] + y[None] > 0).sum(2)
    target = np.where(union == 0, 1.0, inter / np.maximum(union, 1))
    diff = z @ z.T / d - target
    dl = (p - y) / (n * c)
    dz = (dl @ m.wc.T + pw * 4 / (n * n * d) * diff @ z) * (1 - z * z)
    dh = dz @ m.w2.T * (1 - h * h)
    return ((m.w1 - rate * (x.T @ dh + l2 * m.w1)), (m.w2 - rate * (h.T @ dz + l2 * m.w2)), (m.wc - rate * (z.T @ dl + l2 * m.wc)), (diff ** 2).mean())


def test_training_step_equals_plain_numpy(spark, tmp_path):
    rng = np.random.default_rng(7)
    v, y = rng.normal(size=(30, 6)), (rng.random((30, 3)) < 0.4).astype(float)
    rows = spark.createDataFrame([(f"w{i}", v[i].tolist(), y[i].astype(int).tolist(), int(y[i] @ [1, 2, 4])) for i in range(30)],
                                 "id string, vec array<double>, y array<int>, signature long")
    start = models.new_encoder(rows, 5, 4, ("a", "b", "c"))
    w1, w2, wc, pair = plain_step(start, v, y, 0.3, 0.5, 1e-3)
    after, history = models.train_encoder(start, rows, 3, 0.3, 0.5, 1e-3)
    once, first = models.train_encoder(start, rows, 1, 0.3, 0.5, 1e-3)
    assert np.allclose(once.w1, w1) and np.allclose(once.w2, w2) and np.allclose(once.wc, wc) and math.isclose(first[0]["pairwise"], pair)
    assert history[-1]["total"] < history[0]["total"]
    model_store.save(spark, after, str(tmp_path / "m"), models.encode(after, rows))
    loaded = model_store.load(spark, str(tmp_path / "m"))
    assert np.allclose(loaded.w1, after.w1) and loaded.labels == ("a", "b", "c")
    good, odd = model_store.load_reference(spark, str(tmp_path / "m"), loaded)
    assert good.count() == 30 and odd.count() == 0


def test_scoring_keeps_rows_without_input(spark):
    rng = np.random.default_rng(1)
    m = models.Encoder(np.zeros(2), np.ones(2), rng.normal(size=(2, 3)), np.zeros(3), rng.normal(size=(3, 2)), np.zeros(2), rng.normal(size=(2, 2)), np.zeros(2), ("a", "b"))
    rows = spark.createDataFrame([("x", [1.0, 2.0]), ("y", None)], "id string, vec array<double>")
    got = {r["id"]: r["probs"] for r in models.encode(m, rows).collect()}
    assert got["y"] is None and np.allclose(got["x"], 1 / (1 + np.exp(-m.forward(np.array([[1.0, 2.0]]))[3][0])))


def test_segmentation_loss_falls(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), int(a > 0.6)) for a in rng.random(200)]
    cells = spark.createDataFrame(rows, "c double, t int")
    w, b, losses = models.linear_segmentation(cells, ["c"], ["t"], 5, 1.0)
    assert losses[-1] < losses[0] and w[0, 0] > 0 and len(losses) == 6


@pytest.mark.parametrize("runs", [5])
def test_fragile_pairs_match_all_pairs(spark, monkeypatch, runs):
    rng = np.random.default_rng(3)
    n = 40
    base, labels = rng.integers(0, 2, n), rng.integers(0, 3, (runs, n))
    labels[:, :13] = labels[:, :1]
    ids = [f"w{i:02d}" for i in range(n)]
    b = spark.createDataFrame([(ids[i], int(base[i])) for i in range(n)], "id string, cluster_id int")
    r = spark.createDataFrame([(k, ids[i], int(labels[k, i])) for k in range(runs) for i in range(n)], "run int, id string, cluster_id int")
    monkeypatch.setattr(models, "PAIR_BLOCK", 6)
    got = {(x["cluster_id"], x["place"], x["left_id"], x["right_id"]) for x in models.fragile_pairs(b, r, runs).collect()}
    want = set()
    for c in (0, 1):
        pairs = sorted((round((labels[:, i] == labels[:, j]).mean(), 9), ids[i], ids[j]) for i in range(n) for j in range(i + 1, n) if base[i] == base[j] == c)
        want |= {(c, p + 1, l, q) for p, (_, l, q) in enumerate(pairs[:3])}
    assert got == want


def test_every_manifest_entry_is_pixels_or_an_error(spark, tmp_path):
    gray = np.array(C.GRADE_GRAYS)[np.arange(48).reshape(6, 8) % 7]
    gray[0:3, 2:4] = 255
    write_png(tmp_path / "in" / "stated.png", gray, 0)
    write_png(tmp_path / "in" / "inferred.png", gray, 0)
    write_png(tmp_path / "in" / "odd.png", gray * 0 + 99, 0)
    (tmp_path / "in" / "a.npz").write_bytes(archive())
    (tmp_path / "in" / "masks.npz").write_bytes(archive(stby_mask=None))
    (tmp_path / "in" / "junk.npz").write_bytes(b"no archive")
    (tmp_path / "in" / "dir").mkdir()
    (tmp_path / "in" / "dir" / "arrays.npz").write_bytes(archive())
    blocks, grid = {"width": 2, "height": 3}, {"rows": 2, "cols": 4}
    png_entry = {"source_type": C.SOURCE_PNG, "wafer_mask_strategy": "full_grid_from_png"}
    doc = {"schema_version": C.MANIFEST_VERSION, "feature_schema_version": C.FEATURE_VERSION, "samples": [
        {"sample_id": "stated", "png_path": "in/stated.png", "chip_blocks": blocks, "grid": grid, **png_entry},
        {"sample_id": "bare", "png_path": "in/stated.png", **png_entry},
        {"sample_id": "inferred", "png_path": str(tmp_path / "in/inferred.png"), "allow_geometry_inference": True, **png_entry},
        {"sample_id": "uneven", "png_path": "in/stated.png", "chip_blocks": {"width": 3, "height": 3}, **png_entry},
        {"sample_id": "odd", "png_path": "in/odd.png", "chip_blocks": blocks, **png_entry},
        {"arrays_npz": "in/a.npz", "chip_blocks": {"width": 2, "height": 2}}, {"sample_id": "masks", "arrays_npz": "in/masks.npz"},
        {"sample_id": "junk", "arrays_npz": "in/junk.npz"}, {"sample_id": "gone", "arrays_npz": "in/gone.npz"},
        {"sample_id": "dir", "source_type": C.SOURCE_DIR, "sample_dir": "in/dir/"}, {"sample_id": "strange", "source_type": "tape"}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    pixels, errors = manifest.read(spark, str(tmp_path / "m.json"))
    wrong = {r["sample_id"]: r["errors"] for r in errors.collect()}
    per = {r["sample_id"]: r["count"] for r in pixels.groupBy("sample_id").count().collect()}
    assert per == {"stated": 48, "inferred": 48, "a": 16, "dir": 16}
    assert not set(per) & set(wrong) and set(per) | set(wrong) == {"stated", "bare", "inferred", "uneven", "odd", "a", "masks", "junk", "gone", "dir", "strange"}
    assert wrong["gone"] == ["file is missing"] and wrong["odd"] == ["unknown gray value"] and wrong["strange"] == ["unsupported source type: tape"]
    assert wrong["masks"] == ["stby_mask is missing"] and wrong["bare"] == ["chip_blocks or grid needed"]
    stated = {(r["y"], r["x"]): r for r in pixels.filter("sample_id = 'stated'").collect()}
    assert stated[(0, 2)]["stby"] == 1 and stated[(0, 2)]["severity"] == 0 and stated[(5, 7)]["severity"] == 47 % 7 and stated[(5, 7)]["valid"] == 1
