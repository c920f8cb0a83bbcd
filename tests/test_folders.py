"""Folders of images without stated geometry, and the file sink."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.operators import validation
from siliscope.operators.geometry import Geometry
from siliscope.sources import arrays, folders, png
from siliscope.sources.sinks import ASIDE, write_files

GRADES = np.array(C.GRADE_GRAYS)


def image(seed, shape=(12, 15), chips=((0, 0), (6, 5)), side=(3, 5)):
    """Random grades without the highest, so that only the named chips have the untested code."""
    gray = GRADES[np.random.default_rng(seed).integers(0, 7, shape)].copy()
    for y, x in chips:
        gray[y:y + side[0], x:x + side[1]] = 255
    return gray


def folder_of(spark, tmp_path, images):
    rows = [(path, png.encode(g.astype(np.uint8)) if isinstance(g, np.ndarray) else g) for path, g in images.items()]
    write_files(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path / "raw"))
    return str(tmp_path / "raw")


def names(df):
    return {r["path"].split("/raw/")[1]: r["error"] for r in df.collect()}


def test_written_images_are_read_as_they_were(spark, tmp_path):
    images = {"p/a.png": image(1), "p/deep/b.png": image(2, (5, 7), ())}
    got = {}
    for r in png.read_gray(spark, folder_of(spark, tmp_path, images)).collect():
        got.setdefault(r["path"].split("/raw/")[1], np.full(images[r["path"].split("/raw/")[1]].shape, -1))[r["y"], r["x"]] = r["gray"]
    assert all((got[k] == v).all() for k, v in images.items()) and set(got) == set(images)
    assert not (tmp_path / "raw" / ASIDE).exists()


def test_files_stay_below_their_folder(spark, tmp_path):
    for path in ("../x", "/x", "a/../../x"):
        with pytest.raises(Exception, match="leaves the folder"):
            write_files(spark.createDataFrame([(path, b"1")], "path string, content binary"), str(tmp_path / "f"))
    assert not (tmp_path / "x").exists() and not (tmp_path / "f" / ASIDE).exists()
    write_files(spark.createDataFrame([("a/b", b"1"), ("c", b"")], "path string, content binary"), f"file:{tmp_path}/g")
    write_files(spark.createDataFrame([("a/b", b"2")], "path string, content binary"), f"file://{tmp_path}/g")  # a task that runs again
    assert (tmp_path / "g" / "a" / "b").read_bytes() == b"2" and (tmp_path / "g" / "c").read_bytes() == b""


def test_products_agree_on_their_grid(spark, tmp_path):
    images = {f"p/{i}.png": image(i) for i in range(3)}
    images["p/plain.png"] = image(9, chips=())                        # shows no chips, fits the grid
    images["p/other.png"] = image(10, chips=((0, 0), (4, 10)), side=(2, 5))  # shows chips of another size
    images["p/small.png"] = image(11, (9, 15), ((3, 0),))              # shows the same chips on another grid
    images["p/odd.png"] = image(12) + 1                                # grays that are no codes
    images["p/broken.png"] = b"not an image"
    images["q/blank.png"] = image(13, chips=())                       # no image of its product shows a chip
    root = folder_of(spark, tmp_path, images)
    wafers = folders.read_folder(spark, root, "s")
    errors = names(wafers.errors)
    assert set(errors) == {"p/other.png", "p/small.png", "p/odd.png", "p/broken.png", "q/blank.png"}
    assert errors["p/other.png"] == "chips differ from the product's" and errors["p/small.png"] == "chip grid does not cover the image"
    assert errors["p/odd.png"] == "unknown gray value" and errors["q/blank.png"].startswith("product has no agreed geometry: ")
    assert [tuple(r)[:5] for r in wafers.geometry.collect()] == [("p", 3, 5, 4, 3)]
    assert wafers.pixels.select("sample_id").distinct().count() == 4
    pixels = wafers.pixels.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("stby").alias("stby"), F.max("chip_id").alias("last")).collect()
    assert sorted(r.stby for r in pixels) == [0, 30, 30, 30] and {r.n for r in pixels} == {180}
    strict = folders.read_folder(spark, root, "s", strict=True)
    assert strict.pixels.count() == 0 and strict.errors.count() == 9


def test_ties_are_no_agreement_and_stated_grids_need_no_vote(spark, tmp_path):
    images = {"p/a.png": image(1), "p/b.png": image(2, (12, 20), ((0, 0),)), "p/c.png": image(3, (24, 25), ())}
    root = folder_of(spark, tmp_path, images)
    tied = folders.read_folder(spark, root, "s")
    assert tied.pixels.count() == 0 and len(names(tied.errors)) == 3
    stated = spark.createDataFrame([("p", 3, 5, 4, 3, 9, "centered_ellipse_from_png")], folders.STATED)
    got = folders.read_folder(spark, root, "s", stated)
    assert names(got.errors) == {"p/b.png": "chip grid does not cover the image", "p/c.png": "chip grid does not cover the image"}
    inside = got.pixels.filter("in_wafer = 1")
    assert got.pixels.count() == 180 and inside.select("chip_id").distinct().count() == 9
    sane = validation.sample_sanity(got.pixels, Geometry(12, 15, 3, 5, 4, 3, 9)).first()
    # the random grades reach beyond the wafer; nothing else is wrong
    assert sane["errors"] == ["severity on invalid-test pixels must be 0", "severity outside wafer_mask must be 0"]


def test_archives_are_written_through_the_sink(spark, tmp_path):
    images = {"p/a.png": image(1), "p/b.png": image(2)}
    wafers = folders.read_folder(spark, folder_of(spark, tmp_path, images), "s")
    held = str(tmp_path / "archives")
    paths = arrays.write_archives(wafers.pixels, held).collect()
    assert len(paths) == 2 and all(r["path"].endswith(f"{r['sample_id']}/arrays.npz") for r in paths)
    back = arrays.read_pixels(arrays.archive_files(spark, held)).select("sample_id", "y", "x", "severity", "in_wafer", "stby", "valid", "chip_id")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wafers.pixels.select(*back.columns).collect()))
