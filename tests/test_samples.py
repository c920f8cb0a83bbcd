"""Sample folders: pixels and metadata, or an error row, for every folder."""
import json

import numpy as np
import pytest
from conftest import pixel_table

from siliscope import constants as C
from siliscope.operators import review, validation
from siliscope.sources import arrays, samples
from siliscope.sources.sinks import write_files


def test_every_folder_is_a_sample_or_an_error(spark, tmp_path):
    root = str(tmp_path / "set")
    px = None
    for name in ("good", "alone", "list", "other"):
        one = pixel_table(spark, np.arange(6).reshape(2, 3), sample_id=name)
        px = one if px is None else px.unionByName(one)
    arrays.write_archives(px, root)
    classes = list(C.PATTERN_CLASSES)
    document = {"sample_id": "stated", "pattern_classes": classes, "patterns": [{"type": classes[0], "more": 1}], "image_shape": [2, 3], "extra": {}}
    files = {"good/metadata.json": "﻿" + json.dumps(document), "list/metadata.json": "[1]", "empty/metadata.json": json.dumps(document),
             "other/metadata.json": json.dumps(document | {"pattern_classes": classes[::-1], "patterns": [{"type": "smear"}, {"type": classes[1]}]}),
             "broken/metadata.json": json.dumps(document)}
    write_files(spark.createDataFrame([(k, v.encode()) for k, v in files.items()] + [("broken/arrays.npz", b"no archive")], "path string, content binary"), root)
    got = samples.read_samples(spark, root)
    assert {r.sample_id: r.errors for r in got.errors.collect() if r.sample_id != "broken"} == {
        "alone": ["metadata.json is missing"], "list": ["metadata.json is not an object"], "empty": ["arrays.npz is missing"]}
    assert got.errors.filter("sample_id = 'broken'").count() == 1
    assert {r.sample_id: r["count"] for r in got.pixels.groupBy("sample_id").count().collect()} == {"good": 6, "other": 6}
    good = got.metadata.filter("sample_id = 'good'").first()
    assert good.stated_id == "stated" and good.pattern_classes == classes and good.image_shape == [2, 3]
    assert [r.sample_id for r in validation.class_list_errors(got.metadata).collect()] == ["other"]
    assert [tuple(r) for r in validation.pattern_type_errors(got.metadata).collect()] == [("other", "smear")]


def test_review_forms_need_their_columns(spark):
    near = spark.createDataFrame([("q", 1, "n")], "query_sample_id string, rank int, neighbor_sample_id string")
    with pytest.raises(ValueError, match="distance"):
        review.review_form(near)
