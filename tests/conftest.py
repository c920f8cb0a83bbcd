import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    from siliscope.session import local_session
    return local_session(8)


def pixel_table(spark, severity, in_wafer=None, valid=None, stby=None, classes=None, sample_id="s"):
    """Pixel table of a small dense map, with chips of one pixel unless regrouped by the caller."""
    import numpy as np
    from siliscope import constants as C
    severity = np.asarray(severity)
    h, w = severity.shape
    in_wafer = np.ones((h, w), int) if in_wafer is None else np.asarray(in_wafer)
    stby = np.zeros((h, w), int) if stby is None else np.asarray(stby)
    valid = ((in_wafer > 0) & (stby == 0)).astype(int) if valid is None else np.asarray(valid)
    classes = classes or {}
    y, x = np.divmod(np.arange(h * w), w)
    d2 = (2 * y - (h - 1)) ** 2 + (2 * x - (w - 1)) ** 2
    inside = in_wafer.ravel() > 0
    extent = int(d2[inside].max())
    rows = [(sample_id, int(y[i]), int(x[i]), int(severity.flat[i]), int(in_wafer.flat[i]), int(valid.flat[i]), int(stby.flat[i]),
             int(y[i]), int(x[i]), h, w, int(d2[i]), extent, *[int(np.asarray(classes.get(c, np.zeros((h, w)))).flat[i]) for c in C.PATTERN_CLASSES])
            for i in range(h * w)]
    schema = ("sample_id string, y int, x int, severity int, in_wafer int, valid int, stby int, chip_row int, chip_col int, height int, "
              "width int, d2 int, wafer_extent int, " + ", ".join(f"{c} int" for c in C.PATTERN_CLASSES))
    return spark.createDataFrame(rows, schema)
