from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402

SF_TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def make_stream(spark):
    """Stream from lists: idx = position, clock one second apart, flags default to false."""

    def build(pressure, det=(), fwhm=(), wide=(), p=None, parts=3):
        rows = [
            (i, 1000 + i, float(v), i in set(det), i in set(fwhm), i in set(wide), float(p[i]) if p is not None else 0.0)
            for i, v in enumerate(pressure)
        ]
        schema = (
            "idx long, sclk long, pressure double, gt_detection_win boolean, gt_fwhm boolean, gt_4xfwhm boolean, p double"
        )
        return spark.createDataFrame(rows, schema).repartition(parts)

    return build
