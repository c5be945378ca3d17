"""Block-wise resampling against rows of pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import pixels, resample, tiles, warp

HIGH, WIDE, BLOCK = 75, 90, 32
RNG = np.random.default_rng(6)
IMAGE = RNG.integers(0, 6, (2, HIGH, WIDE)).astype(np.float64)
MISSING = RNG.random((2, HIGH, WIDE)) < 0.15
MISSING[:, 30:60, 40:60] = True


@pytest.fixture(scope="module")
def rows(spark):
    b, r, c = np.indices(IMAGE.shape)
    data = [(int(b_) + 1, int(r_), int(c_), None if m else float(v)) for b_, r_, c_, v, m in zip(b.ravel(), r.ravel(), c.ravel(), IMAGE.ravel(), MISSING.ravel())]
    return spark.createDataFrame(data, "band int, row long, col long, value double").cache()


def as_dict(df):
    return {(r["band"], r["row"], r["col"]): r["value"] for r in df.collect() if r["value"] is not None}


def same(got, want):
    assert set(got) == set(want) and want
    assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-9)


@pytest.mark.parametrize("method, step", [("nearest", 2.5), ("nearest", 0.7), ("bilinear", 1.7), ("bilinear", 0.6), ("cubic", 3.0), ("cubic_spline", 0.8), ("lanczos", 1.3), ("average", 2.5), ("average", 9.0), ("rms", 3.3), ("sum", 2.0), ("mode", 2.5)])
def test_warp_in_blocks_equals_pixels(spark, rows, method, step):
    high, wide = int(HIGH / step), int(WIDE / step)
    to, source = (step, 0.0, 1.0, 0.0, step, 0.5), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    places = warp.source_place(warp.output_grid(spark, wide, high), to, source)
    want = as_dict(warp.warp(rows, places, method, ("band",), (step, step)))
    blocks = tiles.from_pixels(rows, 0, BLOCK, 2, "float64", -9.0)
    made = resample.resample(blocks, BLOCK, 2, "float64", (HIGH, WIDE), (high, wide), resample.placing(to, source), method, (step, step), 0, -8.0, -9.0)
    got = as_dict(tiles.to_pixels(made, BLOCK, 2, "float64", wide, high, -8.0))
    same(got, {k: v for k, v in want.items()})


@pytest.mark.parametrize("method, factor", [("bilinear", 2), ("cubic", 4), ("cubic_spline", 2), ("lanczos", 2), ("gauss", 4), ("average", 3), ("mode", 5), ("nearest", 3), ("rms", 3)])
def test_overview_in_blocks_equals_pixels(spark, rows, method, factor):
    want = as_dict(pixels.overview(rows, factor, method, ("band",)))
    blocks = tiles.from_pixels(rows, 0, BLOCK, 2, "float64", -9.0)
    made = resample.kernel_overview(blocks, BLOCK, 2, "float64", (HIGH, WIDE), factor, method, 1, -8.0, -9.0)
    same(as_dict(tiles.to_pixels(made, BLOCK, 2, "float64", -(-WIDE // factor), -(-HIGH // factor), -8.0)), want)


def test_zones_and_empty_source(spark, rows):
    """From degrees to a zone and back each pixel finds itself; no blocks, no output."""
    to, source = (0.001, 0.0, 14.96, 0.0, -0.001, 50.03), (100.0, 0.0, 497000.0, 0.0, -100.0, 5544000.0)
    there, back = resample.placing(source, to, 32633, 4326), resample.placing(to, source, 4326, 32633)
    r, c = np.indices((20, 20)).reshape(2, -1) + 0.5
    assert np.allclose(back(*there(r, c)), (r, c), atol=1e-4)
    blocks = tiles.from_pixels(rows, 0, BLOCK, 2, "float64", -9.0).where(F.lit(False))
    assert resample.resample(blocks, BLOCK, 2, "float64", (HIGH, WIDE), (10, 10), there, "nearest").count() == 0
