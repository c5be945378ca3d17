import warnings

import numpy as np
import pytest

from gridloom.errors import IncompatibleOptions, NodataAlphaMaskWarning
from gridloom.functions import grid
from gridloom.functions.profiles import cog_profiles
from gridloom.operators import pixels, warp
from gridloom.plans import policy

RGBA = policy.Source(1024, 1024, 4, "uint8", None, ["red", "green", "blue", "alpha"])


def test_profiles():
    assert sorted(cog_profiles) == sorted("jpeg webp zstd lzw deflate packbits lzma lerc lerc_deflate lerc_zstd raw".split())
    one = cog_profiles.get("DEFLATE")
    one["compress"] = "x"
    assert cog_profiles.get("deflate")["compress"] == "DEFLATE"
    assert "compress" not in cog_profiles.get("raw")
    with pytest.raises(KeyError):
        cog_profiles.get("nothing")
    with pytest.warns(UserWarning):
        cog_profiles.get("zstd")


def test_alpha_goes_when_a_mask_is_asked_for():
    plan = policy.plan(RGBA, cog_profiles.get("deflate"), add_mask=True)
    assert plan.bands == (1, 2, 3) and plan.write_mask


def test_jpeg_drops_alpha_and_writes_a_mask():
    with pytest.warns(UserWarning):
        plan = policy.plan(RGBA, cog_profiles.get("jpeg"))
    assert plan.bands == (1, 2, 3) and plan.add_mask
    with pytest.warns(UserWarning):
        assert policy.plan(RGBA, cog_profiles.get("jpeg"), indexes=(1, 2, 3)).bands == (1, 2, 3)


def test_nodata_wins():
    source = policy.Source(10, 10, 4, "uint8", 0.0, RGBA.colorinterp)
    with pytest.warns(NodataAlphaMaskWarning):
        plan = policy.plan(source, cog_profiles.get("deflate"))
    assert plan.validity == "nodata" and plan.nodata == 0.0


def test_control_points_append_alpha():
    source = policy.Source(10, 10, 1, "uint8", None, ["gray"], gcps=True)
    assert policy.plan(source, cog_profiles.get("deflate")).append_alpha
    assert not policy.plan(source, cog_profiles.get("deflate"), add_mask=True).append_alpha


def test_bad_options():
    with pytest.raises(IncompatibleOptions):
        policy.plan(RGBA, cog_profiles.get("deflate"), colormap={0: (0, 0, 0, 255)})
    with pytest.raises(ValueError):
        policy.plan(RGBA, cog_profiles.get("deflate"), decimation_base=1)
    with pytest.raises(ValueError):
        policy.plan(RGBA, cog_profiles.get("deflate"), decimation_base=3)
    assert policy.plan(RGBA, cog_profiles.get("deflate"), decimation_base=3, overview_level=2).levels == [3, 9]


def test_one_band_is_not_ycbcr():
    source = policy.Source(10, 10, 1, "uint8", None, ["gray"])
    with pytest.warns(UserWarning):
        assert policy.plan(source, cog_profiles.get("jpeg")).options["photometric"] == "MINISBLACK"


@pytest.mark.parametrize(("size", "tile", "levels"), [(512, 512, 0), (512, 64, 3), (171, 128, 1), (51, 64, 0), (10980, 512, 5)])
def test_overview_levels(size, tile, levels):
    assert grid.overview_levels(size, size, tile) == levels


def test_zoom_levels_and_alignment():
    w = grid.WEB_MERCATOR
    assert w.zoom_for(w.cell(7)) == 7
    assert w.zoom_for(w.cell(7) * 0.9, "lower") == 7 and w.zoom_for(w.cell(7) * 0.9, "upper") == 8
    out = grid.aligned((100.0, 100.0, 5000.0, 6000.0), w.cell(10), zoom=10, aligned_levels=2)
    side = w.cell(8) * 256
    assert abs((out["transform"][2] - w.origin_x) / side % 1) < 1e-6 and out["width"] % 256 == 0


def test_tags_later_ones_win():
    tags = policy.merged_tags({"a": "1", "OVERVIEW_RESAMPLING": "x"}, "cubic", grid.WEB_MERCATOR, 9, 0, {"a": 2})
    assert tags == {"a": "2", "OVERVIEW_RESAMPLING": "CUBIC", "TILING_SCHEME_NAME": "WebMercatorQuad", "TILING_SCHEME_ZOOM_LEVEL": "9"}


def test_affine_from_control_points():
    t = (2.0, 0.5, 100.0, -0.25, -3.0, 50.0)
    points = [(r, c, t[0] * c + t[1] * r + t[2], t[3] * c + t[4] * r + t[5], 0.0) for r, c in ((0, 0), (0, 10), (20, 0), (7, 9))]
    assert np.allclose(warp.affine_from_gcps(points), t)
    assert np.allclose(np.array(warp.inverse(warp.inverse(t))), t)


@pytest.mark.parametrize("method", pixels.KERNELS)
def test_kernels_sum_to_one(method):
    if method != "gauss":
        assert abs(sum(w for _, _, w in pixels.kernel_table(8, method)) - 1) < 0.01


def test_pixel_operators(spark):
    df = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, float("nan")), (1, 1, 0, None), (2, 0, 0, 300.7)], "band int, row long, col long, value double")
    assert pixels.with_nodata(df, float("nan")).where("value is null").count() == 2
    assert pixels.select_bands(df, (2, 2)).count() == 2 and pixels.select_bands(df, None).count() == 4
    assert {r["v"] for r in df.where("band = 2").select(pixels.cast_pixels(df["value"], "uint8").alias("v")).collect()} == {255}
    assert pixels.overview(df.limit(0), 2, "mode").count() == 0


def test_warp_is_the_identity_on_its_own_grid(spark):
    x = spark.range(30).selectExpr("id div 6 as row", "id % 6 as col", "cast(id as double) as value")
    t = (10.0, 0.0, 0.0, 0.0, -10.0, 50.0)
    places = warp.source_place(warp.output_grid(spark, 6, 5), t, t)
    for method in ("nearest", "bilinear"):
        got = sorted(map(tuple, warp.warp(x, places, method).select("row", "col", "value").collect()))
        assert got == sorted(map(tuple, x.collect()))


def test_policy_warns_nothing_without_reason():
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        policy.plan(policy.Source(10, 10, 1, "uint8", None, ["gray"]), cog_profiles.get("deflate"))
