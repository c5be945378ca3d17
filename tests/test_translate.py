import contextlib
import io
import json

import numpy as np
import pytest

import gridloom
from gridloom import cli
from gridloom.functions import grid
from gridloom.functions.profiles import options_of
from gridloom.operators import headers, validate
from gridloom.plans import translate
from gridloom.sources import datasource, tiff


def pixels_of(path: str, level: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    read = datasource.opened(path)
    t = tiff.parse(read)

    def whole(d):
        out = np.zeros((d.height + 4096, d.width + 4096, 1 if d.separate else d.samples), dtype=d.dtype.newbyteorder("="))
        planes = {}
        for band, r, c, o, n in d.blocks():
            x = tiff.decode_block(d, r, read(o, n))
            target = planes.setdefault(band, out.copy())
            bh, bw = d.block
            target[r * bh : r * bh + x.shape[0], c * bw : c * bw + x.shape[1]] = x
        return np.concatenate([planes[k] for k in sorted(planes)], axis=2)[: d.height, : d.width].transpose(2, 0, 1)

    return whole(t.directories[level]), (whole(t.masks[level])[0] if t.masks else None)


def profile(name: str = "deflate", block: int = 64, **more) -> dict:
    return options_of(name) | {"blockxsize": block, "blockysize": block} | more


IMAGE = np.random.default_rng(0).integers(1, 255, (3, 150, 201)).astype(np.uint8)


@pytest.mark.parametrize("name", ["deflate", "raw", "packbits", "lzma", "zstd"])
@pytest.mark.parametrize("interleave", ["pixel", "band"])
def test_round_trip(spark, tmp_path, name, interleave):
    out = str(tmp_path / "a.tif")
    plan = translate.cog_translate(spark, IMAGE, out, profile(name, interleave=interleave), overview_resampling="average")
    assert plan.levels == [2, 4]
    assert (pixels_of(out)[0] == IMAGE).all()
    small, _ = pixels_of(out, 1)
    assert small.shape == (3, 75, 101)
    assert abs(int(small[0, 0, 0]) - IMAGE[0, :2, :2].mean()) <= 0.5
    assert translate.cog_validate(spark, out) == (True, [], [])


def test_nodata_mask_tags_and_info(spark, tmp_path):
    x = np.full((1, 130, 130), -9999.0, dtype=np.float32)
    x[0, 10:90, 20:100] = 7.5
    out = str(tmp_path / "a.tif")
    translate.cog_translate(spark, x, out, profile(), nodata=-9999.0, overview_resampling="average", transform=(10.0, 0.0, 500000.0, 0.0, -10.0, 600000.0), epsg=3857, additional_cog_metadata={"by": "test"})
    row = translate.cog_info(spark, out)
    assert row["COG"] and row["Profile"]["Nodata"] == -9999.0 and row["GEO"]["CRS"] == "EPSG:3857"
    assert row["Tags"]["Image Metadata"] == {"by": "test", "OVERVIEW_RESAMPLING": "AVERAGE"}
    assert [i["Decimation"] for i in row["IFD"]] == [0, 2, 4] and row["GEO"]["MaxZoom"] == 14
    assert row["GEO"]["BoundingBox"] == [500000.0, 598700.0, 501300.0, 600000.0]
    small, _ = pixels_of(out, 1)
    assert small[0, 5, 10] == 7.5 and small[0, 0, 0] == -9999.0
    again = str(tmp_path / "b.tif")
    translate.cog_translate(spark, out, again, profile(), add_mask=True)
    y, mask = pixels_of(again)
    assert (y == x).all() and (mask == np.where(x[0] == -9999.0, 0, 255)).all()
    assert translate.cog_info(spark, again)["Profile"]["InternalMask"]
    third = str(tmp_path / "c.tif")
    translate.cog_translate(spark, again, third, profile())
    assert (pixels_of(third)[1] == mask).all()


def test_bands_alpha_and_dtype(spark, tmp_path):
    x = np.concatenate([IMAGE, np.where(IMAGE[:1] > 100, 255, 0).astype(np.uint8)])
    out, again = str(tmp_path / "a.tif"), str(tmp_path / "b.tif")
    translate.cog_translate(spark, x, out, profile())
    assert translate.cog_info(spark, out)["Profile"]["AlphaBand"]
    translate.cog_translate(spark, out, again, profile(), indexes=(3, 1, 3), dtype="uint16", overview_level=0)
    got, _ = pixels_of(again)
    assert got.dtype == np.uint16 and (got == x[[2, 0, 2]]).all()
    translate.cog_translate(spark, out, again, profile(), add_mask=True)
    got, mask = pixels_of(again)
    assert got.shape[0] == 3 and (mask == x[3]).all()


@pytest.mark.parametrize("method", ["nearest", "mode", "rms", "cubic"])
def test_overview_methods(spark, tmp_path, method):
    out = str(tmp_path / "a.tif")
    flat = np.full((1, 130, 140), 9, dtype=np.uint8)
    translate.cog_translate(spark, flat, out, profile(), overview_resampling=method)
    assert (pixels_of(out, 1)[0] == 9).all()


def test_web_optimized_grid(spark, tmp_path):
    out = str(tmp_path / "a.tif")
    cell = grid.WEB_MERCATOR.cell(10)
    translate.cog_translate(spark, IMAGE[:1], out, profile(block=256), tms=grid.WEB_MERCATOR, transform=(cell, 0.0, 1000.0, 0.0, -cell, 5000.0), epsg=3857, nodata=0)
    row = translate.cog_info(spark, out)
    assert row["Profile"]["Width"] % 256 == 0 and row["Tags"]["Image Metadata"]["TILING_SCHEME_ZOOM_LEVEL"] == "10"
    got, _ = pixels_of(out)
    assert int((got > 0).sum()) == IMAGE[0].size


def test_reader_reads_what_filters_ask_for(spark, tmp_path):
    out = str(tmp_path / "a.tif")
    translate.cog_translate(spark, IMAGE, out, profile())
    tiles = spark.read.format("geotiff").load(out)
    assert tiles.where("level = 0").count() == 3 * 4 * 3
    assert [(r["height"], r["width"]) for r in tiles.where("level = 0 and block_row = 2 and block_col = 3 and band = 2").collect()] == [(22, 9)]


def test_rules_on_hand_made_headers(spark):
    base = {"driver": "GTiff", "ghost": {}, "has_sidecar": False}
    level = lambda n, size, at, data, dec, bw=256: (n, size, size, 256, bw, dec, at, data)
    good = [level(0, 2000, 16, 9000, 0), level(1, 1000, 200, 5000, 2), level(2, 500, 250, 3000, 4)]
    cases = {
        "good": (good, 0), "late": ([level(0, 2000, 301, 9000, 0), level(1, 1000, 400, 5000, 2)], 1),
        "untiled": ([level(0, 2000, 16, 9000, 0, 2000), *good[1:]], 1), "small": ([level(0, 400, 16, 9000, 0, 400)], 0),
        "unsorted": ([good[0], level(1, 500, 200, 5000, 4), level(2, 1000, 250, 3000, 2)], 1), "decimation": ([good[0], level(1, 2000, 200, 5000, 1)], 1),
        "backwards": ([level(0, 2000, 200, 9000, 0), level(1, 1000, 100, 5000, 2)], 1), "early": ([level(0, 400, 100, 50, 0)], 1),
        "data": ([good[0], level(1, 1000, 200, 3000, 2), level(2, 500, 250, 5000, 4)], 1), "main": ([level(0, 2000, 16, 4000, 0), *good[1:]], 1),
        "overview": ([good[0], level(1, 1000, 200, 5000, 2, 1000), good[2]], 1), "sparse": ([level(0, 2000, 16, None, 0), *good[1:]], 0),
    }
    schema = "path string, driver string, ghost map<string,string>, has_sidecar boolean, levels array<struct<level:int,width:int,height:int,block_h:int,block_w:int,decimation:int,ifd_offset:bigint,first_offset:bigint>>"
    rows = [(k, *base.values(), v[0]) for k, v in cases.items()] + [("png", "PNG", {}, False, []), ("ovr", "GTiff", {}, True, good), ("edited", "GTiff", {"KNOWN_INCOMPATIBLE_EDITION": "YES"}, False, good), ("flat", "GTiff", {}, False, good[:1])]
    got = {r["path"]: r for r in validate.validate(spark.createDataFrame(rows, schema)).collect()}
    for name, (_, n) in cases.items():
        assert len(got[name]["errors"]) == n and got[name]["valid"] == (n == 0), (name, got[name])
    assert all(len(got[x]["errors"]) == 1 for x in ("png", "ovr", "edited"))
    assert got["flat"]["valid"] and len(got["flat"]["warnings"]) == 1
    assert not validate.validate(spark.createDataFrame(rows, schema), strict=True).where("path = 'flat'").first()["valid"]


def test_mask_file_and_small_overview_blocks(spark, tmp_path):
    x = IMAGE.copy()
    x[:, :40, :50] = 0
    out, again = str(tmp_path / "a.tif"), str(tmp_path / "b.tif")
    config = {"GDAL_TIFF_INTERNAL_MASK": False, "GDAL_TIFF_OVR_BLOCKSIZE": 48}
    translate.cog_translate(spark, x, out, profile(), nodata=0, add_mask=True, config=config, quiet=True, overview_resampling="average")
    row = translate.cog_info(spark, out)
    assert not row["Profile"]["InternalMask"] and [i["Blocksize"] for i in row["IFD"]] == [[64, 64], [48, 48], [48, 48]] and row["COG"]
    translate.cog_translate(spark, out, again, profile(), quiet=True, overview_resampling="average")
    y, mask = pixels_of(again)
    assert (y == x).all() and (mask == np.where(x[0] == 0, 0, 255)).all()
    small, large = pixels_of(out, 1)[0], pixels_of(again, 1)[0]
    assert small.shape == (3, 75, 101) and abs(small.astype(int) - large).max() <= 1


def test_options_of_the_cog_driver(spark, tmp_path, capsys):
    out = str(tmp_path / "a.tif")
    with pytest.warns(UserWarning):
        plan = translate.cog_translate(spark, IMAGE, out, profile(), nodata=0, add_mask=True, use_cog_driver=True, overview_level=0)
    assert plan.options["driver"] == "COG" and plan.options["overviews"] == "NONE" and plan.options["blocksize"] == 64
    assert "is written" in capsys.readouterr().err
    log = io.StringIO()
    with pytest.warns(DeprecationWarning):
        translate.cog_translate(spark, IMAGE, out, profile(), web_optimized=True, progress_out=log, transform=(10.0, 0.0, 0.0, 0.0, -10.0, 0.0), epsg=3857, overview_level=0)
    assert "writing" in log.getvalue() and capsys.readouterr().err == ""


def test_tile_rows_as_source(spark, tmp_path):
    out, again = str(tmp_path / "a.tif"), str(tmp_path / "b.tif")
    translate.cog_translate(spark, IMAGE, out, profile(), quiet=True)
    source, _, _ = translate.describe_source(out)
    rows = spark.read.format("geotiff").load(out).where("level = 0")
    translate.cog_translate(spark, (rows, source), again, profile(), quiet=True)
    assert (pixels_of(again)[0] == IMAGE).all()


def test_questions_about_a_file(spark, tmp_path):
    out = str(tmp_path / "a.tif")
    cell = grid.WEB_MERCATOR.cell(10)
    x = np.concatenate([IMAGE, np.where(IMAGE[:1] > 100, 255, 0).astype(np.uint8)])
    translate.cog_translate(spark, x, out, profile(), transform=(cell, 0.0, 1000.0, 0.0, -cell, 5000.0), epsg=3857, quiet=True)
    assert gridloom.has_alpha_band(out) and not gridloom.has_mask_band(out) and gridloom.non_alpha_indexes(out) == (1, 2, 3)
    assert gridloom.get_zooms(out) == (10, 10) and gridloom.get_zooms(out, tilesize=64) == (8, 10)
    web = gridloom.get_web_optimized_params(out)
    assert web["width"] % 256 == 0 and web["transform"][0] == cell and web["crs"] == "EPSG:3857"
    row = headers.blocks(headers.read_headers(spark, out)).where("level = 0 and block_y = 1 and block_x = 2").first()
    assert gridloom.get_data_offset(out, 2, 1) == row["offset"] > 0 and gridloom.get_data_offset(out, 99, 99) == 0
    degrees = str(tmp_path / "b.tif")
    translate.cog_translate(spark, IMAGE, degrees, profile(), transform=(0.01, 0.0, 10.0, 0.0, -0.01, 50.0), epsg=4326, quiet=True)
    info = translate.cog_info(spark, degrees)
    assert (info["GEO"]["MinZoom"], info["GEO"]["MaxZoom"]) == gridloom.get_zooms(degrees)


def test_product_file(spark, tmp_path):
    a, b = str(tmp_path / "a.tif"), str(tmp_path / "b.tif")
    translate.cog_translate(spark, IMAGE, a, profile(), quiet=True)
    (tmp_path / "a.XML").write_text("<isd><IMD><VERSION>1</VERSION><IMAGE><SATID>X</SATID></IMAGE></IMD><RPB><IMAGE><LINEOFFSET>8</LINEOFFSET><LINENUMCOEFList><LINENUMCOEF>1 2</LINENUMCOEF></LINENUMCOEFList></IMAGE></RPB></isd>")
    config = {"GDAL_DISABLE_READDIR_ON_OPEN": "FALSE"}
    for forward in (False, True):
        translate.cog_translate(spark, a, b, profile(), forward_ns_tags=forward, config=config, quiet=True)
        tags = translate.cog_info(spark, b)["Tags"]
        assert ("Imd" in tags) == ("Rpc" in tags) == forward
    assert tags["Imd"] == {"VERSION": "1", "IMAGE.SATID": "X"} and tags["Rpc"] == {"LINE_OFF": "8", "LINE_NUM_COEFF": "1 2"}


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "cubic_spline", "lanczos", "average", "mode", "sum", "rms"])
def test_warp_methods(spark, tmp_path, method):
    flat = np.full((1, 90, 90), 9, dtype=np.uint16)
    cell = grid.WEB_MERCATOR.cell(10)
    out = str(tmp_path / "a.tif")
    translate.cog_translate(spark, flat, out, profile(block=256), tms=grid.WEB_MERCATOR, zoom_level=9, resampling=method, transform=(cell, 0.0, 0.0, 0.0, -cell, 0.0), epsg=3857, overview_level=0, quiet=True)
    got = pixels_of(out)[0][0, 5:35, 5:35]
    assert (got == (36 if method == "sum" else 9)).all()


def test_files_that_are_no_rasters_and_sidecars(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"\xff\xd8 no raster")
    assert translate.cog_validate(spark, str(tmp_path / "x.jpg"))[:2] == (False, ["the file is not a GeoTIFF"])
    out = str(tmp_path / "a.tif")
    translate.cog_translate(spark, IMAGE, out, profile())
    (tmp_path / "a.tif.OVR").write_bytes(b"")
    assert translate.cog_validate(spark, out, list_folder=True)[0] is False and translate.cog_validate(spark, out)[0]
    h = headers.read_headers(spark, out)
    assert headers.ifds(h).count() == 3 and headers.bands(h).count() == 3 and headers.blocks(h).where("level = 0").count() == 12


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *_: spark)
    a, b = str(tmp_path / "a.tif"), str(tmp_path / "b.tif")
    translate.cog_translate(spark, IMAGE, a, profile())
    assert cli.main(["create", a, b, "-b", "1", "--blocksize", "64", "-q"]) == 0
    assert cli.main(["validate", b]) == 0 and "is a valid" in capsys.readouterr().out
    assert cli.main(["info", b, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["Profile"]["Bands"] == 1
    assert cli.main(["info", b]) == 0 and "Decimation" in capsys.readouterr().out
    assert [cli.main(["create", a, b, *x]) for x in (["-b", "0"], ["-b", "x"], ["--nodata", "x"], ["--threads", "x"], ["--co", "x"])] == [1] * 5
    with pytest.raises(SystemExit) as stop:
        cli.main(["create", a, b, "-r", "gauss"])
    assert stop.value.code == 2


def test_arrivals(spark, tmp_path):
    from gridloom.streaming.ingest import validate_arrivals

    folder = tmp_path / "in"
    folder.mkdir()
    translate.cog_translate(spark, IMAGE, str(folder / "a.tif"), profile())
    validate_arrivals(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [r["valid"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [True]


@pytest.mark.parametrize("method", ["average", "mode", "rms", "cubic"])
def test_nodata_in_one_of_two_bands(spark, tmp_path, method):
    x = np.full((2, 128, 128), 10.0, dtype=np.float32)
    x[0, ::2, ::2] = x[1, 64:, :] = -9999.0
    x[0, :4, :4] = -9999.0
    out = str(tmp_path / "a.tif")
    translate.cog_translate(spark, x, out, profile(), nodata=-9999.0, overview_resampling=method)
    small, _ = pixels_of(out, 1)
    assert small.shape == (2, 64, 64) and (small[1, :30] == 10).all() and (small[1, 34:] == -9999).all()
    assert (small[0, 4:] == 10).all() and (method == "cubic" or (small[0, :2, :2] == -9999).all())


@pytest.mark.parametrize("factor", [2, 4])
def test_mode_of_cells_by_brute_force(factor):
    from gridloom.operators import tiles

    rng = np.random.default_rng(4)
    x, valid = rng.integers(0, 4, (2, 16, 16)).astype(np.int16), rng.random((16, 16)) < 0.6
    valid[:4, :4] = False
    got, ok = tiles.reduced(x, valid, factor, "mode", 3.0)
    for b, i, j in np.ndindex(2, 16 // factor, 16 // factor):
        at = slice(i * factor, (i + 1) * factor), slice(j * factor, (j + 1) * factor)
        left = [v for v in x[b][at][valid[at]].tolist() if v != 3]
        assert got[b, i, j] == (min(set(left), key=lambda v: (-left.count(v), v)) if left else 3)
    assert not ok[0, 0]


@pytest.mark.parametrize("whole", [False, True])
def test_many_files_are_read_one_to_a_task(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(datasource, "FILES", 0 if whole else 64)
    for i in range(3):
        translate.cog_translate(spark, IMAGE + np.uint8(i), str(tmp_path / f"{i} a.tif"), profile(), quiet=True)
    rows = spark.read.format("geotiff").option("partitionbytes", 20_000).load(str(tmp_path / "*.tif"))
    got = {(r["path"], r["block_row"], r["block_col"], r["band"]): r for r in rows.where("level = 0").collect()}
    assert len(got) == 3 * 3 * 4 * 3
    for (path, i, j, b), r in got.items():
        want = (IMAGE + np.uint8(int(path.rsplit("/", 1)[1][0])))[b - 1, i * 64 : (i + 1) * 64, j * 64 : (j + 1) * 64]
        assert (np.frombuffer(r["data"], dtype=np.uint8).reshape(want.shape) == want).all()
    assert headers.read_headers(spark, str(tmp_path)).where("driver = 'GTiff' and size(ifds) = 3").count() == 3


@pytest.mark.parametrize("bands", [1, 3, 4])
def test_jpeg_files(spark, tmp_path, bands):
    """Lossy files with YCbCr, a mask from alpha, and overviews; read back and described."""
    r, c = np.mgrid[0:150, 0:201]
    x = np.stack([(r + c) % 200 + 20, r % 150 + 50, 255 - c, np.where(c < 100, 255, 0)])[:bands].astype(np.uint8)
    if bands == 4:
        source = str(tmp_path / "alpha.tif")
        translate.cog_translate(spark, x, source, profile(), quiet=True)
    out = str(tmp_path / "a.tif")
    with pytest.warns(UserWarning) if bands != 3 else contextlib.nullcontext():
        translate.cog_translate(spark, source if bands == 4 else x, out, profile("jpeg", JPEG_QUALITY=95), overview_resampling="average")
    got, mask = pixels_of(out)
    n = 1 if bands == 1 else 3
    seen = x[:n, :, :100] if bands == 4 else x[:n]
    assert got.shape[0] == n and np.abs(got[:, :, : seen.shape[2]].astype(int) - seen).mean() < 4
    assert (mask is not None) == (bands == 4) and (mask is None or (mask[:, :100] == 255).all() and not mask[:, 100:].any())
    row = translate.cog_info(spark, out)
    assert row["COG"] and row["Compression"] == "JPEG" and row["ColorSpace"] == ("MINISBLACK" if n == 1 else "YCBCR")
    assert row["Profile"]["ColorInterp"] == (["gray"] if n == 1 else ["red", "green", "blue"]) and pixels_of(out, 1)[0].shape == (n, 75, 101)
    with pytest.raises(Exception, match="one or three bands of bytes"):
        translate.cog_translate(spark, x.astype(np.float32), str(tmp_path / "b.tif"), profile("jpeg"))


def test_warped_source_and_bytes(spark, tmp_path):
    """A file seen on a grid of two-pixel cells, translated from there; and an output as bytes."""
    source, out = str(tmp_path / "a.tif"), str(tmp_path / "b.tif")
    translate.cog_translate(spark, IMAGE, source, profile(), transform=(10.0, 0.0, 0.0, 0.0, -10.0, 2000.0), epsg=3857, quiet=True)
    place = (20.0, 0.0, -40.0, 0.0, -20.0, 2000.0)
    rows, seen = gridloom.warped_source(spark, source, place, 80, 75, 3857, "average", 64)
    assert (seen.width, seen.height, seen.internal_mask) == (80, 75, True)
    translate.cog_translate(spark, (rows, seen), out, profile(), transform=place, epsg=3857, add_mask=True, quiet=True)
    got, mask = pixels_of(out)
    want = IMAGE.astype(float)[:, :150, :156].reshape(3, 75, 2, 78, 2).mean(axis=(2, 4))
    assert np.abs(got[:, :, 2:80] - want[:, :, :78]).max() <= 0.5 and not mask[:, :2].any() and (mask[:, 2:80] == 255).all()
    data = gridloom.cog_in_memory(spark, IMAGE, profile(), quiet=True)
    (tmp_path / "c.tif").write_bytes(data)
    assert (pixels_of(str(tmp_path / "c.tif"))[0] == IMAGE).all()


def test_tile_matrix_set_of_json_info_as_json_and_colour_map(spark, tmp_path):
    doc = {"id": "Two", "crs": "http://www.opengis.net/def/crs/EPSG/0/3857", "tileMatrices": [
        {"id": str(z), "cellSize": 200.0 / 2**z, "pointOfOrigin": [-1000.0, 2000.0], "tileWidth": 128, "tileHeight": 128, "matrixWidth": 2**z * 3, "matrixHeight": 2**z} for z in (1, 0)
    ]}
    tms = grid.TileMatrixSet.from_json(json.dumps(doc))
    assert (tms.id, tms.crs, tms.cells, tms.matrix_width_0) == ("Two", "EPSG:3857", (200.0, 100.0), 3)
    assert tms.tile(-1000.0 + 128 * 100 * 4.5, 2000.0 - 1, 1) == (4, 0) and tms.tile(1e9, -1e9, 1) == (5, 1) and tms.corner(1, 1, 0) == (24600.0, -23600.0)
    old = {"identifier": "Old", "supportedCRS": "urn:x", "tileMatrix": [{"identifier": "0", "scaleDenominator": 1000.0, "topLeftCorner": [0, 0], "tileWidth": 256, "tileHeight": 256, "matrixWidth": 1, "matrixHeight": 1}]}
    assert grid.TileMatrixSet.from_json(json.dumps(old)).cells == pytest.approx((0.28,))
    out, colors = str(tmp_path / "a.tif"), {0: (0, 0, 0), 1: (255, 10, 20), 255: (9, 8, 7)}
    translate.cog_translate(spark, (IMAGE[:1] > 99).astype(np.uint8), out, profile(), colormap=colors, quiet=True)
    d = datasource.parsed(out).directories[0]
    assert {k: tuple(v[:3]) for k, v in d.colormap().items() if k in colors} == colors and d.colorinterp() == ["palette"]
    from gridloom.operators import info

    row = info.info_json(info.info(headers.read_headers(spark, out))).first()
    said = json.loads(row["json"])
    assert row["Path"].endswith("a.tif") and said["Profile"]["ColorMap"] is True and said["COG"] is True and len(said["IFD"]) == 3
