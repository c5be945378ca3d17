import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import projections as p
from gridloom.plans import translate

PLACES = [(15.0, 50.0), (11.575, 48.137), (17.9, -33.9), (12.1, 0.0), (14.0, 79.5), (-179.0, 61.0)]


@pytest.mark.parametrize("lon, lat", PLACES)
def test_zone_round_trip_and_conformity(lon, lat):
    code = (32600 if lat >= 0 else 32700) + int((lon + 180) // 6) + 1
    x, y = p.moved_point(lon, lat, 4326, code)
    assert p.moved_point(x, y, code, 4326) == pytest.approx((lon, lat), abs=2e-8)
    # One scale in every direction, that of the ellipsoid's radii of curvature.
    f, h = 1 / 298.257223563, 1e-5
    e2, phi = f * (2 - f), math.radians(lat)
    along = p.RADIUS * math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2) * math.radians(h)
    up = p.RADIUS * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5 * math.radians(h)
    scales = [math.dist((x, y), p.moved_point(lon + dx, lat + dy, 4326, code)) / size for dx, dy, size in ((h, 0, along), (0, h, up))]
    assert scales[0] == pytest.approx(scales[1], rel=1e-5) and 0.9995 < scales[0] < 1.0012


def test_meridian_arc():
    """On the central meridian the northing is the arc from the equator, shortened by the zone's scale."""
    f, n = 1 / 298.257223563, 20000
    e2 = f * (2 - f)
    arc = sum(p.RADIUS * (1 - e2) / (1 - e2 * math.sin(math.radians(50 * (i + 0.5) / n)) ** 2) ** 1.5 for i in range(n)) * math.radians(50 / n)
    assert p.moved_point(15.0, 50.0, 4326, 32633) == pytest.approx((500000.0, arc * 0.9996), abs=1e-3)


def test_columns_and_arrays_agree_with_points(spark):
    rows = spark.createDataFrame(PLACES, "lon double, lat double")
    x, y = p.moved(F.col("lon"), F.col("lat"), 4326, 3857)
    lon, lat = p.moved(x, y, 3857, 4326)
    for r in rows.select("lon", "lat", x.alias("x"), y.alias("y"), lon.alias("lon_"), lat.alias("lat_")).collect():
        assert (r["x"], r["y"]) == pytest.approx(p.moved_point(r["lon"], r["lat"], 4326, 3857), abs=1e-6)
        assert (r["lon_"], r["lat_"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9)
    near = np.array([q for q in PLACES if abs(q[0] - 15) < 20])
    for code in (32633, 32733, 3857, 4326):
        got = np.stack(p.moved_arrays(*near.T, 4326, code), axis=1)
        assert np.allclose(got, [p.moved_point(*q, 4326, code) for q in near], atol=1e-6)
    with pytest.raises(ValueError):
        p.moved_point(0, 0, 4326, 2154)


def test_file_in_a_zone_has_zooms_and_is_warped(spark, tmp_path):
    from gridloom.functions import grid
    from test_translate import profile

    x = np.arange(256 * 256, dtype=np.float32).reshape(1, 256, 256)
    out, web = str(tmp_path / "a.tif"), str(tmp_path / "b.tif")
    place = (10.0, 0.0, 500000.0, 0.0, -10.0, 5540000.0)
    translate.cog_translate(spark, x, out, profile(), transform=place, epsg=32633)
    row = translate.cog_info(spark, out)["GEO"]
    assert row["CRS"] == "EPSG:32633" and row["MaxZoom"] == grid.WEB_MERCATOR.zoom_for(10 / math.cos(math.radians(50))) and row["MinZoom"] <= row["MaxZoom"]
    translate.cog_translate(spark, out, web, profile(), tms=grid.WEB_MERCATOR)
    info = translate.cog_info(spark, web)["GEO"]
    # The pixel under a known point has its value in both files.
    lon, lat = p.moved_point(501235.0, 5539005.0, 32633, 4326)
    mx, my = p.moved_point(lon, lat, 4326, 3857)
    (west, north), (cell, _) = info["Origin"], info["Resolution"]
    down, right = int((north - my) / cell), int((mx - west) / cell)
    block = spark.read.format("geotiff").load(web).where(f"level = 0 and band = 1 and block_row = {down // 64} and block_col = {right // 64}").first()
    made = np.frombuffer(block["data"], dtype="<f4").reshape(block["height"], block["width"])
    row_, col_ = divmod(int(made[down % 64, right % 64]), 256)
    assert abs(row_ - 99) <= 1 and abs(col_ - 123) <= 1
