"""Overview levels, zoom levels, tile indexes and aligned grids as column expressions.

The default tile matrix set is the public Web Mercator quad tree: 256-pixel
tiles, level z with 2 ** z tiles on a side of 2 * EXTENT metres.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENT = 20037508.342789244
CELL_0 = 2 * EXTENT / 256
MAX_ZOOM = 30


@dataclass(frozen=True)
class TileMatrixSet:
    """A quad tree of tiles: cell sizes by zoom, origin at the top left."""

    id: str = "WebMercatorQuad"
    crs: str = "EPSG:3857"
    origin_x: float = -EXTENT
    origin_y: float = EXTENT
    tile_width: int = 256
    tile_height: int = 256
    cells: tuple[float, ...] = tuple(CELL_0 / 2**z for z in range(MAX_ZOOM + 1))
    matrix_width_0: int = 1
    matrix_height_0: int = 1

    def cell(self, zoom: int) -> float:
        return self.cells[zoom]

    @classmethod
    def from_json(cls, text: str) -> TileMatrixSet:
        """A set from its JSON document (matrices named by zoom level)."""
        doc = json.loads(text)
        levels = sorted(doc["tileMatrices" if "tileMatrices" in doc else "tileMatrix"], key=lambda m: int(m.get("id", m.get("identifier"))))
        first = levels[0]
        cells = tuple(m["cellSize"] if "cellSize" in m else m["scaleDenominator"] * 0.00028 for m in levels)
        x, y = first.get("pointOfOrigin", first.get("topLeftCorner"))
        crs = doc.get("crs", doc.get("supportedCRS", ""))
        crs = crs if isinstance(crs, str) else crs.get("uri", crs.get("wkt", ""))
        code = "EPSG:" + crs.rstrip("/").split("/")[-1] if "EPSG" in crs.upper() and "/" in crs else crs
        return cls(doc.get("id") or doc.get("identifier") or "CUSTOM", code, float(x), float(y), first["tileWidth"], first["tileHeight"], cells, first["matrixWidth"], first["matrixHeight"])

    def zoom_for(self, res: float, strategy: str = "auto", max_zoom: int | None = None) -> int:
        """The zoom level for a resolution; see ``zoom_for_res``."""
        last = min(len(self.cells) - 1, MAX_ZOOM if max_zoom is None else max_zoom)
        z = next((z for z in range(last + 1) if res > self.cells[z] or abs(res - self.cells[z]) / self.cells[z] <= 1e-8), last)
        exact = abs(res - self.cells[z]) / self.cells[z] <= 1e-8
        if z > 0 and not exact and strategy != "upper" and (strategy == "lower" or self.cells[z - 1] / res < res / self.cells[z]):
            z -= 1
        return z

    def tile(self, x: float, y: float, zoom: int) -> tuple[int, int]:
        """(column, row) of the tile that holds a point, kept within the matrix."""
        size = self.cells[zoom]
        col = math.floor((x - self.origin_x) / (size * self.tile_width))
        row = math.floor((self.origin_y - y) / (size * self.tile_height))
        return min(max(col, 0), self.matrix_width_0 * 2**zoom - 1), min(max(row, 0), self.matrix_height_0 * 2**zoom - 1)

    def corner(self, col: int, row: int, zoom: int) -> tuple[float, float]:
        """The top left corner of a tile."""
        return self.origin_x + col * self.tile_width * self.cells[zoom], self.origin_y - row * self.tile_height * self.cells[zoom]


WEB_MERCATOR = TileMatrixSet()


def tms_table(spark: SparkSession, tms: TileMatrixSet = WEB_MERCATOR) -> DataFrame:
    """A row for each zoom level: tms_id, zoom, cell_size, origin, tile size, matrix size."""
    rows = [(tms.id, z, c, tms.origin_x, tms.origin_y, tms.tile_width, tms.tile_height, tms.matrix_width_0 * 2**z, tms.matrix_height_0 * 2**z) for z, c in enumerate(tms.cells)]
    return spark.createDataFrame(rows, "tms_id string, zoom int, cell_size double, origin_x double, origin_y double, tile_w int, tile_h int, matrix_w bigint, matrix_h bigint")


def overview_count(width: Column, height: Column, tilesize: Column | int) -> Column:
    """How often a raster is halved until its smaller side fits a tile."""
    size = F.lit(tilesize) if isinstance(tilesize, int) else tilesize
    fits = lambda n: F.floor(F.least(width, height) / F.pow(F.lit(2.0), n)) <= size
    return F.array_min(F.filter(F.sequence(F.lit(0), F.lit(40)), fits)).cast("long")


def overview_levels(width: int, height: int, tilesize: int) -> int:
    """``overview_count`` of one raster."""
    n = 0
    while min(width, height) >> n > tilesize:
        n += 1
    return n


def ceil_div(a: Column, b: Column | int) -> Column:
    return F.ceil(a / b).cast("long")


def resolution(a: Column, e: Column) -> Column:
    """Of an affine transform's steps the larger, without sign."""
    return F.greatest(F.abs(a), F.abs(e))


def zoom_for_res(res: Column, strategy: str = "auto", tms: TileMatrixSet = WEB_MERCATOR) -> Column:
    """The zoom level for a resolution.

    z is the first level whose cells are smaller than the resolution or equal
    to it.  Where they are not equal, ``lower`` takes z - 1, ``upper`` z, and
    ``auto`` the level whose cell is nearer in ratio.
    """
    same = lambda c: F.abs(res - c) / c <= 1e-8
    reaches = lambda c: (res > c) | same(c)
    last = len(tms.cells) - 1
    if all(b * 2 == a for a, b in zip(tms.cells, tms.cells[1:])):
        cell = lambda z: F.lit(float(tms.cells[0])) / F.pow(F.lit(2.0), z)
        guess = F.greatest(F.lit(0), F.least(F.lit(last), F.ceil(F.log2(F.lit(float(tms.cells[0])) / res)))).cast("int")
        # The logarithm may be off by one, where cells are met exactly or nearly.
        z = F.when((guess > 0) & reaches(cell(guess - 1)), guess - 1).when((guess < last) & ~reaches(cell(guess)), guess + 1).otherwise(guess)
    else:
        cells = F.array(*(F.lit(float(c)) for c in tms.cells))
        cell = lambda z: F.get(cells, z)
        z = F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.lit(last)), lambda i: reaches(cell(i))), F.lit(0)), F.lit(last))
    z = F.when(res.isNotNull(), z)
    if strategy == "upper":
        return z.cast("long")
    step = F.lit(True) if strategy == "lower" else cell(z - 1) / res < res / cell(z)
    return F.when((z > 0) & ~same(cell(z)) & step, z - 1).otherwise(z).cast("long")


def tile_index(x: Column, y: Column, cell: Column, tms: TileMatrixSet = WEB_MERCATOR) -> tuple[Column, Column]:
    """(column, row) of the tile that holds a point, kept within the matrix."""
    within = lambda place, side, n: F.greatest(F.lit(0), F.least(F.floor(place / side), F.bround(F.lit(tms.cells[0] * n) / cell) - 1)).cast("long")
    return within(x - tms.origin_x, cell * tms.tile_width, tms.matrix_width_0), within(tms.origin_y - y, cell * tms.tile_height, tms.matrix_height_0)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to Web Mercator metres."""
    return F.radians(lon) * 6378137.0, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * 6378137.0


def aligned_grid(left: Column, top: Column, right: Column, bottom: Column, res: Column, zoom: Column, aligned_levels: int = 0, tms: TileMatrixSet = WEB_MERCATOR) -> dict[str, Column]:
    """A raster's grid on a tile matrix set: zoom, res, west, north, width, height.

    Edges move out to tiles of level ``zoom - aligned_levels``, at least 0.  Sizes are
    rounded half to even and at least one pixel.
    """
    cells = F.array(*(F.lit(float(c)) for c in tms.cells))
    cell, base = F.get(cells, zoom.cast("int")), F.get(cells, F.greatest(F.lit(0), zoom - aligned_levels).cast("int"))
    col0, row0 = tile_index(left, top, base, tms)
    col1, row1 = tile_index(right, bottom, base, tms)
    side_x, side_y = base * tms.tile_width, base * tms.tile_height
    west, north = tms.origin_x + col0 * side_x, tms.origin_y - row0 * side_y
    east, south = tms.origin_x + (col1 + 1) * side_x, tms.origin_y - (row1 + 1) * side_y
    pixels = lambda d: F.greatest(F.lit(1), F.bround(d / cell)).cast("long")
    return {"zoom": zoom, "res": cell, "west": west, "north": north, "width": pixels(east - west), "height": pixels(north - south)}


def aligned(bounds: tuple[float, float, float, float], res: float, strategy: str = "auto", zoom: int | None = None, aligned_levels: int | None = None, tms: TileMatrixSet = WEB_MERCATOR) -> dict:
    """``aligned_grid`` of one raster's (left, bottom, right, top): crs, transform, width, height, zoom."""
    z = tms.zoom_for(res, strategy) if zoom is None else zoom
    base = max(0, z - (aligned_levels or 0))
    left, bottom, right, top = bounds
    c0, r0 = tms.tile(left, top, base)
    c1, r1 = tms.tile(right, bottom, base)
    west, north = tms.corner(c0, r0, base)
    east, south = tms.corner(c1 + 1, r1 + 1, base)
    cell = tms.cell(z)
    return {"crs": tms.crs, "transform": (cell, 0.0, west, 0.0, -cell, north), "width": max(1, round((east - west) / cell)), "height": max(1, round((north - south) / cell)), "zoom": z}


def zooms(res: float, width: int, height: int, tilesize: int = 256, strategy: str = "auto", tms: TileMatrixSet = WEB_MERCATOR) -> tuple[int, int]:
    """(smallest, largest) zoom level at which a raster makes sense."""
    return tms.zoom_for(res * 2 ** overview_levels(width, height, tilesize)), tms.zoom_for(res, strategy)
