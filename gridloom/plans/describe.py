"""Questions about one raster file that its header answers on the driver."""

from __future__ import annotations

from gridloom.functions import grid
from gridloom.operators import warp
from gridloom.plans.translate import describe_source
from gridloom.sources import datasource


def has_alpha_band(path: str) -> bool:
    """Whether a band is an alpha band."""
    return "alpha" in describe_source(path)[0].colorinterp


def has_mask_band(path: str) -> bool:
    """Whether the file has a mask of its own, inside or beside it; an alpha band is none."""
    return describe_source(path)[0].internal_mask


def non_alpha_indexes(path: str) -> tuple[int, ...]:
    """The numbers of the bands that are no alpha band."""
    return tuple(i for i, kind in enumerate(describe_source(path)[0].colorinterp, 1) if kind != "alpha")


def _on_grid(path: str, tms: grid.TileMatrixSet) -> tuple[tuple[float, float, float, float], float, int, int]:
    """(left, bottom, right, top) and resolution in the tile matrix set's system, width and height in pixels there."""
    source, d, _ = describe_source(path)
    transform = warp.affine_from_gcps(d.gcps) if d.gcps else d.transform
    target = int(tms.crs.split(":")[1]) if tms.crs.startswith("EPSG:") else None
    a, _, c, _, e, f = transform
    box = (min(c, c + a * source.width), min(f, f + e * source.height), max(c, c + a * source.width), max(f, f + e * source.height))
    same = d.epsg in (None, target)
    res = max(abs(a), abs(e)) if same else warp.suggested_resolution(transform, source.width, source.height, d.epsg, target)
    left, bottom, right, top = moved = warp.moved_bounds(box, d.epsg, target)
    size = (source.width, source.height) if same else (max(1, round((right - left) / res)), max(1, round((top - bottom) / res)))
    return moved, res, *size


def get_zooms(path: str, tilesize: int = 256, tms: grid.TileMatrixSet = grid.WEB_MERCATOR, zoom_level_strategy: str = "auto") -> tuple[int, int]:
    """(smallest, largest) zoom level at which the raster makes sense."""
    _, res, width, height = _on_grid(path, tms)
    return grid.zooms(res, width, height, tilesize, zoom_level_strategy, tms)


def get_web_optimized_params(path: str, zoom_level_strategy: str = "auto", zoom_level: int | None = None, aligned_levels: int | None = None, tms: grid.TileMatrixSet = grid.WEB_MERCATOR) -> dict:
    """crs, transform, width and height (and the zoom level) of the raster on a tile matrix set."""
    box, res, _, _ = _on_grid(path, tms)
    return grid.aligned(box, res, zoom_level_strategy, zoom_level, aligned_levels, tms)


def get_data_offset(path: str, x: int, y: int, level: int = 0) -> int:
    """Where a block's data begin in the file; 0 for a sparse or missing block."""
    d = datasource.parsed(datasource._file_path(path)).directories[level]
    return next((offset for _, row, col, offset, count in d.blocks() if (row, col) == (y, x) and count), 0)
