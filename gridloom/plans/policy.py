"""What a translation does, settled before any pixel is read."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from gridloom.errors import IncompatibleOptions, NodataAlphaMaskWarning
from gridloom.functions import grid


@dataclass
class Source:
    """What the header says of a raster."""

    width: int
    height: int
    count: int
    dtype: str
    nodata: float | None
    colorinterp: list[str]
    internal_mask: bool = False
    gcps: bool = False
    colormap: bool = False


@dataclass
class Plan:
    """Bands to read and how the output is made of them."""

    bands: tuple[int, ...]
    dtype: str
    nodata: float | None
    add_mask: bool
    write_mask: bool
    append_alpha: bool
    validity: str
    levels: list[int]
    options: dict = field(default_factory=dict)


def plan(
    source: Source,
    profile: dict,
    indexes: tuple[int, ...] | int | None = None,
    nodata: float | None = None,
    dtype: str | None = None,
    add_mask: bool = False,
    overview_level: int | None = None,
    decimation_base: int = 2,
    colormap: dict | None = None,
) -> Plan:
    """The decisions, in this order: levels' base, bands, nodata against alpha and mask, colour map, alpha, JPEG, validity, photometric.

    Where there is nodata it decides what is valid; else an alpha band, else
    an internal mask.  An alpha band goes if a mask is asked for.  JPEG output
    of a raster with nodata or alpha gets a mask, and loses its alpha unless
    one or three bands are asked for.
    """
    if decimation_base <= 1:
        raise ValueError("decimation_base has to be 2 or more")
    if decimation_base > 2 and overview_level is None:
        raise ValueError("decimation_base above 2 needs an overview_level")
    options = dict(profile)
    bands = (indexes,) if isinstance(indexes, int) else tuple(indexes or range(1, source.count + 1))
    nodata = source.nodata if nodata is None else nodata
    alpha = "alpha" in source.colorinterp
    mask = source.internal_mask
    if nodata is not None and (alpha or mask):
        warnings.warn("The raster has nodata and an alpha band or mask; nodata is used.", NodataAlphaMaskWarning, stacklevel=3)
    if colormap and len(bands) > 1:
        raise IncompatibleOptions("a colour map needs a single band")
    opaque = tuple(b for b in bands if b > len(source.colorinterp) or source.colorinterp[b - 1] != "alpha")
    jpeg = str(options.get("compress", "")).lower() == "jpeg"
    if alpha and add_mask:
        bands = opaque
    elif jpeg and (nodata is not None or alpha) and not add_mask:
        warnings.warn("JPEG has neither nodata nor alpha; a mask is written.", stacklevel=3)
        add_mask = True
        if alpha and len(bands) not in (1, 3):
            bands = opaque
    validity = "nodata" if nodata is not None else "alpha" if alpha else "mask" if mask else "gcps" if source.gcps else "all"
    adds = nodata is None and not alpha and (mask or source.gcps)
    append = adds and not (add_mask or mask)
    if options.get("photometric", "").upper() == "YCBCR" and len(bands) == 1:
        warnings.warn("One band can't be YCbCr; MINISBLACK is used.", stacklevel=3)
        options["photometric"] = "MINISBLACK"
    tilesize = min(int(options.get("blockxsize", 512)), int(options.get("blockysize", 512)))
    n = grid.overview_levels(source.width, source.height, tilesize) if overview_level is None else overview_level
    return Plan(bands, dtype or source.dtype, None if add_mask else nodata, add_mask, add_mask or (mask and nodata is None), append, validity, [decimation_base**j for j in range(1, n + 1)], options)


#: Options of tiled TIFF output that a driver made for cloud-optimized files does not know.
_TILE_OPTIONS = ("blockxsize", "blockysize", "tiled", "photometric")


def cog_driver_options(made: Plan, overview_resampling: str, resampling: str, overview_level: int | None = None) -> dict:
    """A plan's options as a driver for cloud-optimized files spells them.

    Block sides become one, resampling methods are options, and no overviews
    are made where level 0 is asked for.
    """
    block = min(int(made.options.get("blockxsize", 512)), int(made.options.get("blockysize", 512)))
    out = {k: v for k, v in made.options.items() if k not in _TILE_OPTIONS}
    out |= {"driver": "COG", "blocksize": block, "overview_resampling": overview_resampling, "warp_resampling": resampling}
    if overview_level == 0:
        out["overviews"] = "NONE"
    if made.add_mask and out.get("compress") != "JPEG":
        warnings.warn("This driver keeps a mask beside JPEG only; the mask is written all the same.", stacklevel=3)
    return out


def is_off(config: dict | None, name: str) -> bool:
    """Whether a setting is given and switched off."""
    value = {str(k).upper(): v for k, v in (config or {}).items()}.get(name)
    return value is not None and str(value).lower() in ("false", "no", "off", "0")


def merged_tags(source: dict[str, str], resampling: str, tms: grid.TileMatrixSet | None = None, zoom: int | None = None, aligned_levels: int | None = None, extra: dict | None = None) -> dict[str, str]:
    """Dataset tags, later ones winning: the source's, resampling, tiling scheme, the caller's."""
    out = dict(source) | {"OVERVIEW_RESAMPLING": resampling.upper()}
    if tms:
        out |= {"TILING_SCHEME_NAME": tms.id or "CUSTOM", "TILING_SCHEME_ZOOM_LEVEL": str(zoom)}
        if aligned_levels:
            out["TILING_SCHEME_ALIGNED_LEVELS"] = str(aligned_levels)
    return out | {k: str(v) for k, v in (extra or {}).items()}
