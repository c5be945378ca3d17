"""Translate a raster into a cloud-optimized file, and validate or describe files."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import warnings

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.operators import headers, info, pixels, resample, tiles, validate, warp
from gridloom.plans import policy
from gridloom.sources import datasource, tiff


def lists_folders(config: dict | None) -> bool:
    """Whether files beside a raster are looked for: overviews (.ovr) and a product's XML file."""
    return policy.is_off(config, "GDAL_DISABLE_READDIR_ON_OPEN")


def product_file(path: str) -> dict[str, dict[str, str]]:
    """The tags of the XML file that a satellite product has beside its raster, if any."""
    stem = os.path.splitext(datasource._file_path(path))[0]
    for name in (f"{stem}.XML", f"{stem}.xml"):
        if os.path.exists(name):
            with open(name, encoding="utf-8") as f:
                return tiff.product_tags(f.read())
    return {}


def describe_source(path: str) -> tuple[policy.Source, tiff.Directory, bool]:
    """What the header of a file says."""
    t = datasource.parsed(datasource._file_path(path))
    d, masked = t.directories[0], bool(t.masks or t.external)
    return policy.Source(d.width, d.height, d.samples, d.dtype.name, d.nodata, d.colorinterp(), masked, bool(d.gcps), bool(d.colormap())), d, masked


def _teller(quiet: bool, out):
    """A function that tells of a step."""
    if out is None:
        out = None if quiet else sys.stderr

    def say(text: str) -> None:
        if out is not None:
            print(text, file=out, flush=True)

    return say


def cog_translate(
    spark: SparkSession,
    source: str | os.PathLike | np.ndarray | tuple[DataFrame, policy.Source],
    dst_path: str,
    dst_kwargs: dict,
    indexes: tuple[int, ...] | int | None = None,
    nodata: float | None = None,
    dtype: str | None = None,
    add_mask: bool = False,
    overview_level: int | None = None,
    overview_resampling: str = "nearest",
    web_optimized: bool = False,
    tms: grid.TileMatrixSet | None = None,
    zoom_level_strategy: str = "auto",
    zoom_level: int | None = None,
    aligned_levels: int | None = None,
    resampling: str = "nearest",
    in_memory: bool | None = None,
    config: dict | None = None,
    allow_intermediate_compression: bool = False,
    forward_band_tags: bool = False,
    forward_ns_tags: bool = False,
    quiet: bool = False,
    progress_out=None,
    temporary_compression: str = "DEFLATE",
    colormap: dict | None = None,
    additional_cog_metadata: dict | None = None,
    use_cog_driver: bool = False,
    decimation_base: int = 2,
    transform: tuple[float, ...] | None = None,
    epsg: int | None = None,
    overwrite: bool = True,
) -> policy.Plan:
    """Write ``source`` (a path, an array of bands, rows, columns, or tile rows with their ``policy.Source``) as a cloud-optimized file.

    The header settles the plan on the driver; blocks are read, cut to the
    output's blocks, warped, reduced and encoded by the executors.

    ``config`` knows GDAL_TIFF_INTERNAL_MASK (off: the mask goes to a file
    beside the output, its name with .msk added) and GDAL_TIFF_OVR_BLOCKSIZE.
    ``in_memory``, ``allow_intermediate_compression`` and
    ``temporary_compression`` are accepted; Spark keeps, compresses and spills
    what lies between by itself.  Steps are told to ``progress_out``, or to
    stderr unless ``quiet``.
    """
    say = _teller(quiet, progress_out)
    datasource.register(spark)
    if web_optimized:
        warnings.warn("web_optimized is deprecated; give a tile matrix set as tms.", DeprecationWarning, stacklevel=2)
        tms = tms or grid.WEB_MERCATOR
    if isinstance(source, tuple):
        rows, src = source
        block_in = tuple(rows.agg(F.max("height"), F.max("width")).first())
        src_transform, src_epsg, meta, colors = transform or (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), epsg, {"dataset": {}, "bands": {}}, None
    elif isinstance(source, np.ndarray):
        src = policy.Source(source.shape[2], source.shape[1], source.shape[0], source.dtype.name, nodata, ["gray"] + ["undefined"] * (source.shape[0] - 1) if source.shape[0] < 3 else (["red", "green", "blue", "alpha"] + ["undefined"] * source.shape[0])[: source.shape[0]])
        rows, block_in = datasource.tiles_from_array(spark, source), (512, 512)
        src_transform, src_epsg, meta, colors = transform or (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), epsg, {"dataset": {}, "bands": {}}, None
    else:
        source = os.fspath(source)
        say(f"reading {source}")
        src, d, _ = describe_source(source)
        rows, block_in = spark.read.format("geotiff").load(source).where("level = 0"), d.block
        src_transform = transform or (warp.affine_from_gcps(d.gcps) if d.gcps else d.transform)
        src_epsg, meta, colors = epsg or d.epsg, d.metadata(), d.colormap()
        if lists_folders(config):
            meta["dataset"] = product_file(source) | meta["dataset"]
    plan = policy.plan(src, dst_kwargs, indexes, nodata, dtype, add_mask, overview_level, decimation_base, colormap)
    block = int(plan.options.get("blockxsize", 512))
    n_bands = len(plan.bands) + plan.append_alpha
    alpha = next((i + 1 for i, c in enumerate(src.colorinterp) if c == "alpha"), None)
    valid_nodata = src.nodata if nodata is None else nodata
    fill = float(valid_nodata) if plan.nodata is not None else 0.0
    band_nodata = fill if plan.nodata is not None and plan.validity == "nodata" else None

    wanted = {*plan.bands, *([alpha] if alpha else []), 0}
    pieces = tiles.cut(rows.where(F.col("band").isin(*wanted)), block_in, block)
    blocks = tiles.assemble(pieces, block, plan.bands, alpha, valid_nodata, plan.dtype, plan.validity, plan.append_alpha)
    width, height, place, out_epsg, zoom = src.width, src.height, src_transform, src_epsg, None
    if tms is not None:
        target_epsg = int(tms.crs.split(":")[1]) if tms.crs.startswith("EPSG:") else None
        a, _, c, _, e, f = src_transform
        box = (min(c, c + a * width), min(f, f + e * height), max(c, c + a * width), max(f, f + e * height))
        moved = warp.moved_bounds(box, src_epsg, target_epsg)
        res = max(abs(a), abs(e)) if src_epsg in (None, target_epsg) else warp.suggested_resolution(src_transform, width, height, src_epsg, target_epsg)
        out = grid.aligned(moved, res, zoom_level_strategy, zoom_level, aligned_levels, tms)
        cell = abs(out["transform"][0])
        scale = cell * height / (moved[3] - moved[1]), cell * width / (moved[2] - moved[0])
        where = resample.placing(out["transform"], src_transform, target_epsg, src_epsg)
        blocks = resample.resample(blocks, block, n_bands, plan.dtype, (height, width), (out["height"], out["width"]), where, resampling, scale, 0, fill, band_nodata)
        width, height, place, out_epsg, zoom = out["width"], out["height"], out["transform"], target_epsg, out["zoom"]
        if overview_level is None:
            plan.levels = [decimation_base**j for j in range(1, grid.overview_levels(width, height, block) + 1)]
    if use_cog_driver:
        plan.options |= policy.cog_driver_options(plan, overview_resampling, resampling, overview_level)
    settings = {str(k).upper(): v for k, v in (config or {}).items()}
    small_block = int(settings.get("GDAL_TIFF_OVR_BLOCKSIZE", block))
    if small_block % 16 or small_block <= 0:
        raise ValueError("the block size of overviews has to be a multiple of 16")
    say(f"{len(plan.levels)} overviews by {overview_resampling}")
    blocks = blocks.persist()
    levels = [blocks]
    for i, factor in enumerate(plan.levels, 1):
        if overview_resampling in pixels.KERNELS or block % factor:
            levels.append(resample.kernel_overview(blocks, block, n_bands, plan.dtype, (height, width), factor, overview_resampling, i, fill, band_nodata))
        else:
            levels.append(tiles.overview(blocks, i, factor, block, n_bands, plan.dtype, overview_resampling, fill, band_nodata))
    separate = str(plan.options.get("interleave", "pixel")).lower() == "band"
    mask = plan.write_mask and not plan.append_alpha
    output = tiles.output_rows(levels[0], n_bands, block, plan.dtype, separate, mask)
    for level in levels[1:]:
        level = tiles.reblocked(level, block, small_block, n_bands, plan.dtype)
        output = output.union(tiles.output_rows(level, n_bands, small_block, plan.dtype, separate, mask))

    interp = [src.colorinterp[b - 1] for b in plan.bands] + ["alpha"] * plan.append_alpha
    if n_bands == 1 and interp != ["palette"] and not colormap:
        interp = ["gray"]
    tags = policy.merged_tags(meta["dataset"].get("", {}), overview_resampling, tms, zoom, aligned_levels, additional_cog_metadata)
    domains = {k: v for k, v in meta["dataset"].items() if k and k not in ("IMAGE_STRUCTURE", "DERIVED_SUBDATASETS")} if forward_ns_tags else {}
    about = {i: {k: v for k, v in meta["bands"].get(b, {}).items() if k != "tags" or forward_band_tags} for i, b in enumerate(plan.bands, 1)}
    options = {
        "width": width, "height": height, "bands": n_bands, "dtype": plan.dtype, "block": block, "overview_block": small_block, "mask": str(mask).lower(),
        "internal_mask": str(not policy.is_off(config, "GDAL_TIFF_INTERNAL_MASK")).lower(),
        "factors": ",".join(map(str, plan.levels)),
        "meta": json.dumps({"compress": plan.options.get("compress"), "interleave": plan.options.get("interleave", "pixel"), "photometric": plan.options.get("photometric"), "quality": next((v for k, v in plan.options.items() if k.lower() in ("jpeg_quality", "quality")), None), "nodata": plan.nodata, "transform": place, "epsg": out_epsg, "colorinterp": interp, "colormap": (colormap or colors) if n_bands == 1 else None, "xml": tiff.metadata_xml({"": tags, **domains}, about)}),
    }
    say(f"writing {dst_path}")
    writer = output.write.format("cog").mode("overwrite" if overwrite else "append")
    writer.options(**{k: str(v) for k, v in options.items()}).option("path", os.path.abspath(datasource._file_path(os.fspath(dst_path)))).save()
    blocks.unpersist()
    say(f"{dst_path} is written")
    return plan


def cog_validate(spark: SparkSession, path: str, strict: bool = False, config: dict | None = None, quiet: bool = False, list_folder: bool = False) -> tuple[bool, list[str], list[str]]:
    """(valid, errors, warnings) of one file; what is found is told to stderr unless ``quiet``.

    External overviews are looked for if the folder is listed, which
    ``list_folder`` or GDAL_DISABLE_READDIR_ON_OPEN off in ``config`` asks for.
    """
    beside = None
    path = os.fspath(path)
    if list_folder or lists_folders(config):
        folder = os.path.dirname(os.path.abspath(datasource._file_path(path)))
        beside = headers.sidecars(spark, folder)
    row = validate.validate_files(headers.read_headers(spark, path), strict, beside).first()
    say = _teller(quiet, None)
    for title, found in (("Errors", row["errors"]), ("Warnings", row["warnings"])):
        if found:
            say("\n".join([f"{title}:", *(f"- {x}" for x in found)]))
    return row["valid"], row["errors"], row["warnings"]


def cog_info(spark: SparkSession, path: str, strict: bool = False, config: dict | None = None, quiet: bool = True) -> Row:
    """The description of one file; ``config`` and ``quiet`` as for ``cog_validate``."""
    return info.info(headers.read_headers(spark, os.fspath(path)), strict).first()


def warped_source(spark: SparkSession, path: str, transform: tuple[float, ...], width: int, height: int, epsg: int | None = None, resampling: str = "nearest", block: int = 512) -> tuple[DataFrame, policy.Source]:
    """A file as it looks on another grid, as a source for ``cog_translate`` (with that transform and code); no pixel is read before one is asked for.

    Cells without a valid source pixel hold nodata, where there is one, and are
    out of the mask, which it has wherever the file has a mask or nothing that
    says what is valid.
    """
    datasource.register(spark)
    path = os.fspath(path)
    src, d, _ = describe_source(path)
    bands = tuple(range(1, src.count + 1))
    alpha = next((i for i, c in enumerate(src.colorinterp, 1) if c == "alpha"), None)
    validity = "nodata" if src.nodata is not None else "alpha" if alpha else "mask" if src.internal_mask else "all"
    pieces = tiles.cut(spark.read.format("geotiff").load(path).where("level = 0"), d.block, block)
    blocks = tiles.assemble(pieces, block, bands, alpha, src.nodata, src.dtype, validity, False)
    own = warp.affine_from_gcps(d.gcps) if d.gcps else d.transform
    place = resample.placing(transform, own, epsg, d.epsg)
    high, wide = (abs(b - a) for a, b in zip(place(np.array([0.0]), np.array([0.0])), place(np.array([float(height)]), np.array([float(width)]))))
    scale = float(high[0] / height), float(wide[0] / width)
    fill = float(src.nodata or 0.0)
    found = resample.resample(blocks, block, src.count, src.dtype, (src.height, src.width), (height, width), place, resampling, scale, 0, fill, src.nodata if validity == "nodata" else None)
    masked = validity in ("mask", "all")
    rows = tiles.tile_rows(found, block, src.count, src.dtype, width, height, path, masked)
    return rows, policy.Source(width, height, src.count, src.dtype, src.nodata, src.colorinterp, masked)


def cog_in_memory(spark: SparkSession, source, dst_kwargs: dict, folder: str | None = None, **options) -> bytes:
    """What ``cog_translate`` would write, as bytes; it lies in ``folder``, which executors must mount, until it is read."""
    if folder is None and ("cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local")):
        raise ValueError("name a folder that all executors mount")
    with tempfile.TemporaryDirectory(dir=folder) as made:
        cog_translate(spark, source, f"{made}/out.tif", dst_kwargs, **options)
        return cog_bytes(f"{made}/out.tif")


def cog_bytes(path: str) -> bytes:
    """A written file's content, for those who want it in memory."""
    with open(datasource._file_path(path), "rb") as f:
        return f.read()


def validate_all(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """The verdict on every file of a path."""
    return validate.validate_files(headers.read_headers(spark, path), strict)
