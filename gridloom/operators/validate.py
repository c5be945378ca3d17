"""Layout rules of cloud-optimized files, as DataFrame expressions over header tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rasters up to this size on a side need neither tiles nor overviews.
SMALL = 512
#: The first directory has to begin within so many bytes.
FIRST_IFD = 300


def first_block_offsets(blocks: DataFrame) -> DataFrame:
    """(path, level, first_offset): of the blocks with data the first in row-major order."""
    order = F.struct("block_y", "block_x", "offset")
    return blocks.groupBy("path", "level").agg(F.min_by(F.col("offset"), F.when(F.col("offset") > 0, order)).alias("first_offset"))


def level_arrays(ifds: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, levels): each file's directories in order, with the offset of their first data."""
    joined = ifds.join(first_block_offsets(blocks), ["path", "level"], "left")
    entry = F.struct("level", "width", "height", "block_h", "block_w", "decimation", "ifd_offset", "first_offset")
    return joined.groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("levels"))


def _message(condition: Column, *parts) -> Column:
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.when(F.coalesce(condition, F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>"))


def rule_messages(levels: Column, ghost: Column, has_sidecar: Column) -> tuple[Column, Column]:
    """(errors, warnings), in the order in which the rules are stated."""
    main, overviews = F.get(levels, F.lit(0)), F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0)))
    large = lambda x: (x["width"] > SMALL) & (x["height"] > SMALL)
    with_data = F.filter(levels, lambda x: x["first_offset"].isNotNull())
    deep = F.filter(overviews, lambda x: x["first_offset"].isNotNull())
    factors = F.transform(overviews, lambda x: x["decimation"])
    last, last_data = F.element_at(levels, -1), F.try_element_at(with_data, F.lit(-1))

    def overview(x: Column, i: Column) -> Column:
        before = F.get(levels, i)
        return F.concat(
            _message(x["decimation"] <= 1, "overview ", i, " has the decimation ", x["decimation"]),
            _message((i == 0) & (x["ifd_offset"] < before["ifd_offset"]), "the directory of overview 0 begins at ", x["ifd_offset"], ", before that of the full resolution at ", before["ifd_offset"]),
            _message((i > 0) & (x["ifd_offset"] < before["ifd_offset"]), "the directory of overview ", i, " begins at ", x["ifd_offset"], ", before that of overview ", i - 1, " at ", before["ifd_offset"]),
        )

    def backwards(x: Column, i: Column) -> Column:
        after = F.get(deep, i + 1)
        return _message(x["first_offset"] < after["first_offset"], "data of overview ", x["level"] - 1, " begin before those of overview ", after["level"] - 1)

    first_over = F.get(deep, F.lit(0))
    errors = [
        _message(has_sidecar, "overviews are in an external .ovr file"),
        _message(large(main) & (main["block_w"] == main["width"]), "the raster is larger than 512 x 512 and not tiled"),
        _message(main["ifd_offset"] > FIRST_IFD, "the first directory begins at ", main["ifd_offset"], ", beyond ", str(FIRST_IFD)),
        _message(ghost["KNOWN_INCOMPATIBLE_EDITION"] == "YES", "the file had an optimized layout that a later edit broke"),
        _message(factors != F.array_sort(factors), "overviews are not sorted by size"),
        F.flatten(F.transform(overviews, overview)),
        _message(last_data["first_offset"] < last["ifd_offset"], "data of level ", last_data["level"], " begin at ", last_data["first_offset"], ", before the last directory at ", last["ifd_offset"]),
        F.flatten(F.reverse(F.transform(deep, backwards))),
        _message((F.size(with_data) > 1) & main["first_offset"].isNotNull() & (main["first_offset"] < first_over["first_offset"]), "data of the full resolution begin before those of overview ", first_over["level"] - 1),
        F.flatten(F.transform(overviews, lambda x, i: _message(large(x) & (x["block_w"] == x["width"]), "overview ", i, " is not tiled"))),
    ]
    warnings = _message(large(main) & (F.size(overviews) == 0), "the raster is larger than 512 x 512 and has no overviews")
    return reduce(lambda a, b: F.concat(a, b), errors), warnings


def validate(levels: DataFrame, strict: bool = False) -> DataFrame:
    """(path, valid, errors, warnings) of (path, driver, levels, ghost, has_sidecar).

    A file that is no TIFF gets that one error.  Blocks without data (sparse
    files) are passed over; a level without any takes no part in the rules on
    the order of data.
    """
    errors, warnings = rule_messages(F.col("levels"), F.col("ghost"), F.col("has_sidecar"))
    tiff = F.col("driver") == "GTiff"
    none = F.array().cast("array<string>")
    out = levels.select("path", F.when(tiff, errors).otherwise(F.array(F.lit("the file is not a GeoTIFF"))).alias("errors"), F.when(tiff, warnings).otherwise(none).alias("warnings"))
    bad = F.size("errors") > 0
    return out.select("path", (~(bad | (F.size("warnings") > 0)) if strict else ~bad).alias("valid"), "errors", "warnings")


def validate_files(headers: DataFrame, strict: bool = False, with_sidecars: DataFrame | None = None) -> DataFrame:
    """``validate`` of header rows; ``with_sidecars`` lists the paths that have an external overview file."""
    levels = F.transform(
        "ifds",
        lambda x: F.struct(
            *(x[c].alias(c) for c in ("level", "width", "height", "block_h", "block_w", "decimation", "ifd_offset")),
            F.array_min(F.transform(F.filter("blocks", lambda b: (b["level"] == x["level"]) & (b["offset"] > 0)), lambda b: F.struct(b["block_y"], b["block_x"], b["offset"].alias("offset"))))["offset"].alias("first_offset"),
        ),
    )
    rows = headers.select("path", "driver", levels.alias("levels"), "ghost")
    if with_sidecars is None:
        rows = rows.withColumn("has_sidecar", F.lit(False))
    else:
        rows = rows.join(with_sidecars.select("path", F.lit(True).alias("has_sidecar")).distinct(), "path", "left").withColumn("has_sidecar", F.coalesce("has_sidecar", F.lit(False)))
    return validate(rows, strict)
