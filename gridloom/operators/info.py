"""What a raster file is: one nested row for each file, or the same as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.operators import validate

_MODELS = {0: "MINISWHITE", 1: "MINISBLACK", 2: "RGB", 3: "PALETTE", 4: "MASK", 5: "CMYK", 6: "YCBCR", 8: "CIELAB"}


def has_alpha(bands: Column) -> Column:
    return F.exists(bands, lambda b: b["colorinterp"] == "alpha")


def non_alpha(bands: Column) -> Column:
    """The numbers of the bands whose colour interpretation is not alpha."""
    return F.transform(F.filter(bands, lambda b: b["colorinterp"] != "alpha"), lambda b: b["band"])


def namespace_title(name: Column) -> Column:
    """A tag namespace as a title: underscores become spaces, words begin with a capital."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def bounds(transform: Column, width: Column, height: Column) -> Column:
    """left, bottom, right, top of a raster without rotation."""
    a, c, e, f = (F.get(transform, F.lit(i)) for i in (0, 2, 4, 5))
    x, y = c + a * width, f + e * height
    return F.array(F.least(c, x), F.least(f, y), F.greatest(c, x), F.greatest(f, y))


def info(headers: DataFrame, strict: bool = False) -> DataFrame:
    """The description of every file of ``read_headers``.

    Zoom levels are those of the raster in Web Mercator, with the cell that keeps
    the pixels along the diagonal, and the size that it has there; they are null
    for coordinate systems that ``functions.projections`` does not know.
    """
    checked = validate.validate_files(headers, strict).select("path", F.col("valid").alias("COG"), F.col("errors").alias("COG_errors"), F.col("warnings").alias("COG_warnings"))
    t = F.col("transform")
    part = lambda i: F.get(t, F.lit(i))
    metres, *size = (F.get("web", F.lit(i)) for i in range(3))
    halvings = grid.overview_count(*size, 256)
    models = F.create_map(*(F.lit(x) for kv in _MODELS.items() for x in kv))
    profile = F.struct(
        F.col("count").alias("Bands"), F.col("width").alias("Width"), F.col("height").alias("Height"),
        (F.get("ifds", F.lit(0))["block_w"] != F.col("width")).alias("Tiled"), F.col("dtype").alias("Dtype"), F.col("interleave").alias("Interleave"),
        has_alpha(F.col("bands")).alias("AlphaBand"), F.col("internal_mask").alias("InternalMask"), F.col("nodata").alias("Nodata"),
        F.transform("bands", lambda b: b["colorinterp"]).alias("ColorInterp"), (F.col("n_colors") > 0).alias("ColorMap"),
        F.transform("bands", lambda b: b["scale"]).alias("Scales"), F.transform("bands", lambda b: b["offset"]).alias("Offsets"),
    )
    geo = F.struct(
        F.concat(F.lit("EPSG:"), F.col("epsg").cast("string")).alias("CRS"), bounds(t, F.col("width"), F.col("height")).alias("BoundingBox"),
        F.array(part(2), part(5)).alias("Origin"), F.array(part(0), part(4)).alias("Resolution"),
        F.when(metres > 0, grid.zoom_for_res(metres * F.pow(F.lit(2.0), halvings))).cast("int").alias("MinZoom"), F.when(metres > 0, grid.zoom_for_res(metres)).cast("int").alias("MaxZoom"),
    )
    tags = F.transform_keys(F.map_filter("tags", lambda k, _: k != "DERIVED_SUBDATASETS"), lambda k, _: F.when(k == "", "Image Metadata").otherwise(namespace_title(k)))
    band = lambda b: F.struct(b["band"].cast("string").alias("key"), F.struct(b["description"].alias("Description"), b["colorinterp"].alias("ColorInterp"), b["offset"].alias("Offset"), b["scale"].alias("Scale"), F.when(F.size(b["tags"]) > 0, b["tags"]).alias("Metadata")).alias("value"))
    ifd = lambda x: F.struct(x["level"].alias("Level"), x["width"].alias("Width"), x["height"].alias("Height"), F.array(x["block_h"], x["block_w"]).alias("Blocksize"), x["decimation"].alias("Decimation"))
    tiff = F.col("driver") == "GTiff"
    return headers.join(checked, "path").select(
        F.col("path").alias("Path"), F.col("driver").alias("Driver"), "COG", F.col("compression").alias("Compression"), models[F.col("photometric")].alias("ColorSpace"),
        F.when(F.size("COG_errors") > 0, F.col("COG_errors")).alias("COG_errors"), F.when(F.size("COG_warnings") > 0, F.col("COG_warnings")).alias("COG_warnings"),
        F.when(tiff, profile).alias("Profile"), F.when(tiff, geo).alias("GEO"), tags.alias("Tags"),
        F.map_from_entries(F.transform("bands", band)).alias("Band Metadata"), F.transform("ifds", ifd).alias("IFD"),
    )


def info_json(described: DataFrame) -> DataFrame:
    """(Path, json): null fields are left out."""
    return described.select("Path", F.to_json(F.struct(*(F.col(f"`{c}`") for c in described.columns))).alias("json"))
