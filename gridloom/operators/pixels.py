"""Rasters as rows of pixels (row, col, value): overviews, resampling, bands, masks.

Null is nodata.  Every overview is one aggregate whose partial results combine
before the shuffle; what a level takes from the one before are sums and counts,
never averages, so these stay exact where cells are missing.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, exp, pi, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATED = ("average", "rms", "sum", "mode", "min", "max")
KERNELS = ("bilinear", "cubic", "cubic_spline", "lanczos", "gauss")
OVERVIEW_RESAMPLING = ("nearest", "bilinear", "cubic", "cubic_spline", "lanczos", "average", "mode", "gauss", "rms")
WARP_RESAMPLING = ("nearest", "bilinear", "cubic", "cubic_spline", "lanczos", "average", "mode", "sum", "rms")


def cell(place: str, factor: int) -> Column:
    return F.floor(F.col(place) / factor).cast("long")


def overview(pixels: DataFrame, factor: int, method: str = "average", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, row, col, n_valid, value) decimated by a whole factor; cells without valid pixels have a null value.

    ``nearest`` takes the pixel at the cell's top left.  ``mode`` takes the most
    frequent value, of equally frequent ones the least.
    """
    at = [*map(F.col, keys), cell("row", factor).alias("row"), cell("col", factor).alias("col")]
    if method == "nearest":
        corner = pixels.where((F.pmod("row", F.lit(factor)) == 0) & (F.pmod("col", F.lit(factor)) == 0))
        return corner.select(*at, F.col("value").isNotNull().cast("long").alias("n_valid"), "value")
    if method == "mode":
        counts = pixels.groupBy(*at, "value").agg(F.count("value").alias("n"))
        best = F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value"))))
        return counts.groupBy(*keys, "row", "col").agg(F.sum("n").alias("n_valid"), best.alias("value"))
    value = {
        "average": F.try_divide(F.sum("value"), F.count("value")),
        "rms": F.sqrt(F.try_divide(F.sum(F.col("value") * F.col("value")), F.count("value"))),
        "sum": F.sum("value"),
        "min": F.min("value"),
        "max": F.max("value"),
    }.get(method)
    if value is None:
        return kernel_overview(pixels, factor, method, keys)
    return pixels.groupBy(*at).agg(F.count("value").alias("n_valid"), value.alias("value"))


def kernel_weight(x: float, method: str) -> float:
    """The published kernels, at a distance in output cells."""
    x = abs(x)
    match method:
        case "bilinear":
            return max(0.0, 1 - x)
        case "cubic":
            return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0
        case "cubic_spline":
            return (4 - 6 * x**2 + 3 * x**3) / 6 if x < 1 else (2 - x) ** 3 / 6 if x < 2 else 0.0
        case "lanczos":
            return 1.0 if x == 0 else 3 * sin(pi * x) * sin(pi * x / 3) / (pi * x) ** 2 if x < 3 else 0.0
        case "gauss":
            return exp(-2 * x * x) if x < 1.5 else 0.0
    raise ValueError(f"no resampling named {method}")


def kernel_table(factor: int, method: str) -> list[tuple[int, int, float]]:
    """(place within a cell, cells away, weight) of an axis; the weights of an output cell's axis sum to about 1."""
    reach = {"bilinear": 1, "cubic": 2, "cubic_spline": 2, "lanczos": 3, "gauss": 1.5}[method]
    out = []
    for place in range(factor):
        for away in range(-ceil(reach), ceil(reach) + 1):
            w = kernel_weight((place + 0.5) / factor - 0.5 - away, method) / factor
            if w:
                out.append((place, away, w))
    return out


def kernel_overview(pixels: DataFrame, factor: int, method: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Separable kernels: each pixel gives weighted shares to the cells around it, normalised by the valid weight.

    Cells beyond the raster's own are not made; so each cell needs a pixel of its own.
    """
    table = kernel_table(factor, method)
    of_place = F.array(*(F.array(*(F.struct(F.lit(a).alias("away"), F.lit(w).alias("w")) for p, a, w in table if p == place)) for place in range(factor)))
    axis = lambda c: F.get(of_place, F.pmod(c, F.lit(factor)).cast("int"))
    shares = pixels.where("value is not null").withColumn("y", F.explode(axis("row"))).withColumn("x", F.explode(axis("col")))
    to = [(cell("row", factor) + F.col("y.away")).alias("row"), (cell("col", factor) + F.col("x.away")).alias("col")]
    weight = F.col("y.w") * F.col("x.w")
    total, mass = F.sum(weight * F.col("value")), F.sum(weight)
    made = shares.groupBy(*keys, *to).agg(F.when(F.abs(mass) > 1e-9, total / mass).alias("value"))
    own = pixels.groupBy(*keys, cell("row", factor).alias("row"), cell("col", factor).alias("col")).agg(F.count("value").alias("n_valid"))
    return own.join(made, [*keys, "row", "col"], "left").select(*keys, "row", "col", "n_valid", F.when(F.col("n_valid") > 0, F.col("value")).alias("value"))


def pyramid(pixels: DataFrame, levels: int, base: int = 2, method: str = "average", keys: tuple[str, ...] = ()) -> DataFrame:
    """All overviews, with their level (1 the finest).

    Averages, sums and extremes carry sums, counts and extremes from level to
    level, so the pixels are read once and every level is as exact as if it came
    straight from them; other methods read the pixels for each level.
    """
    if levels < 1:
        return overview(pixels.limit(0), base, method, keys).withColumn("level", F.lit(0).cast("long"))
    if method not in ("average", "rms", "sum", "min", "max"):
        return reduce(DataFrame.unionByName, (overview(pixels, base**j, method, keys).withColumn("level", F.lit(j).cast("long")) for j in range(1, levels + 1)))
    v = F.col("value")
    state, fold = {"min": (v, F.min), "max": (v, F.max), "rms": (v * v, F.sum)}.get(method, (v, F.sum))
    now, out = pixels.select(*keys, "row", "col", state.alias("s"), v.isNotNull().cast("long").alias("n_valid")), []
    value = {"average": F.try_divide("s", "n_valid"), "rms": F.sqrt(F.try_divide("s", "n_valid"))}.get(method, F.col("s"))
    for j in range(1, levels + 1):
        now = now.groupBy(*map(F.col, keys), cell("row", base).alias("row"), cell("col", base).alias("col")).agg(fold("s").alias("s"), F.sum("n_valid").alias("n_valid"))
        out.append(now.select(*keys, "row", "col", "n_valid", value.alias("value"), F.lit(j).cast("long").alias("level")))
    return reduce(DataFrame.unionByName, out)


def select_bands(pixels: DataFrame, wanted: tuple[int, ...] | int | None) -> DataFrame:
    """Bands in the order asked for, numbered anew; a band may be asked for more than once, none means all."""
    if not wanted and wanted != 0:
        return pixels
    wanted = (wanted,) if isinstance(wanted, int) else wanted
    order = pixels.sparkSession.createDataFrame([(i, b) for i, b in enumerate(wanted, 1)], "out_band int, band int")
    return pixels.join(F.broadcast(order), "band").drop("band").withColumnRenamed("out_band", "band")


def with_nodata(pixels: DataFrame, nodata: float | None) -> DataFrame:
    """Nodata values, NaN among them, as null."""
    if nodata is None:
        return pixels
    is_nodata = F.isnan(F.col("value").cast("double")) if nodata != nodata else F.col("value") == nodata
    return pixels.withColumn("value", F.when(~is_nodata, F.col("value")))


def mask(value: Column) -> Column:
    """255 where there is data, else 0."""
    return F.when(value.isNull(), 0).otherwise(255).cast("long")


_RANGES = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "uint32": (0, 4294967295), "int32": (-2147483648, 2147483647)}


def cast_pixels(value: Column, dtype: str) -> Column:
    """A value in a pixel type: whole types are rounded half away from zero and held within their range."""
    if dtype == "float32":
        return value.cast("float").cast("double")
    if dtype == "float64":
        return value.cast("double")
    low, high = _RANGES[dtype]
    return F.least(F.greatest(F.signum(value) * F.floor(F.abs(value) + 0.5), F.lit(float(low))), F.lit(float(high))).cast("long")


def add_alpha(pixels: DataFrame, band: int) -> DataFrame:
    """The pixels with a band of opacity made from the first band's validity."""
    alpha = pixels.where("band = 1").withColumn("value", mask(F.col("value")).cast(pixels.schema["value"].dataType)).withColumn("band", F.lit(band).cast(pixels.schema["band"].dataType))
    return pixels.unionByName(alpha)


def block_windows(width: Column, height: Column, block: int) -> Column:
    """All blocks of a raster: array of (block_row, block_col, n_rows, n_cols)."""
    rows, cols = F.sequence(F.lit(0), F.ceil(height / block).cast("int") - 1), F.sequence(F.lit(0), F.ceil(width / block).cast("int") - 1)
    one = lambda r, c: F.struct(r.cast("long").alias("block_row"), c.cast("long").alias("block_col"), F.least(F.lit(block), height - r * block).cast("long").alias("n_rows"), F.least(F.lit(block), width - c * block).cast("long").alias("n_cols"))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: one(r, c))))


def directory_rules(ifds: DataFrame) -> DataFrame:
    """(path, level, backwards): directories that begin before the one above them."""
    before = F.lag("ifd_offset").over(Window.partitionBy("path").orderBy("level"))
    return ifds.withColumn("backwards", F.coalesce(F.col("ifd_offset") < before, F.lit(False))).select("path", "level", "ifd_offset", "backwards")
