"""Warping: every output pixel looks up the source pixel under its centre.

The output drives: its pixels are made where they are needed, their source
places are arithmetic, and the lookup is an equi-join on (row, col).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.projections import moved, moved_arrays, moved_point, zone

def output_grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(row, col) of every output pixel, made in parallel."""
    n = width * height
    ids = spark.range(0, n, 1, max(1, min(10_000, n >> 20)) or 1)
    return ids.select(F.expr(f"id div {width}").alias("row"), (F.col("id") % width).alias("col"))


def inverse(t: tuple[float, ...]) -> tuple[float, ...]:
    """The affine that undoes another (a, b, c, d, e, f)."""
    a, b, c, d, e, f = t
    det = a * e - b * d
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def moved_bounds(bounds: tuple[float, float, float, float], source: int | None, target: int | None, steps: int = 21) -> tuple[float, float, float, float]:
    """The box around a box's edge in another system."""
    left, bottom, right, top = bounds
    share = [i / (steps - 1) for i in range(steps)]
    edge = [(left + s * (right - left), y) for s in share for y in (bottom, top)] + [(x, bottom + s * (top - bottom)) for s in share for x in (left, right)]
    xs, ys = zip(*(moved_point(x, y, source, target) for x, y in edge))
    return min(xs), min(ys), max(xs), max(ys)


def suggested_resolution(transform: tuple[float, ...], width: int, height: int, source: int | None, target: int | None) -> float:
    """The pixel size in another system that keeps the number of pixels along the raster's diagonal."""
    a, b, c, d, e, f = transform
    x0, y0 = moved_point(c, f, source, target)
    x1, y1 = moved_point(a * width + b * height + c, d * width + e * height + f, source, target)
    return math.hypot(x1 - x0, y1 - y0) / math.hypot(width, height)


def source_place(grid: DataFrame, transform: tuple[float, ...], source_transform: tuple[float, ...], epsg: int | None = None, source_epsg: int | None = None) -> DataFrame:
    """Adds y and x, the place of each output pixel's centre in source pixels, and the places of its corners (y0, x0, y1, x1)."""
    a, b, c, d, e, f = transform
    i = inverse(source_transform)
    shifts = (("", 0.5), ("0", 0.0), ("1", 1.0))
    if {epsg, source_epsg} - {None} and epsg != source_epsg and any(zone(x) for x in (epsg, source_epsg) if x):
        names = ["row", "col", *(f"{n}{suffix}" for suffix, _ in shifts for n in "yx")]

        def run(batches):
            for batch in batches:
                row, col = (batch.column(n).to_numpy() for n in ("row", "col"))
                out = []
                for _, shift in shifts:
                    px, py = col + shift, row + shift
                    gx, gy = moved_arrays(a * px + b * py + c, d * px + e * py + f, epsg, source_epsg)
                    out += [i[3] * gx + i[4] * gy + i[5], i[0] * gx + i[1] * gy + i[2]]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("col"), *map(pa.array, out)], names)

        return grid.select("row", "col").mapInArrow(run, "row long, col long, " + ", ".join(f"{n} double" for n in names[2:]))

    def place(px: Column, py: Column) -> tuple[Column, Column]:
        gx, gy = moved(a * px + b * py + c, d * px + e * py + f, epsg, source_epsg)
        return i[0] * gx + i[1] * gy + i[2], i[3] * gx + i[4] * gy + i[5]

    out = {}
    for suffix, shift in shifts:
        out[f"x{suffix}"], out[f"y{suffix}"] = place(F.col("col") + shift, F.col("row") + shift)
    return grid.withColumns(out)


def kernel(d: Column, method: str) -> Column:
    """The published kernels as expressions of a distance in pixels."""
    x = F.abs(d)
    match method:
        case "bilinear":
            return F.greatest(F.lit(0.0), 1 - x)
        case "cubic":
            return F.when(x < 1, (1.5 * x - 2.5) * x * x + 1).when(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2).otherwise(0.0)
        case "cubic_spline":
            return F.when(x < 1, (4 + (3 * x - 6) * x * x) / 6).when(x < 2, (2 - x) * (2 - x) * (2 - x) / 6).otherwise(0.0)
        case "lanczos":
            turn = x * math.pi
            return F.when(x < 1e-12, 1.0).when(x < 3, 3 * F.sin(turn) * F.sin(turn / 3) / (turn * turn)).otherwise(0.0)
    raise ValueError(f"pixels are not warped by {method}")


_REACH = {"bilinear": 1, "cubic": 2, "cubic_spline": 2, "lanczos": 3}
_AREA = ("average", "rms", "sum", "mode")


def warp(pixels: DataFrame, places: DataFrame, method: str = "nearest", keys: tuple[str, ...] = (), scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(keys, row, col, value) of the output pixels at ``places``.

    ``nearest`` takes the pixel under the centre.  Kernels weigh the valid
    pixels around the place and are widened by ``scale``, source pixels (down,
    across) for an output pixel, where the output is coarser.  ``average``,
    ``rms``, ``sum`` and ``mode`` weigh the pixels under the output pixel by the
    area that they share with it.  Without a valid pixel there is no row, or a
    null value.
    """
    at = places.withColumnsRenamed({"row": "to_row", "col": "to_col"})
    if method == "nearest":
        at = at.select("to_row", "to_col", F.floor("y").cast("long").alias("row"), F.floor("x").cast("long").alias("col"))
        return at.join(pixels, ["row", "col"]).select(*keys, F.col("to_row").alias("row"), F.col("to_col").alias("col"), "value")
    if method in _AREA:
        low = {c: F.least(f"{c}0", f"{c}1") for c in "yx"}
        high = {c: F.greatest(f"{c}0", f"{c}1") for c in "yx"}
        span = {c: F.sequence(F.floor(low[c]).cast("long"), F.greatest(F.floor(low[c]), F.ceil(high[c]) - 1).cast("long")) for c in "yx"}
        share = {c: (lambda n, c=c: F.least(n + 1, high[c]) - F.greatest(n.cast("double"), low[c])) for c in "yx"}
    elif method in _REACH:
        wide = {c: max(1.0, s) for c, s in zip("yx", scale)}
        reach = {c: _REACH[method] * w for c, w in wide.items()}
        span = {c: F.sequence(F.ceil(F.col(c) - 0.5 - reach[c]).cast("long"), F.floor(F.col(c) - 0.5 + reach[c]).cast("long")) for c in "yx"}
        share = {c: (lambda n, c=c: kernel((n + 0.5 - F.col(c)) / wide[c], method)) for c in "yx"}
    else:
        raise ValueError(f"pixels are not warped by {method}")
    spread = at.withColumn("row", F.explode(span["y"])).withColumn("wy", share["y"](F.col("row"))).where("wy != 0")
    spread = spread.withColumn("col", F.explode(span["x"])).withColumn("w", F.col("wy") * share["x"](F.col("col"))).where("w != 0")
    met = spread.select("to_row", "to_col", "row", "col", "w").join(pixels.where("value is not null"), ["row", "col"])
    by = [*keys, "to_row", "to_col"]
    w, v = F.col("w"), F.col("value")
    if method == "mode":
        kinds = met.groupBy(*by, "value").agg(F.sum("w").alias("w"))
        found = kinds.groupBy(*by).agg(F.min_by("value", F.struct(-F.col("w"), v)).alias("value"))
    else:
        mass = F.sum("w")
        value = {"sum": F.sum(w * v), "rms": F.sqrt(F.sum(w * v * v) / mass)}.get(method, F.when(F.abs(mass) > 1e-9, F.sum(w * v) / mass))
        found = met.groupBy(*by).agg(value.alias("value"))
    return found.select(*keys, F.col("to_row").alias("row"), F.col("to_col").alias("col"), "value")


def affine_from_gcps(points: list[tuple[float, float, float, float, float]]) -> tuple[float, ...]:
    """The affine nearest to control points (row, col, x, y, z), by least squares."""
    p = np.array(points, dtype=np.float64)
    m = np.stack([p[:, 1], p[:, 0], np.ones(len(p))], axis=1)
    x, y = (np.linalg.lstsq(m, p[:, i], rcond=None)[0] for i in (2, 3))
    return (*map(float, x), *map(float, y))
