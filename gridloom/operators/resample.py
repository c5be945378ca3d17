"""Resampling of blocks: output tiles look up the source blocks under them.

Output tiles are as small as it takes for the source under one, with what a
kernel reaches beyond it, to span a few blocks.  Each tile lists these blocks by
arithmetic, an equi-join on (block row, block column) brings them, and NumPy
works out the tile's pixels at once.  No pixel is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.projections import moved_arrays
from gridloom.operators import tiles
from gridloom.operators.warp import inverse

#: How far kernels reach, in pixels of the coarser grid.
REACH = {"nearest": 0.0, "bilinear": 1.0, "cubic": 2.0, "cubic_spline": 2.0, "lanczos": 3.0, "gauss": 1.5}
AREA = ("average", "rms", "sum", "mode")
#: Output pixels that are worked out in one go.
CHUNK = 1 << 16

#: From arrays of output (row, column) places to source (row, column) places, both in pixels.
Placing = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def placing(transform: tuple[float, ...], source_transform: tuple[float, ...], epsg: int | None = None, source_epsg: int | None = None) -> Placing:
    """Where output pixels lie in the source, by both grids' affine transforms and systems."""
    a, b, c, d, e, f = transform
    i = inverse(source_transform)

    def place(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = moved_arrays(a * col + b * row + c, d * col + e * row + f, epsg, source_epsg)
        return i[3] * x + i[4] * y + i[5], i[0] * x + i[1] * y + i[2]

    return place


def weight(distance: np.ndarray, method: str) -> np.ndarray:
    """The published kernels."""
    x = np.abs(distance)
    if method == "bilinear":
        return np.maximum(0, 1 - x)
    if method == "cubic":
        return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))
    if method == "cubic_spline":
        return np.where(x < 1, (4 + (3 * x - 6) * x * x) / 6, np.where(x < 2, (2 - x) ** 3 / 6, 0))
    if method == "lanczos":
        return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)
    if method == "gauss":
        return np.where(x < 1.5, np.exp(-2 * x * x), 0)
    raise ValueError(f"no resampling named {method}")


def sample(x: np.ndarray, ok: np.ndarray, place: Placing, row: np.ndarray, col: np.ndarray, method: str, scale: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(values, validity) by (bands, pixels) of output pixels (row, col), from a source window's values and validity.

    ``place`` gives places in the window.  Kernels are widened by ``scale``,
    source pixels (down, across) for an output pixel, where the output is
    coarser, and weigh valid pixels only; area methods weigh them by the area
    that they share with the output pixel.
    """
    high, wide = x.shape[1:]

    def at(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = (r >= 0) & (r < high) & (c >= 0) & (c < wide)
        r, c = np.where(inside, r, 0), np.where(inside, c, 0)
        return x[:, r, c], ok[:, r, c] & inside

    y_mid, x_mid = place(row + 0.5, col + 0.5)
    if method == "nearest":
        return at(np.floor(y_mid).astype(np.int64), np.floor(x_mid).astype(np.int64))
    if method in AREA:
        corners = [place(row + s, col + s) for s in (0.0, 1.0)]
        low, top = (np.minimum(*p) for p in zip(*corners)), (np.maximum(*p) for p in zip(*corners))
        (y0, x0), (y1, x1) = low, top
        first = np.floor(y0).astype(np.int64), np.floor(x0).astype(np.int64)
        last = np.maximum(first[0], np.ceil(y1).astype(np.int64) - 1), np.maximum(first[1], np.ceil(x1).astype(np.int64) - 1)
        share = [lambda n, a=a, b=b: np.maximum(np.minimum(n + 1, b) - np.maximum(n, a), 0) for a, b in ((y0, y1), (x0, x1))]
    else:
        by = [max(1.0, s) for s in scale]
        reach = [REACH[method] * w for w in by]
        first = tuple(np.ceil(m - 0.5 - r).astype(np.int64) for m, r in zip((y_mid, x_mid), reach))
        last = tuple(np.floor(m - 0.5 + r).astype(np.int64) for m, r in zip((y_mid, x_mid), reach))
        share = [lambda n, m=m, w=w: weight((n + 0.5 - m) / w, method) for m, w in zip((y_mid, x_mid), by)]
    spans = [int((b - a).max()) + 1 if len(a) else 0 for a, b in zip(first, last)]
    taps = []
    mass, total, met = np.zeros((len(x), len(row))), np.zeros((len(x), len(row))), np.zeros((len(x), len(row)), dtype=bool)
    for i in range(spans[0]):
        r = first[0] + i
        wy = np.where(r <= last[0], share[0](r), 0)
        for j in range(spans[1]):
            c = first[1] + j
            w = wy * np.where(c <= last[1], share[1](c), 0)
            v, here = at(r, c)
            here = here & (w != 0)
            if method == "mode":
                taps.append((v, np.where(here, w, 0)))
                continue
            w = np.where(here, w, 0)
            v = np.where(here, v, 0)
            met |= here
            mass += w
            total += w * (v * v if method == "rms" else v)
    if method == "mode":
        return heaviest(np.stack([v for v, _ in taps], axis=-1), np.stack([w for _, w in taps], axis=-1))
    if method == "sum":
        return total, met
    good = met & (np.abs(mass) > 1e-9)
    value = total / np.where(good, mass, 1)
    return np.sqrt(value) if method == "rms" else value, good


def heaviest(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the values along the last axis the one with the greatest weight in all, the least of several, and whether there is one."""
    values, weights = np.broadcast_arrays(values, weights)
    order = np.argsort(values, axis=-1, kind="stable")
    v, w = np.take_along_axis(values, order, axis=-1), np.take_along_axis(weights, order, axis=-1)
    n = v.shape[-1]
    new = np.ones(v.shape, dtype=bool)
    new[..., 1:] = v[..., 1:] != v[..., :-1]
    starts = np.flatnonzero(new)
    sums = np.round(np.add.reduceat(w.ravel(), starts), 12)
    row = starts // n
    best = np.lexsort((starts, -sums, row))
    best = best[np.append(True, row[best][1:] != row[best][:-1])]
    return v.ravel()[starts[best]].reshape(v.shape[:-1]), (sums[best] > 0).reshape(v.shape[:-1])


def resample(
    blocks: DataFrame, block: int, bands: int, dtype: str, size: tuple[int, int], out: tuple[int, int], place: Placing, method: str,
    scale: tuple[float, float] = (1.0, 1.0), level: int = 0, fill: float = 0.0, nodata: float | None = None, own: bool = False,
) -> DataFrame:
    """Blocks of an output raster of ``out`` (height, width) from the blocks of a source of ``size``.

    Cells without a valid source pixel hold ``fill``; ``nodata`` is invalid in
    each band by itself.  With ``own`` a cell also needs a valid pixel of its own
    under it.  Blocks that no source block is near are not made.
    """
    kind = np.dtype(dtype)
    most = max(1.0, *scale)
    side = block
    while side > 4 and side % 2 == 0 and side * most > block:
        side //= 2
    rows, cols = -(-out[0] // side), -(-out[1] // side)
    margin = math.ceil(REACH.get(method, 0.0) * most) + 2
    last = (size[0] - 1) // block, (size[1] - 1) // block

    def needs(batches):
        share = np.linspace(0, 1, 17)
        for batch in batches:
            found = []
            for tile in batch.column("id").to_pylist():
                r, c = divmod(tile, cols)
                r0, c0 = r * side, c * side
                r1, c1 = min(r0 + side, out[0]), min(c0 + side, out[1])
                gr, gc = np.meshgrid(r0 + share * (r1 - r0), c0 + share * (c1 - c0), indexing="ij")
                y, x = place(gr.ravel(), gc.ravel())
                if not (np.isfinite(y).all() and np.isfinite(x).all()):
                    y, x = np.array([0.0, size[0]]), np.array([0.0, size[1]])
                box = [(max(0, int(min((v.min() - margin) // block, 2**40))), min(n, int(max((v.max() + margin) // block, -1)))) for v, n in ((y, last[0]), (x, last[1]))]
                found += [(tile, i, j) for i in range(box[0][0], box[0][1] + 1) for j in range(box[1][0], box[1][1] + 1)]
            t, i, j = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["tile", "block_row", "block_col"])

    def make(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        tr, tc = divmod(tile, cols)
        r0, c0 = tr * side, tc * side
        high, wide = min(side, out[0] - r0), min(side, out[1] - c0)
        src = list(zip(table.column("block_row").to_pylist(), table.column("block_col").to_pylist(), table.column("data"), table.column("valid")))
        top, left = min(s[0] for s in src), min(s[1] for s in src)
        shape = (max(s[0] for s in src) - top + 1) * block, (max(s[1] for s in src) - left + 1) * block
        x, ok = np.zeros((bands, *shape), dtype=kind), np.zeros((bands, *shape), dtype=bool)
        for i, j, data, valid in src:
            here = (slice(None), slice((i - top) * block, (i - top + 1) * block), slice((j - left) * block, (j - left + 1) * block))
            x[here] = np.frombuffer(data.as_buffer(), dtype=kind).reshape(bands, block, block)
            ok[here] = np.frombuffer(valid.as_buffer(), dtype=np.uint8).reshape(block, block) > 0
        if nodata is not None:
            ok &= ~tiles.is_nodata(x, nodata)
        ok[:, max(0, size[0] - top * block) :] = False
        ok[:, :, max(0, size[1] - left * block) :] = False
        x = x.astype(np.float64)

        def in_window(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            y, z = place(row, col)
            return np.nan_to_num(y, nan=-1e9, posinf=-1e9, neginf=-1e9) - top * block, np.nan_to_num(z, nan=-1e9, posinf=-1e9, neginf=-1e9) - left * block

        value, good = np.zeros((bands, high * wide)), np.zeros((bands, high * wide), dtype=bool)
        for k in range(0, high * wide, CHUNK):
            part = np.arange(k, min(k + CHUNK, high * wide))
            row, col = r0 + part // wide, c0 + part % wide
            value[:, part], good[:, part] = sample(x, ok, in_window, row, col, method, scale)
            if own:
                good[:, part] &= sample(x, ok, in_window, row, col, "sum", scale)[1]
        made = np.full((bands, side, side), fill, dtype=kind)
        made[:, :high, :wide] = np.where(good, tiles.saturate(value, kind), kind.type(fill)).reshape(bands, high, wide)
        valid = np.zeros((side, side), dtype=np.uint8)
        valid[:high, :wide] = good.any(axis=0).reshape(high, wide)
        each = block // side
        piece = (level, tr // each, tc // each, tr % each * side, tc % each * side, 0, side, side, dtype, made.tobytes() + valid.tobytes())
        return pa.Table.from_batches([tiles.batch_of([piece], tiles.PIECE)])

    spark = blocks.sparkSession
    asked = spark.range(0, rows * cols, 1, max(1, min(rows * cols, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(needs, "tile long, block_row int, block_col int")
    pieces = asked.join(blocks.select("block_row", "block_col", "data", "valid"), ["block_row", "block_col"]).groupBy("tile").applyInArrow(make, tiles.PIECE)
    return tiles.joined(pieces, level, block, side, bands, kind, fill)


def kernel_overview(blocks: DataFrame, block: int, bands: int, dtype: str, size: tuple[int, int], factor: int, method: str, level: int, fill: float = 0.0, nodata: float | None = None) -> DataFrame:
    """An overview by a kernel, or by a factor that does not divide the block; a cell needs a valid pixel of its own, and its nearest is at its top left."""
    out, shift = (-(-size[0] // factor), -(-size[1] // factor)), (1 - factor) / 2 if method == "nearest" else 0.0
    place = lambda row, col: (row * float(factor) + shift, col * float(factor) + shift)
    return resample(blocks, block, bands, dtype, size, out, place, method, (factor, factor), level, fill, nodata, own=method in REACH and method != "nearest")
