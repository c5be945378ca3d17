"""Rasters as rows of blocks: selection, casting, re-blocking and overviews in NumPy.

A block row is (level, block_row, block_col, bands, valid): all bands of a
block as one array of (bands, block, block) doubles or whole numbers, and its
validity.  Blocks at the edge are filled up; what lies beyond the raster is
invalid.  Groups are the few pieces that make up one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "level int, block_row int, block_col int, data binary, valid binary"
PIECE = "level int, block_row int, block_col int, at_row int, at_col int, band int, h int, w int, dtype string, data binary"


def saturate(x: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """Values in another pixel type: whole types are rounded and held within their range."""
    if dtype.kind == "f" or x.dtype == dtype:
        return x.astype(dtype)
    limits = np.iinfo(dtype)
    y = np.nan_to_num(x.astype(np.float64), nan=0.0, posinf=limits.max, neginf=limits.min)
    return np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), limits.min, limits.max).astype(dtype)


def cut(tiles: DataFrame, source_block: tuple[int, int], block: int) -> DataFrame:
    """The pieces of full-size ``tiles`` that fall into each output block."""
    sh, sw = source_block

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                x = np.frombuffer(row["data"], dtype=np.dtype(row["dtype"]).newbyteorder("<")).reshape(row["height"], row["width"])
                top, left = row["block_row"] * sh, row["block_col"] * sw
                for r in range(top // block, (top + row["height"] - 1) // block + 1):
                    for c in range(left // block, (left + row["width"] - 1) // block + 1):
                        y0, x0 = max(top, r * block), max(left, c * block)
                        part = x[y0 - top : (r + 1) * block - top, x0 - left : (c + 1) * block - left]
                        out.append((0, r, c, y0 - r * block, x0 - c * block, row["band"], *part.shape, row["dtype"], np.ascontiguousarray(part).tobytes()))
            yield batch_of(out, PIECE)

    return tiles.mapInArrow(run, PIECE)


_ARROW = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of BLOCK, PIECE or the like."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=_ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def assemble(pieces: DataFrame, block: int, bands: tuple[int, ...], alpha: int | None, nodata: float | None, dtype: str, validity: str, append_alpha: bool) -> DataFrame:
    """Output blocks of the bands asked for, in their type, with validity by nodata, alpha, mask or none."""
    kind = np.dtype(dtype)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        planes: dict[int, np.ndarray] = {}
        inside = np.zeros((block, block), dtype=bool)
        for r in rows:
            x = np.frombuffer(r["data"], dtype=np.dtype(r["dtype"]).newbyteorder("<")).reshape(r["h"], r["w"])
            plane = planes.setdefault(r["band"], np.zeros((block, block), dtype=x.dtype.newbyteorder("=")))
            plane[r["at_row"] : r["at_row"] + r["h"], r["at_col"] : r["at_col"] + r["w"]] = x
            inside[r["at_row"] : r["at_row"] + r["h"], r["at_col"] : r["at_col"] + r["w"]] = True
        chosen = [planes[b] for b in bands]
        valid = inside
        if validity == "nodata":
            valid = inside & ~np.all([is_nodata(x.astype(np.float64), nodata) for x in chosen], axis=0)
        elif validity == "alpha" and alpha in planes:
            valid = inside & (planes[alpha] > 0)
        elif validity == "mask" and 0 in planes:
            valid = inside & (planes[0] > 0)
        out = [saturate(x, kind) for x in chosen]
        if append_alpha:
            top = 255 if kind.kind != "f" else 255.0
            out.append((valid * top).astype(kind))
        first = rows[0]
        return pa.Table.from_batches([batch_of([(0, first["block_row"], first["block_col"], np.stack(out).tobytes(), valid.astype(np.uint8).tobytes())], BLOCK)])

    return pieces.groupBy("level", "block_row", "block_col").applyInArrow(run, BLOCK)


def most_frequent(cells: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Of the valid values along the last axis the most frequent, the least of several; 0 where there is none."""
    order = np.lexsort((cells, ~ok), axis=-1)
    n = cells.shape[-1]
    x, valid = (np.take_along_axis(a, order, axis=-1).reshape(-1, n) for a in (cells, ok))
    new = np.ones(x.shape, dtype=bool)
    new[:, 1:] = (x[:, 1:] != x[:, :-1]) | (valid[:, 1:] != valid[:, :-1])
    starts = np.flatnonzero(new)
    row, often = starts // n, np.diff(np.append(starts, x.size)) * valid.ravel()[starts]
    best = np.lexsort((starts, -often, row))
    best = best[np.append(True, row[best][1:] != row[best][:-1])]
    return np.where(often[best] > 0, x.ravel()[starts[best]], 0).reshape(cells.shape[:-1])


def reduced(x: np.ndarray, valid: np.ndarray, f: int, method: str, nodata: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A (bands, n, n) array decimated by f, over valid pixels only; type and nodata places as before.

    With ``nodata``, a band's cells of that value are left out of that band
    alone, and where no others are left, it stands; a cell is valid if any band is.
    """
    bands, n, _ = x.shape
    m = n // f
    if method == "nearest":
        return np.ascontiguousarray(x[:, ::f, ::f]), np.ascontiguousarray(valid[::f, ::f])
    in_cells = lambda a: a.reshape(-1, m, f, m, f).transpose(0, 1, 3, 2, 4).reshape(-1, m, m, f * f)
    cells, ok = in_cells(x), in_cells(valid)
    if nodata is not None:
        ok = ok & ~is_nodata(cells, nodata)
    count = ok.sum(axis=3)
    y = np.where(ok, cells, 0).astype(np.float64)
    if method == "average":
        value = y.sum(axis=3) / np.maximum(count, 1)
    elif method == "rms":
        value = np.sqrt((y * y).sum(axis=3) / np.maximum(count, 1))
    elif method == "sum":
        value = y.sum(axis=3)
    elif method == "mode":
        value = most_frequent(cells, np.broadcast_to(ok, cells.shape))
    else:
        raise ValueError(f"blocks are not reduced by {method}")
    out = saturate(value, x.dtype)
    if nodata is not None:
        out = np.where(count > 0, out, x.dtype.type(nodata))
    return out, (count > 0).any(axis=0)


def is_nodata(x: np.ndarray, nodata: float) -> np.ndarray:
    return np.isnan(x) if nodata != nodata else x == nodata


def overview(blocks: DataFrame, level: int, factor: int, block: int, bands: int, dtype: str, method: str, fill: float = 0.0, nodata: float | None = None) -> DataFrame:
    """An overview level of level-0 blocks; invalid cells hold ``fill``, and ``nodata`` is left out in each band by itself."""
    kind, side = np.dtype(dtype), block // factor
    if factor > block:
        raise ValueError("a block is smaller than one cell of the overview; take larger blocks")

    def shrink(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], dtype=kind).reshape(bands, block, block)
                small, ok = reduced(x, np.frombuffer(r["valid"], dtype=np.uint8).reshape(block, block) > 0, factor, method, nodata)
                small = np.where(ok, small, kind.type(fill))
                out.append((level, r["block_row"] // factor, r["block_col"] // factor, r["block_row"] % factor * side, r["block_col"] % factor * side, 0, side, side, dtype, small.tobytes() + ok.astype(np.uint8).tobytes()))
            yield batch_of(out, PIECE)

    return joined(blocks.mapInArrow(shrink, PIECE), level, block, side, bands, kind, fill)


def joined(pieces: DataFrame, level: int, block: int, side: int, bands: int, kind: np.dtype, fill: float) -> DataFrame:
    """Blocks of square pieces of all bands, each with its validity after its values."""

    def join(table: pa.Table) -> pa.Table:
        x, ok = np.full((bands, block, block), fill, dtype=kind), np.zeros((block, block), dtype=np.uint8)
        for r in table.to_pylist():
            at = slice(r["at_row"], r["at_row"] + side), slice(r["at_col"], r["at_col"] + side)
            cutoff = bands * side * side * kind.itemsize
            x[(slice(None), *at)] = np.frombuffer(r["data"][:cutoff], dtype=kind).reshape(bands, side, side)
            ok[at] = np.frombuffer(r["data"][cutoff:], dtype=np.uint8).reshape(side, side)
        return pa.Table.from_batches([batch_of([(level, r["block_row"], r["block_col"], x.tobytes(), ok.tobytes())], BLOCK)])

    return pieces.groupBy("level", "block_row", "block_col").applyInArrow(join, BLOCK)


def reblocked(blocks: DataFrame, block: int, new: int, bands: int, dtype: str) -> DataFrame:
    """Blocks of another size, cut from the old ones and put together where they span several."""
    if new == block:
        return blocks
    kind = np.dtype(dtype)

    def split(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], dtype=kind).reshape(bands, block, block)
                ok = np.frombuffer(r["valid"], dtype=np.uint8).reshape(block, block)
                top, left = r["block_row"] * block, r["block_col"] * block
                for i in range(top // new, (top + block - 1) // new + 1):
                    for j in range(left // new, (left + block - 1) // new + 1):
                        y, z = max(top, i * new), max(left, j * new)
                        at = slice(y - top, (i + 1) * new - top), slice(z - left, (j + 1) * new - left)
                        part, valid = x[(slice(None), *at)], ok[at]
                        out.append((r["level"], i, j, y - i * new, z - j * new, 0, *valid.shape, dtype, part.tobytes() + valid.tobytes()))
            yield batch_of(out, PIECE)

    def join(table: pa.Table) -> pa.Table:
        x, ok = np.zeros((bands, new, new), dtype=kind), np.zeros((new, new), dtype=np.uint8)
        for r in table.to_pylist():
            h, w = r["h"], r["w"]
            at, cutoff = (slice(r["at_row"], r["at_row"] + h), slice(r["at_col"], r["at_col"] + w)), bands * h * w * kind.itemsize
            x[(slice(None), *at)] = np.frombuffer(r["data"][:cutoff], dtype=kind).reshape(bands, h, w)
            ok[at] = np.frombuffer(r["data"][cutoff:], dtype=np.uint8).reshape(h, w)
        return pa.Table.from_batches([batch_of([(r["level"], r["block_row"], r["block_col"], x.tobytes(), ok.tobytes())], BLOCK)])

    return blocks.mapInArrow(split, PIECE).groupBy("level", "block_row", "block_col").applyInArrow(join, BLOCK)


def to_pixels(blocks: DataFrame, block: int, bands: int, dtype: str, width: int, height: int, nodata: float | None = None) -> DataFrame:
    """(band, row, col, value) of blocks, within the raster; invalid pixels are null, and so is ``nodata`` in any band."""
    kind, schema = np.dtype(dtype), "band int, row long, col long, value double"

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], dtype=kind).reshape(bands, block, block).astype(np.float64)
                ok = np.frombuffer(r["valid"], dtype=np.uint8).reshape(block, block) > 0
                top, left = r["block_row"] * block, r["block_col"] * block
                high, wide = min(block, height - top), min(block, width - left)
                b, y, z = np.indices((bands, high, wide))
                missing = np.broadcast_to(~ok[:high, :wide], (bands, high, wide))
                if nodata is not None:
                    missing = missing | is_nodata(x[:, :high, :wide], nodata)
                value = pa.array(x[:, :high, :wide].ravel(), mask=missing.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(b.ravel().astype(np.int32) + 1), pa.array(y.ravel() + top), pa.array(z.ravel() + left), value], ["band", "row", "col", "value"])

    return blocks.mapInArrow(run, schema)


TILE = "path string, level int, block_row int, block_col int, band int, height int, width int, dtype string, data binary"


def tile_rows(blocks: DataFrame, block: int, bands: int, dtype: str, width: int, height: int, path: str, mask: bool) -> DataFrame:
    """Blocks as the ``geotiff`` source gives them: a row for each band, cut to the raster's size, band 0 their validity if ``mask``."""
    kind = np.dtype(dtype)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], dtype=kind).reshape(bands, block, block).astype(kind.newbyteorder("<"))
                ok = np.frombuffer(r["valid"], dtype=np.uint8).reshape(block, block) * np.uint8(255)
                high, wide = min(block, height - r["block_row"] * block), min(block, width - r["block_col"] * block)
                planes = [(b + 1, dtype, x[b]) for b in range(bands)] + [(0, "uint8", ok)] * mask
                out += [(path, r["level"], r["block_row"], r["block_col"], b, high, wide, t, np.ascontiguousarray(p[:high, :wide]).tobytes()) for b, t, p in planes]
            yield batch_of(out, TILE)

    return blocks.mapInArrow(run, TILE)


def from_pixels(pixels: DataFrame, level: int, block: int, bands: int, dtype: str, fill: float = 0.0) -> DataFrame:
    """Blocks of (band, row, col, value)."""
    kind = np.dtype(dtype)

    def run(table: pa.Table) -> pa.Table:
        band, row, col = (table.column(c).to_numpy() for c in ("band", "row", "col"))
        value = table.column("value").to_numpy(zero_copy_only=False).astype(np.float64)
        here = ~table.column("value").is_null().to_numpy(zero_copy_only=False)
        x, ok = np.full((bands, block, block), fill, dtype=kind), np.zeros((block, block), dtype=np.uint8)
        at = row % block, col % block
        x[band[here] - 1, at[0][here], at[1][here]] = saturate(value[here], kind)
        ok[at[0][here], at[1][here]] = 1
        return pa.Table.from_batches([batch_of([(level, int(row[0] // block), int(col[0] // block), x.tobytes(), ok.tobytes())], BLOCK)])

    return pixels.groupBy(F.floor(F.col("row") / block).alias("r"), F.floor(F.col("col") / block).alias("c")).applyInArrow(run, BLOCK)


def output_rows(blocks: DataFrame, bands: int, block: int, dtype: str, separate: bool, mask: bool) -> DataFrame:
    """(level, block_row, block_col, band, data) as the ``cog`` sink takes them."""
    kind, schema = np.dtype(dtype), "level int, block_row int, block_col int, band int, data binary"

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], dtype=kind).reshape(bands, block, block).astype(kind.newbyteorder("<"))
                key = r["level"], r["block_row"], r["block_col"]
                if separate:
                    out += [(*key, b + 1, x[b].tobytes()) for b in range(bands)]
                else:
                    out.append((*key, 0, np.ascontiguousarray(x.transpose(1, 2, 0)).tobytes()))
                if mask:
                    out.append((*key, -1, (np.frombuffer(r["valid"], dtype=np.uint8) * 255).tobytes()))
            yield batch_of(out, schema)

    return blocks.mapInArrow(run, schema)
