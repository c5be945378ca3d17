"""Spark data sources: ``geotiff`` reads tiles, ``cog`` writes a cloud-optimized file.

Reading seeks: a task reads the header and the byte ranges of its own blocks
only, and filters on level, block row, block column and band choose blocks
before anything is read.  Writing is done by all executors: each encodes its
tiles into a file beside the target, and the commit puts headers and blocks in
order by having the file system copy byte ranges, so no process holds the whole
raster.  Paths are
those of a file system that all executors mount.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual, WriterCommitMessage

from gridloom.errors import CodecUnavailable
from gridloom.functions import codecs, jpeg
from gridloom.sources import tiff

TILE = "path string, level int, block_row int, block_col int, band int, height int, width int, dtype string, data binary"


def _file_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def opened(path: str):
    """A function read(offset, size) on a local or mounted file."""
    f = open(path, "rb")

    def read(at: int, size: int) -> bytes:
        f.seek(at)
        return f.read(size)

    return read


def parsed(path: str) -> tiff.TiffFile:
    """The headers of a file, and of the mask file beside it as ``external``."""
    out = tiff.parse(opened(path))
    if not out.masks and os.path.exists(f"{path}.msk"):
        beside = tiff.parse(opened(f"{path}.msk"))
        out.external = beside.masks or beside.directories
    return out


def decode_bands(d: tiff.Directory, band: int, row: int, data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(band, values) of a block, cut to the raster's edge by the caller."""
    block = tiff.decode_block(d, row, data)
    for i in range(block.shape[2]):
        yield (band or i + 1), np.ascontiguousarray(block[:, :, i])


@dataclass
class Blocks(InputPartition):
    """Some blocks of a file: the numbers ``start`` to ``stop`` of those that the filters leave, all if ``stop`` is None."""

    path: str
    start: int = 0
    stop: int | None = None


#: Up to so many files are cut into partitions of a few MB by the driver, which reads their headers for it; of more each is one.
FILES = 64


class TiffReader(DataSourceReader):
    """Blocks of one or more files, a few MB to a partition; tasks list the blocks themselves."""

    def __init__(self, options: dict):
        self.paths = sorted(p for x in options["path"].split(",") for p in (glob.glob(_file_path(x)) or [_file_path(x)]))
        self.size = int(options.get("partitionbytes", 8 << 20))
        self.tests: list[tuple[int, object]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        at = {("level",): 0, ("band",): 1, ("block_row",): 2, ("block_col",): 3}
        for f in filters:
            i = at.get(getattr(f, "attribute", None))
            test = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThanOrEqual: lambda x, v: x >= v, LessThanOrEqual: lambda x, v: x <= v}.get(type(f))
            if i is not None and test:
                value = f.value
                self.tests.append((i, lambda x, t=test, v=value: t(x, v)))
            yield f  # the band of a pixel-interleaved block is not known before it is read, so Spark filters too

    def wanted(self, t: tiff.TiffFile) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(level, band, row, column, offset, size) of the blocks that pass; band 0 for all bands, -1 for a mask."""
        for level, d in enumerate(t.directories):
            for block in d.blocks():
                key = (level, *block[:3])
                if all(test(key[i]) for i, test in self.tests if not (i == 1 and not block[0])):
                    yield level, *block
        for level, d in enumerate(t.masks or t.external):
            for block in d.blocks():
                if all(test((level, 0, *block[1:3])[i]) for i, test in self.tests):
                    yield level, -1, *block[1:]

    def partitions(self) -> list[Blocks]:
        if len(self.paths) > FILES:
            return [Blocks(p) for p in self.paths]
        out = []
        for path in self.paths:
            start, held, n = 0, 0, 0
            for n, block in enumerate(self.wanted(parsed(path)), 1):
                held += block[5]
                if held >= self.size:
                    out.append(Blocks(path, start, n))
                    start, held = n, 0
            if n > start:
                out.append(Blocks(path, start, n))
        return out

    def read(self, partition: Blocks) -> Iterator[tuple]:
        head = parsed(partition.path)
        read = opened(partition.path)
        read_mask = opened(f"{partition.path}.msk") if head.external else read
        for level, band, row, col, offset, count in islice(self.wanted(head), partition.start, partition.stop):
            d = ((head.masks or head.external) if band < 0 else head.directories)[level]
            bh, bw = d.block
            high, wide = min(bh, d.height - row * bh), min(bw, d.width - col * bw)
            if count:
                parts = decode_bands(d, band, row, (read_mask if band < 0 else read)(offset, count))
            else:  # a sparse block
                fill = np.full((bh, bw), 0 if d.nodata is None else d.nodata).astype(d.dtype.newbyteorder("<"))
                parts = ((b, fill) for b in ([band] if band else range(1, d.samples + 1)))
            for b, values in parts:
                if band < 0:
                    b, values = 0, (values > 0).astype(np.uint8) * 255
                values = values[:high, :wide].astype(values.dtype.newbyteorder("<"))
                yield partition.path, level, row, col, b, high, wide, d.dtype.name, values.tobytes()


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff").load(path)``: a row for each block and band; band 0 is a mask, internal or in a .msk file beside."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return TILE

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


# Writing --------------------------------------------------------------------


@dataclass
class Part(WriterCommitMessage):
    """Where a task put its blocks: (level, block row, block column, band or 0, offset, size)."""

    file: str
    blocks: list[tuple[int, int, int, int, int, int]]


class CogWriter(DataSourceWriter):
    """Writes tiles (level, block_row, block_col, band, data) as one file.

    Options: path, width, height, bands, dtype, block, factors (of the
    overviews, comma-separated), and as JSON in ``meta``: compress, interleave,
    photometric, quality (of JPEG), nodata, transform, epsg, colorinterp, colormap,
    xml.  With pixel
    interleaving ``data`` holds all bands of a block, band 0.  With the option
    ``mask`` band -1 holds the blocks of a mask, which goes to a file of its own
    (.msk) with ``internal_mask`` false.  ``overview_block`` is the block size of
    overviews.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path = _file_path(options["path"])
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.o, self.meta = dict(options), json.loads(options.get("meta", "{}"))
        self.work = f"{self.path}.{uuid.uuid4().hex}.parts"
        separate = self.meta.get("interleave", "pixel").lower() == "band"
        self.samples = 1 if separate else int(self.o["bands"])
        self.jpeg = str(self.meta.get("compress") or "").upper() == "JPEG"
        self.ycbcr = self.jpeg and self.samples == 3 and str(self.meta.get("photometric") or "").upper() == "YCBCR"
        if self.jpeg and (self.samples not in (1, 3) or np.dtype(self.o["dtype"]) != np.uint8):
            raise CodecUnavailable("JPEG takes one or three bands of bytes; choose bands and dtype, or interleave by band")

    def packed(self, level: int, band: int, data: bytes) -> bytes:
        """A block as it stands in the file; masks of JPEG files are deflated."""
        if not self.jpeg or band < 0:
            return codecs.compress(data, "DEFLATE" if self.jpeg else self.meta.get("compress"))
        side = int(self.o.get("overview_block", self.o["block"]) if level else self.o["block"])
        return jpeg.encode(np.frombuffer(data, dtype=np.uint8).reshape(side, side, self.samples), self.ycbcr, int(self.meta.get("quality") or jpeg.QUALITY))

    def write(self, iterator) -> Part:
        os.makedirs(self.work, exist_ok=True)
        name, found, at = f"{self.work}/{uuid.uuid4().hex}", [], 0
        with open(name, "wb") as f:
            for row in iterator:
                data = self.packed(row["level"], row["band"], bytes(row["data"])) if row["data"] is not None else b""
                f.write(data)
                found.append((row["level"], row["block_row"], row["block_col"], row["band"], at, len(data)))
                at += len(data)
        return Part(name, found)

    def commit(self, messages: list[Part | None]) -> None:
        where = {b[:4]: (m.file, b[4], b[5]) for m in messages if m for b in m.blocks}
        width, height, block = (int(self.o[k]) for k in ("width", "height", "block"))
        factors = [1, *(int(x) for x in self.o.get("factors", "").split(",") if x)]
        bands = int(self.o["bands"])
        separate = self.meta.get("interleave", "pixel").lower() == "band"
        files: dict[str, tuple[list, list]] = {self.path: ([], [])}
        for i, f in enumerate(factors):
            w, h = -(-width // f), -(-height // f)
            side = int(self.o.get("overview_block", block)) if i else block
            at = [(r, c) for r in range(-(-h // side)) for c in range(-(-w // side))]
            for name, masks, keys in (
                (self.path, False, [(i, *x, b) for b in (range(1, bands + 1) if separate else [0]) for x in at]),
                (self.path if self.o.get("internal_mask", "true") == "true" else f"{self.path}.msk", True, [(i, *x, -1) for x in at]),
            ):
                if not masks or self.o.get("mask") == "true":
                    levels, order = files.setdefault(name, ([], []))
                    order.append(keys)
                    levels.append({"entries": self.entries(w, h, side, bands, i, separate, masks), "counts": [where.get(k, ("", 0, 0))[2] for k in keys]})
        for name, (levels, order) in files.items():
            head, _ = tiff.layout(levels, self.tags() if name == self.path else [])
            put_together(f"{self.work}.tif", head, [where[k] for keys in reversed(order) for k in keys if k in where])
            os.replace(f"{self.work}.tif", name)
        if len(files) == 1 and os.path.exists(f"{self.path}.msk"):
            os.remove(f"{self.path}.msk")  # of the file that was there before
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.work, ignore_errors=True)

    def entries(self, w: int, h: int, block: int, bands: int, level: int, separate: bool, mask: bool = False) -> list[tuple]:
        dtype, e = np.dtype(self.o["dtype"]), tiff.entry_bytes
        if mask:
            kind = [e(254, 4, 5 if level else 4), e(258, 3, 8), e(262, 3, 4), e(277, 3, 1), e(284, 3, 1), e(339, 3, 1)]
            return [*kind, e(256, 4, w), e(257, 4, h), e(259, 3, 8 if self.jpeg else codecs.TAGS[(self.meta.get("compress") or "").upper() or None]), e(322, 4, block), e(323, 4, block)]
        interp = self.meta.get("colorinterp") or ["gray"] * bands
        rgb, palette = self.ycbcr or interp[:3] == ["red", "green", "blue"], bool(self.meta.get("colormap"))
        extra = bands - (3 if rgb else 1)
        out = [
            e(254, 4, 1 if level else 0), e(256, 4, w), e(257, 4, h), e(258, 3, [dtype.itemsize * 8] * bands), e(259, 3, codecs.TAGS[(self.meta.get("compress") or "").upper() or None]),
            e(262, 3, 3 if palette else 6 if self.ycbcr else 2 if rgb else 1), e(277, 3, bands), e(284, 3, 2 if separate else 1), e(322, 4, block), e(323, 4, block),
            e(339, 3, [{"u": 1, "i": 2, "f": 3}[dtype.kind]] * bands),
        ]
        if extra > 0:
            out.append(e(338, 3, [2 if interp[bands - extra + i : bands - extra + i + 1] == ["alpha"] else 0 for i in range(extra)]))
        if palette:
            table = {int(k): v for k, v in self.meta["colormap"].items()}
            n = 2 ** (dtype.itemsize * 8)
            out.append(e(320, 3, [table.get(i, (0, 0, 0))[c] * 257 for c in range(3) for i in range(n)]))
        if self.ycbcr:
            out.append(e(530, 3, [1, 1]))
        if self.meta.get("nodata") is not None:
            out.append(e(42113, 2, repr(self.meta["nodata"])))
        return out

    def tags(self) -> list[tuple]:
        out, t = [], self.meta.get("transform")
        if t:
            a, b, c, d, e, f = t
            if b or d:
                out.append(tiff.entry_bytes(34264, 12, [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1]))
            else:
                out += [tiff.entry_bytes(33550, 12, [a, -e, 0.0]), tiff.entry_bytes(33922, 12, [0.0, 0.0, 0.0, c, f, 0.0])]
        if code := self.meta.get("epsg"):
            geographic = 4000 <= code < 5000
            out.append(tiff.entry_bytes(34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code]))
        if self.meta.get("xml"):
            out.append(tiff.entry_bytes(42112, 2, self.meta["xml"]))
        return out


def put_together(target: str, head: bytes, ranges: list[tuple[str, int, int]], threads: int = 8) -> None:
    """Write ``head`` and then ranges (file, offset, size) of other files to ``target``.

    Ranges are copied by the operating system from file to file, several at a
    time, so their bytes do not pass through this process where it can do so.
    """
    moves: dict[str, list[tuple[int, int, int]]] = {}
    end = len(head)
    for file, at, size in ranges:
        if size:
            moves.setdefault(file, []).append((at, end, size))
            end += size
    with open(target, "wb") as out:
        out.write(head)
        out.truncate(end)
        out.flush()

        def copy(file: str) -> None:
            with open(file, "rb") as f:
                for at, to, size in moves[file]:
                    _copy_range(f.fileno(), out.fileno(), at, to, size)

        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(copy, moves))


def _copy_range(source: int, target: int, at: int, to: int, size: int) -> None:
    while size:
        try:
            n = os.copy_file_range(source, target, size, at, to)
        except (AttributeError, OSError):  # not between these file systems
            n = os.pwrite(target, os.pread(source, min(size, 8 << 20), at), to)
        if not n:
            raise OSError("a part of the output ends too early")
        at, to, size = at + n, to + n, size - n


class CogSink(DataSource):
    """``df.write.format("cog").options(...).save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "cog"

    def writer(self, schema, overwrite: bool) -> CogWriter:
        return CogWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, with filters pushed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)
    spark.dataSource.register(CogSink)


def tiles_from_array(spark: SparkSession, array: np.ndarray, block: int = 512, path: str = "memory"):
    """A (bands, height, width) array as tile rows."""
    bands, high, wide = array.shape
    rows = []
    for r in range(-(-high // block)):
        for c in range(-(-wide // block)):
            for b in range(bands):
                x = array[b, r * block : (r + 1) * block, c * block : (c + 1) * block]
                rows.append((path, 0, r, c, b + 1, *x.shape, array.dtype.name, x.astype(array.dtype.newbyteorder("<")).tobytes()))
    columns = list(zip(*rows))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
    table = pa.table([pa.array(x, type=t) for x, t in zip(columns, kinds)], names=[f.split()[0] for f in TILE.split(", ")])
    return spark.createDataFrame(table)
