"""Header tables of raster files: datasets, bands, directories (ifds) and blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.functions.projections import known, moved_point

HEADER = """path string, driver string, width int, height int, count int, dtype string, nodata double, interleave string,
compression string, photometric int, epsg int, transform array<double>, n_gcps int, ghost map<string,string>, internal_mask boolean,
tags map<string,map<string,string>>, n_colors int,
bands array<struct<band:int,colorinterp:string,description:string,scale:double,offset:double,tags:map<string,string>>>,
ifds array<struct<level:int,width:int,height:int,block_h:int,block_w:int,decimation:int,ifd_offset:bigint>>,
blocks array<struct<level:int,band:int,block_y:int,block_x:int,offset:bigint,byte_count:bigint>>,
web array<double>"""


def describe(path: str, read) -> dict:
    """The header row of one file; one that is no TIFF has a null-filled row."""
    from gridloom.sources import tiff

    empty = dict.fromkeys([c.split()[0] for c in _columns()])
    try:
        t = tiff.parse(read)
    except tiff.NotTiff:
        return empty | {"path": path, "driver": "other", "bands": [], "ifds": [], "blocks": []}
    d, meta = t.directories[0], t.directories[0].metadata()
    interp, n = d.colorinterp(), d.samples
    band = lambda b: meta["bands"].get(b, {})
    domains = {k: v for k, v in meta["dataset"].items() if k}
    structure = {"INTERLEAVE": "BAND" if d.separate else "PIXEL"} | ({"COMPRESSION": d.compression} if d.compression else {})
    return {
        "path": path, "driver": "GTiff", "width": d.width, "height": d.height, "count": n, "dtype": d.dtype.name, "nodata": d.nodata,
        "interleave": "BAND" if d.separate else "PIXEL", "compression": d.compression, "photometric": d.get(262, 1), "epsg": d.epsg,
        "transform": list(d.transform), "n_gcps": len(d.gcps), "ghost": t.ghost, "internal_mask": bool(t.masks),
        "tags": {"": meta["dataset"].get("", {}), "IMAGE_STRUCTURE": structure, **domains}, "n_colors": len(d.colormap() or {}),
        "bands": [{"band": b, "colorinterp": interp[b - 1], "description": band(b).get("description"), "scale": band(b).get("scale", 1.0), "offset": band(b).get("offset", 0.0), "tags": band(b).get("tags", {})} for b in range(1, n + 1)],
        "ifds": [{"level": i, "width": x.width, "height": x.height, "block_h": x.block[0], "block_w": x.block[1], "decimation": round(d.width / x.width) if i else 0, "ifd_offset": x.offset} for i, x in enumerate(t.directories)],
        "blocks": [{"level": i, "band": b, "block_y": y, "block_x": x, "offset": o, "byte_count": c} for i, level in enumerate(t.directories) for b, y, x, o, c in level.blocks()],
        "web": on_the_web(d.transform, d.width, d.height, d.epsg),
    }


def on_the_web(transform: tuple[float, ...], width: int, height: int, epsg: int | None) -> list[float] | None:
    """(pixel size, width, height) of a raster in Web Mercator, with as many pixels along the diagonal; None where its system is not known."""
    if not known(epsg):
        return None
    a, b, c, d, e, f = transform
    if epsg == 3857:
        return [max(abs(a), abs(e)), float(width), float(height)]
    at = [moved_point(a * x + b * y + c, d * x + e * y + f, epsg, 3857) for x, y in ((0, 0), (width, height), (width, 0), (0, height))]
    res = math.dist(at[0], at[1]) / math.hypot(width, height)
    if not (math.isfinite(res) and res > 0):
        return None
    return [res, *(float(max(1, round((max(v) - min(v)) / res))) for v in zip(*at))]


def _columns() -> list[str]:
    depth, out, word = 0, [], ""
    for c in HEADER:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def read_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One header row for each file; pixels are never decoded.

    Of files on a file system that executors mount only the byte ranges of their
    headers are read, whatever their size.  In other stores files are read whole
    by Spark, up to 2 GB each.
    """
    schema = to_arrow_schema(StructType.fromDDL(HEADER))

    def packed(row: dict) -> pa.RecordBatch:
        row = {k: (list(v.items()) if isinstance(v, dict) else v) for k, v in row.items()}
        if row["tags"] is not None:
            row["tags"] = [(k, list(v.items())) for k, v in row["tags"]]
        for b in row["bands"]:
            b["tags"] = list(b["tags"].items())
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_buffer()
                yield packed(describe(p, lambda at, size: data[at : at + size].to_pybytes() if at < len(data) else b""))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("path").to_pylist():
                with open(unquote(p.removeprefix("file://").removeprefix("file:")), "rb") as f:

                    def read(at: int, size: int) -> bytes:
                        f.seek(at)
                        return f.read(size)

                    yield packed(describe(p, read))

    files = spark.read.format("binaryFile").load(path)
    if all(f.startswith("file:") for f in files.inputFiles()):
        return files.select("path").mapInArrow(ranged, HEADER)
    return files.select("path", "content").mapInArrow(run, HEADER)


def ifds(headers: DataFrame) -> DataFrame:
    return headers.select("path", F.inline("ifds"))


def blocks(headers: DataFrame) -> DataFrame:
    return headers.select("path", F.inline("blocks"))


def bands(headers: DataFrame) -> DataFrame:
    return headers.select("path", F.inline("bands"))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the rasters that have an overview file beside them, an empty one too; file contents are not read."""
    files = spark.read.format("binaryFile").load(folder)
    over = [(unquote(p)[:-4].replace(":///", ":/", 1),) for p in files.inputFiles() if p.lower().endswith(".ovr")]
    return files.select("path").join(spark.createDataFrame(over, "path string"), "path", "left_semi")
