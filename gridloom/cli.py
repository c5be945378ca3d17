"""Command line: create, validate and describe cloud-optimized rasters."""

from __future__ import annotations

import argparse
import json
import math
import sys

from gridloom.functions import grid
from gridloom.functions.profiles import cog_profiles
from gridloom.operators.pixels import OVERVIEW_RESAMPLING, WARP_RESAMPLING


class BadValue(Exception):
    """An option's value can't be used; the exit code is 1."""


def band_list(text: str) -> tuple[int, ...]:
    try:
        out = tuple(int(x) for x in text.split(","))
    except ValueError:
        raise BadValue(f"{text} is no list of band numbers") from None
    if min(out) < 1:
        raise BadValue("band numbers begin at 1")
    return out


def nodata_value(text: str) -> float | None:
    """A number or nan; none means the source's own."""
    match text.lower():
        case "nan":
            return math.nan
        case "nil" | "none" | "nada":
            return None
    try:
        return float(text)
    except ValueError:
        raise BadValue(f"{text} is no nodata value") from None


def thread_count(text: str) -> int | str:
    if text.lower() == "all_cpus":
        return "ALL_CPUS"
    try:
        return int(text)
    except ValueError:
        raise BadValue(f"{text} is neither a number of threads nor ALL_CPUS") from None


def key_values(items: list[str]) -> dict[str, str]:
    if bad := [x for x in items if "=" not in x]:
        raise BadValue(f"{bad[0]} is not NAME=VALUE")
    return dict(x.split("=", 1) for x in items)


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    commands = main.add_subparsers(dest="command", required=True)
    c = commands.add_parser("create", help="write a raster as a cloud-optimized file")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("-b", "--bidx", help="bands, such as 1,2,3")
    c.add_argument("-p", "--cog-profile", default="deflate", type=str.lower, choices=list(cog_profiles))
    c.add_argument("--nodata")
    c.add_argument("--add-mask", action="store_true")
    c.add_argument("--blocksize", type=int)
    c.add_argument("-t", "--dtype", choices=["ubyte", "uint8", "uint16", "int16", "uint32", "int32", "float32", "float64"])
    c.add_argument("--overview-level", type=int)
    c.add_argument("--decimation-base", type=int, default=2)
    c.add_argument("--overview-resampling", default="nearest", choices=OVERVIEW_RESAMPLING)
    c.add_argument("--overview-blocksize", type=int)
    c.add_argument("-w", "--web-optimized", action="store_true")
    c.add_argument("--zoom-level-strategy", default="auto", choices=["lower", "upper", "auto"])
    c.add_argument("--zoom-level", type=int)
    c.add_argument("--aligned-levels", type=int)
    c.add_argument("-r", "--resampling", default="nearest", choices=WARP_RESAMPLING)
    c.add_argument("--in-memory", action=argparse.BooleanOptionalAction, default=None, help="accepted; Spark spills by itself")
    c.add_argument("--allow-intermediate-compression", action="store_true", help="accepted; shuffles are compressed by Spark")
    c.add_argument("--forward-band-tags", action="store_true")
    c.add_argument("--forward-ns-tags", action="store_true")
    c.add_argument("--threads", default="ALL_CPUS", help="threads of a local session")
    c.add_argument("--use-cog-driver", action="store_true", help="spell the options as that driver does; the layout is the same")
    c.add_argument("--tms", help="a tile matrix set's JSON file")
    c.add_argument("--co", action="append", default=[], metavar="NAME=VALUE")
    c.add_argument("--config", action="append", default=[], metavar="NAME=VALUE")
    c.add_argument("-q", "--quiet", action="store_true")
    v = commands.add_parser("validate", help="check a file's layout")
    i = commands.add_parser("info", help="describe a file")
    for p in (v, i):
        p.add_argument("input")
        p.add_argument("--config", action="append", default=[], metavar="NAME=VALUE")
    v.add_argument("--strict", action="store_true")
    i.add_argument("--json", action="store_true")
    return main


def session(threads: int | str, config: dict[str, str]):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("gridloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if threads != "ALL_CPUS":
        builder = builder.master(f"local[{threads}]")
    for k, value in config.items():
        builder = builder.config(k, value) if k.startswith("spark.") else builder
    return builder.getOrCreate()


def create_arguments(args: argparse.Namespace) -> dict:
    """The keyword arguments of a translation."""
    profile = cog_profiles.get(args.cog_profile) | key_values(args.co)
    tms = None
    if args.tms:
        with open(args.tms) as f:
            tms = grid.TileMatrixSet.from_json(f.read())
    elif args.web_optimized:
        tms = grid.WEB_MERCATOR
    block = args.blocksize or (min(tms.tile_width, tms.tile_height) if tms else None)
    if block:
        profile |= {"blockxsize": block, "blockysize": block}
    config = key_values(args.config)
    if small := args.overview_blocksize or (block if tms else None):
        config["GDAL_TIFF_OVR_BLOCKSIZE"] = small
    kind = {"ubyte": "uint8"}.get(args.dtype, args.dtype)
    return {
        "dst_kwargs": profile, "indexes": band_list(args.bidx) if args.bidx else None, "nodata": nodata_value(args.nodata) if args.nodata else None,
        "dtype": kind, "add_mask": args.add_mask, "overview_level": args.overview_level, "overview_resampling": args.overview_resampling, "tms": tms,
        "zoom_level_strategy": args.zoom_level_strategy, "zoom_level": args.zoom_level, "aligned_levels": args.aligned_levels, "resampling": args.resampling,
        "forward_band_tags": args.forward_band_tags, "forward_ns_tags": args.forward_ns_tags, "decimation_base": args.decimation_base,
        "in_memory": args.in_memory, "config": config, "allow_intermediate_compression": args.allow_intermediate_compression, "use_cog_driver": args.use_cog_driver, "quiet": args.quiet,
    }


def report(row: dict) -> str:
    """A description as text."""
    lines = [f"File: {row['Path']}", f"Driver: {row['Driver']}", f"Cloud-optimized: {row['COG']}", f"Compression: {row['Compression']}", f"Colour space: {row['ColorSpace']}"]
    for title in ("COG_errors", "COG_warnings"):
        lines += [f"{title}:", *(f"    - {x}" for x in row[title])] if row.get(title) else []
    for title in ("Profile", "GEO"):
        if row.get(title):
            lines += ["", title, *(f"    {k}: {v}" for k, v in row[title].items())]
    for name, tags in (row.get("Tags") or {}).items():
        lines += ["", name, *(f"    {k}: {v}" for k, v in tags.items())]
    for name, band in (row.get("Band Metadata") or {}).items():
        lines += ["", f"Band {name}", f"    Description: {band['Description']}", f"    ColorInterp: {band['ColorInterp']}"]
        if band["Offset"] != 0 and band["Scale"] != 1:
            lines.append(f"    Offset: {band['Offset']}, Scale: {band['Scale']}")
        lines += [f"    {k}: {v}" for k, v in (band["Metadata"] or {}).items()]
    lines += ["", "IFD", "    Id  Size  Block  Decimation"]
    lines += [f"    {x['Level']}  {x['Width']}x{x['Height']}  {x['Blocksize'][1]}x{x['Blocksize'][0]}  {x['Decimation']}" for x in row["IFD"]]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config = key_values(args.config)
        wanted = create_arguments(args) if args.command == "create" else {}
        threads = thread_count(args.threads) if args.command == "create" else "ALL_CPUS"
    except BadValue as x:
        print(x, file=sys.stderr)
        return 1
    from gridloom.plans import translate

    spark = session(threads, config)
    if args.command == "create":
        translate.cog_translate(spark, args.input, args.output, **wanted)
    elif args.command == "validate":
        valid, errors, warnings = translate.cog_validate(spark, args.input, args.strict, config, quiet=True)
        print(f"{args.input} is {'a valid' if valid else 'NOT a valid'} cloud-optimized file")
        for title, found in (("Errors", errors), ("Warnings", warnings)):
            if found:
                print("\n".join([f"{title}:", *(f"- {x}" for x in found)]))
    else:
        row = translate.cog_info(spark, args.input, config=config).asDict(recursive=True)
        if args.json:
            drop = lambda x: {k: drop(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else x
            print(json.dumps(drop(row)))
        else:
            print(report(row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
